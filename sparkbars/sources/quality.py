"""Gates before data are stored: completeness, duplicates, rules, pending dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validate_snapshot(df: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected days with reason). A day is rejected whole when its row count differs
    from the declared total or when a symbol occurs twice on it."""
    per = df.groupBy("d").agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("sym").alias("symbols"))
    per = per.join(declared.select("d", "declared"), "d", "left") if declared is not None else per.withColumn("declared", F.lit(None).cast("long"))
    reason = (F.when(F.col("declared") != F.col("row_count"), "incomplete").when(F.col("symbols") < F.col("row_count"), "duplicate symbols"))
    bad = per.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return df.join(bad.select("d"), "d", "left_anti"), bad


def dedupe_or_reject(df: DataFrame, keys: Sequence[str], group: str = "d") -> tuple[DataFrame, DataFrame]:
    """Identical duplicates collapse; a group in which a key has differing rows is rejected whole."""
    unique = df.dropDuplicates()
    clash = unique.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(group).distinct()
    return unique.join(clash, group, "left_anti"), clash


def expect(df: DataFrame, rules: dict[str, Column], unique: Sequence[str] = (), references: dict[str, tuple[DataFrame, str]] | None = None
           ) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reasons``). A rule that is NULL passes, as a check constraint
    does. ``references`` maps a column to (frame, column) that must contain it."""
    checks = [F.when(~F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items()]
    work = df
    drop: list[str] = []
    if unique:
        twice = df.groupBy(*unique).agg((F.count(F.lit(1)) > 1).alias("_twice"))
        work = work.join(twice, list(unique), "left")
        checks.append(F.when(F.col("_twice"), F.lit("unique")))
        drop.append("_twice")
    for column, (other, other_column) in (references or {}).items():
        flag = f"_ref_{column}"
        known = other.select(F.col(other_column).alias(column), F.lit(True).alias(flag)).distinct()
        work = work.join(known, column, "left")
        checks.append(F.when(F.col(column).isNotNull() & F.col(flag).isNull(), F.lit(f"unknown {column}")))
        drop.append(flag)
    work = work.withColumn("reasons", F.array_compact(F.array(*checks))).drop(*drop)
    return work.filter(F.size("reasons") == 0).drop("reasons").select(*df.columns), work.filter(F.size("reasons") > 0)


def weekdays(df_start: DataFrame) -> DataFrame:
    """``start, end`` rows to one row ``d`` per weekday between them."""
    days = df_start.select(F.explode(F.sequence("start", "end")).alias("d"))
    return days.filter(F.weekday("d") < 5)


def pending_dates(log: DataFrame, start: Column, end: Column, refresh: int) -> DataFrame:
    """Weekdays to fetch: all but those settled (success or no data) before the refresh window, so the
    newest days are always looked at again."""
    span = log.sparkSession.range(1).select(start.alias("start"), end.alias("end"))
    settled = log.filter(F.col("status").isin("success", "no_data") & (F.col("d") < F.date_sub(end, refresh))).select("d").distinct()
    return weekdays(span).join(settled, "d", "left_anti")


def missing_weekdays(log: DataFrame, start: Column, end: Column) -> DataFrame:
    """Weekdays without any entry."""
    span = log.sparkSession.range(1).select(start.alias("start"), end.alias("end"))
    return weekdays(span).join(log.select("d").distinct(), "d", "left_anti")


def backlog(dates: DataFrame, done: DataFrame, limit: int) -> DataFrame:
    """The next dates not done yet, oldest first, at most ``limit`` per run (the cap is the feature)."""
    return dates.join(done.select("d").distinct(), "d", "left_anti").orderBy("d").limit(limit)


def merge_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """A sync log with new results; attempts accumulate per date."""
    both = log.select("d", "status", "attempts", "row_count", F.lit(0).alias("_new")).unionByName(
        new.select("d", "status", "attempts", "row_count", F.lit(1).alias("_new")))
    last = Window.partitionBy("d").orderBy(F.desc("_new"))
    total = F.sum("attempts").over(Window.partitionBy("d"))
    return both.withColumns({"attempts": total, "_k": F.row_number().over(last)}).filter("_k = 1").drop("_k", "_new")
