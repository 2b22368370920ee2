"""Name and master joins, latest versions, as-of joins, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import col

# No join here is hinted: whether a side is broadcast is left to Spark, which checks its size.


def with_name(bars: DataFrame, master: DataFrame) -> DataFrame:
    """Name by fallback: master, then the bar's own, then the symbol."""
    m = master.select("sym", F.col("name").alias("_master_name"))
    own = F.nullif(F.col("name"), F.lit("")) if "name" in bars.columns else F.lit(None).cast("string")
    out = bars.join(m, "sym", "left")
    return out.withColumn("name", F.coalesce(F.nullif(F.col("_master_name"), F.lit("")), own, F.col("sym"))).drop("_master_name")


def restrict(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """Only bars of the given symbols."""
    return bars.join(symbols.select("sym").distinct(), "sym", "left_semi")


def latest_version(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row per key in the given order (a top-1: combined before the exchange)."""
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_v", F.row_number().over(window)).filter(F.col("_v") == 1).drop("_v")


def latest_fundamental(fund: DataFrame, prefer_non_null: bool = True) -> DataFrame:
    """Newest snapshot per symbol; rows that carry any ratio go first when preferred."""
    has = F.when(F.col("per").isNotNull() | F.col("pbv").isNotNull() | F.col("roe").isNotNull(), 1).otherwise(0)
    order = [F.desc(has)] if prefer_non_null else []
    return latest_version(fund, "sym", [*order, F.desc("as_of"), F.desc("synced_at")])


def asof_join(left: DataFrame, right: DataFrame, key: str, on: str, values: Sequence[str],
              right_on: str = "d", tolerance_days: int | None = None) -> DataFrame:
    """For each left row the values of the last right row on or before its date.

    The search runs on distinct (key, date) pairs only, so neither many left rows of one key nor
    many of one date meet in a task: a key holds at most one pair per calendar day. Both sides are
    then sorted together and the last right row is carried forward."""
    struct = F.struct(F.col(right_on).alias("_at"), *values)
    pairs = left.select(key, F.col(on).cast("date").alias("_d")).distinct()
    marks = pairs.select(key, "_d", F.lit(1).alias("_side"), F.lit(None).cast(right.select(struct.alias("s")).schema["s"].dataType).alias("_row"))
    facts = right.filter(F.col(right_on).isNotNull()).select(
        key, F.col(right_on).cast("date").alias("_d"), F.lit(0).alias("_side"), struct.alias("_row"))
    window = Window.partitionBy(key).orderBy("_d", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = facts.unionByName(marks).withColumn("_found", F.last("_row", ignorenulls=True).over(window))
    found = carried.filter(F.col("_side") == 1)
    if tolerance_days is not None:
        fresh = F.datediff(F.col("_d"), F.col("_found._at")) <= tolerance_days
        found = found.withColumn("_found", F.when(fresh, F.col("_found")))
    found = found.select(F.col(key).alias("_key"), "_d", F.col("_found._at").alias(f"{right_on}_asof"),
                         *[F.col(f"_found.{v}").alias(v) for v in values])
    return left.join(found, (left[key] == found["_key"]) & (left[on].cast("date") == found["_d"]), "left").drop("_key", "_d")


# Page size limits of the browse view.
MIN_PAGE, MAX_PAGE = 20, 100


def browse(bars: DataFrame, sym: str | None = None, start: Column | None = None, end: Column | None = None,
           page: int = 1, size: int = 50) -> DataFrame:
    """One page of bars, newest first, with net foreign and the total number of rows and pages.
    The page is clamped to those there are. The total is a scalar subquery, and every task sorts only its first
    page * size rows."""
    size = max(MIN_PAGE, min(size, MAX_PAGE))
    rows = bars
    if sym:
        rows = rows.filter(F.col("sym") == sym.strip().upper())
    if start is not None:
        rows = rows.filter(F.col("d") >= start)
    if end is not None:
        rows = rows.filter(F.col("d") <= end)
    net = F.coalesce("fbuy", F.lit(0.0)) - F.coalesce("fsell", F.lit(0.0))
    return one_page(rows, [F.desc("d"), F.asc("sym")], page, size).withColumn("net_foreign", net)


def one_page(rows: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of ``rows`` in a total order, with ``total``, ``pages`` and ``page``, which is clamped to those there are."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    top = rows.orderBy(*order).limit(max(1, page) * size)
    top = top.withColumns({"total": total, "_n": F.row_number().over(Window.orderBy(*order))})
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int")
    top = top.withColumns({"pages": pages, "page": F.least(F.lit(max(1, page)), pages)})
    return top.filter(F.ceil(F.col("_n") / size) == F.col("page")).drop("_n")


def eod_panel(tech: DataFrame, liquidity: DataFrame | None, flow: DataFrame | None, master: DataFrame) -> DataFrame:
    """Technical rows with the liquidity and flow tables of the same (symbol, date), named. A table is None where ``tech`` has
    its columns already: what comes from the same bars is worked out in one pass over them and needs no join."""
    out = tech
    for table in (liquidity, flow):
        if table is not None:
            out = out.join(table, ["sym", "d"], "left")
    return with_name(out, master)


def range_position(bars: DataFrame) -> DataFrame:
    """Least, greatest and newest close per symbol and where the newest lies between them."""
    df = bars.groupBy("sym").agg(F.min("close").alias("min_close"), F.max("close").alias("max_close"),
                                 F.max_by("close", "d").alias("latest_close"), F.count(F.lit(1)).alias("days"))
    spread = F.col("max_close") - F.col("min_close")
    return df.withColumn("range_pos_pct", F.when(spread > 0, (F.col("latest_close") - F.col("min_close")) / spread * 100))


def ohlcv_view(bars: DataFrame, name: str = "v_ohlcv_daily") -> DataFrame:
    """Plain open-high-low-close-volume columns, also registered as a view."""
    out = bars.select(F.col("d").alias("date"), F.col("sym").alias("ticker"), "open", "high", "low", "close", "volume")
    out.createOrReplaceTempView(name)
    return out
