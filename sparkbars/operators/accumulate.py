"""Accumulation of volume, value and foreign flow per symbol, over a range or by period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import period_key
from ..functions.numbers import num


def _aggregates() -> list[Column]:
    """First and last bar come from the same pass as the sums: no join back to the bars."""
    net = num("fbuy") - num("fsell")
    return [
        F.count(F.lit(1)).alias("active_days"),
        F.min("d").alias("start_date"), F.max("d").alias("end_date"),
        F.sum(num("volume")).cast("long").alias("volume"),
        F.sum(num("value").cast("decimal(28,2)")).cast("double").alias("value"),
        F.sum(num("freq")).cast("long").alias("freq"),
        F.sum(net).alias("net_foreign"), F.sum(net * num("close")).alias("net_foreign_value"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.min_by("close", "d").alias("start_price"), F.min_by("prev", "d").alias("_start_prev"),
        F.max_by("close", "d").alias("end_price"),
    ]


def _derive(df: DataFrame) -> DataFrame:
    base = F.when(F.coalesce("_start_prev", F.lit(0.0)) != 0, F.col("_start_prev")).otherwise(num("start_price"))
    change = num("end_price") - base
    return df.withColumns({
        "change": change,
        "change_pct": F.when(base > 0, change / base * 100).otherwise(F.lit(0.0)),
        "vwap": F.when(F.col("volume") > 0, F.col("value") / F.col("volume")).otherwise(F.lit(0.0)),
    }).drop("_start_prev")


def accumulate(bars: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One row per symbol over [start, end]."""
    if start is not None:
        bars = bars.filter(F.col("d") >= start)
    if end is not None:
        bars = bars.filter(F.col("d") <= end)
    return _derive(bars.groupBy("sym").agg(*_aggregates()))


def accumulate_by(bars: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row per symbol, period kind and period; all kinds in one pass over the bars."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), period_key("d", k).alias("period")) for k in kinds])
    long = bars.withColumn("_k", F.explode(keys)).withColumns({"kind": F.col("_k.kind"), "period": F.col("_k.period")})
    return _derive(long.groupBy("sym", "kind", "period").agg(*_aggregates()))


def totals(acc: DataFrame) -> DataFrame:
    """Market totals of an accumulation table."""
    return acc.agg(F.count(F.lit(1)).alias("symbols"), F.sum("net_foreign").alias("net_foreign"),
                   F.sum("net_foreign_value").alias("net_foreign_value"), F.sum(F.col("value").cast("decimal(28,2)")).cast("double").alias("value"))
