"""Broker activity: totals with market share, months, profiles.

A broker table has ``d, broker, volume, value, freq``; results per broker are as many as there
are licensed brokers (a few hundred), so ranking them in one place is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import num
from . import scale


def with_broker(daily: DataFrame, master: DataFrame) -> DataFrame:
    """Only brokers of the master (``broker, broker_name``) remain."""
    return daily.join(master, "broker")


def _money(x: str) -> Column:
    return F.sum(num(x).cast("decimal(28,2)")).cast("double")


def broker_totals(daily: DataFrame, master: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sums, active days, rank by value and market shares over a date range."""
    rows = daily.filter(F.col("d").between(start, end))
    per = rows.groupBy("broker").agg(
        F.sum("volume").alias("volume"), _money("value").alias("value"), F.sum("freq").alias("freq"),
        F.count_distinct("d").alias("active_days"))
    per = with_broker(per, master)
    share = {}
    for c in ("value", "volume", "freq"):
        total = F.sum(F.col(c).cast("double")).over(Window.partitionBy())
        share[f"share_{c}"] = F.when(total != 0, F.col(c) / total * 100).otherwise(F.lit(0.0))
    rank = F.row_number().over(Window.orderBy(F.desc("value"), F.asc("broker")))
    return per.withColumns(share).withColumn("rank", rank)


def broker_monthly(daily: DataFrame, per_broker: bool = False) -> DataFrame:
    """Activity per month of all brokers together, or of each broker and of all (broker NULL)."""
    aggs = [F.count_distinct("d").alias("active_days"), _money("value").alias("value"),
            F.sum("volume").alias("volume"), F.sum("freq").alias("freq")]
    df = daily.withColumn("month", F.date_format("d", "yyyy-MM"))
    if not per_broker:
        return df.groupBy("month").agg(*aggs)
    return df.groupingSets([["broker", "month"], ["month"]], "broker", "month").agg(*aggs)


def broker_profile(daily: DataFrame, asof: Column) -> DataFrame:
    """Year-to-date sums and rank by value of every broker as of a date."""
    ytd = daily.filter((F.col("d") >= F.trunc(asof, "year")) & (F.col("d") <= asof))
    per = ytd.groupBy("broker").agg(
        _money("value").alias("ytd_value"), F.sum("volume").alias("ytd_volume"), F.sum("freq").alias("ytd_freq"),
        F.count_distinct("d").alias("ytd_days"))
    return per.withColumn("rank_ytd", F.rank().over(Window.orderBy(F.desc("ytd_value"))))


def broker_history(daily: DataFrame, n: int = 252) -> DataFrame:
    """The last n days of every broker, newest first."""
    return scale.top_k(daily, ["broker"], [F.desc("d")], n, rank="k")
