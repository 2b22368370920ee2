"""Ownership snapshots: ``record_date, sym, investor, class, origin (L/F/N), shares, pct``.

One symbol may have very many holders, so holders are never gathered: dates are ranked on the
distinct (symbol, date) pairs and holders meet by (symbol, name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import num
from ..functions.text import holder_class
from . import scale


def _two_newest(own: DataFrame) -> DataFrame:
    dates = own.select("sym", "record_date").distinct()
    order = Window.partitionBy("sym").orderBy(F.desc("record_date"))
    k = dates.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= 2)
    return own.join(k, ["sym", "record_date"])


def snapshot_diff(own: DataFrame) -> DataFrame:
    """New, active and exited holders between a symbol's two newest snapshots, with the changes."""
    rows = _two_newest(own).withColumn("_name", F.upper("investor"))
    now = rows.filter("_k = 1").select("sym", "_name", F.col("investor").alias("_n1"), F.col("shares").alias("_s1"), F.col("pct").alias("_p1"))
    old = rows.filter("_k = 2").select("sym", "_name", F.col("investor").alias("_n2"), F.col("shares").alias("_s2"), F.col("pct").alias("_p2"))
    j = now.join(old, ["sym", "_name"], "full_outer")
    status = F.when(F.col("_n2").isNull(), "New").when(F.col("_n1").isNull(), "Exited").otherwise("Active")
    return j.select(
        "sym", F.coalesce("_n1", "_n2").alias("investor"), status.alias("status"),
        (num("_s1") - num("_s2")).cast("long").alias("share_change"), (num("_p1") - num("_p2")).alias("pct_change"))


def top_changes(own: DataFrame, k: int = 10) -> DataFrame:
    """The k largest changes per symbol, for symbols that have two snapshots."""
    dates = own.groupBy("sym").agg(F.count_distinct("record_date").alias("_n")).filter("_n > 1").select("sym")
    diff = snapshot_diff(own).join(dates, "sym", "left_semi")
    return scale.top_k(diff, ["sym"], [F.desc(F.abs("share_change")), F.asc("investor")], k)


def concentration(own: DataFrame) -> DataFrame:
    """Newest snapshot per symbol: holders, summed percentages, foreign part."""
    now = _two_newest(own).filter("_k = 1")
    return now.groupBy("sym", "record_date").agg(
        F.count(F.lit(1)).alias("positions"), F.sum("pct").alias("concentration_pct"),
        F.sum(F.when(F.col("origin") == "F", F.col("pct")).otherwise(0.0)).alias("foreign_pct"))


def top_positions(own: DataFrame, k: int = 10) -> DataFrame:
    now = _two_newest(own).filter("_k = 1")
    return scale.top_k(now, ["sym"], [F.desc("pct"), F.desc("shares"), F.asc("investor")], k)


def dashboard(own: DataFrame, market_shares: int) -> DataFrame:
    """Per month: positions, distinct investors, monitored and non-scrip share of the market, origin split."""
    month = F.date_format("record_date", "yyyy-MM").alias("month")
    foreign = F.sum(F.when(F.col("origin") == "F", F.col("shares")).otherwise(0))
    total = F.sum("shares")
    return own.groupBy(month).agg(
        F.count(F.lit(1)).alias("positions"), F.count_distinct(F.upper(F.trim("investor"))).alias("investors"),
        total.alias("shares"), (total / market_shares * 100).alias("monitored_pct"),
        (F.sum(F.when(F.col("origin") == "N", F.col("shares")).otherwise(0)) / market_shares * 100).alias("non_scrip_pct"),
        (foreign / total * 100).alias("foreign_pct"), ((total - foreign) / total * 100).alias("local_pct"))


def class_counts(own: DataFrame) -> DataFrame:
    month = F.date_format("record_date", "yyyy-MM").alias("month")
    return own.groupBy(month, holder_class("class").alias("holder_class")).agg(F.count(F.lit(1)).alias("positions"))


def top_holders(own: DataFrame, k: int = 10) -> DataFrame:
    df = own.withColumn("month", F.date_format("record_date", "yyyy-MM"))
    return scale.top_k(df, ["month"], [F.desc("shares"), F.asc("sym"), F.asc("investor")], k)


def sector_counts(fund: DataFrame, k: int = 10) -> DataFrame:
    """The k sectors with most symbols."""
    sector = F.coalesce(F.nullif(F.col("sector"), F.lit("")), F.lit("Unknown")).alias("sector")
    n = fund.groupBy(sector).agg(F.count(F.lit(1)).alias("symbols"))
    return scale.top_n(n, [F.desc("symbols"), F.asc("sector")], k)


def ownership_view(own: DataFrame, master: DataFrame, name: str = "v_ownership_positions") -> DataFrame:
    """Positions with the issuer's name, also registered as a view."""
    out = own.join(master.select("sym", F.col("name").alias("issuer")), "sym")
    out.createOrReplaceTempView(name)
    return out
