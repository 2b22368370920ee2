"""Bars out of trade-level rows, and the dense session grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import market_calendar


def bars_from_trades(trades: DataFrame, price: Column, quantity: Column, value: Column,
                     order: Sequence[str], side: Column | None = None,
                     keys: Sequence[str] = ("sym", "d")) -> DataFrame:
    """Open, high, low, close, volume, value and count per key. One hash aggregation: every
    measure combines on the map side, so a symbol with a third of all trades costs one row per
    task and day. ``side`` 'A' counts as foreign bought, 'R' as foreign sold. Money is summed as
    decimals, so the result does not depend on the order of rows."""
    o = F.struct(*order)
    out = trades.groupBy(*keys).agg(
        F.min_by(price, o).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, o).alias("close"),
        F.sum(quantity).cast("long").alias("volume"),
        F.sum(value.cast("decimal(18,2)")).cast("double").alias("value"),
        F.count(F.lit(1)).alias("freq"),
        *([] if side is None else [
            F.sum(F.when(side == "A", quantity).otherwise(0.0)).alias("fbuy"),
            F.sum(F.when(side == "R", quantity).otherwise(0.0)).alias("fsell"),
        ]),
    )
    return out


ROWS_A_PART = 250_000  # trades whose bars one task takes through the windows, several hundred MB with rows stretched up to tenfold


def by_symbol(bars: DataFrame, trades: int) -> DataFrame:
    """Bars dealt over parts by symbol, as per-symbol windows want them. The number of parts follows the number of ``trades``
    they come from, so a task's share stays the same size however large the table is; below that the session's own setting
    and adaptive execution decide. The windows that follow need no other exchange."""
    parts = -(-trades // ROWS_A_PART)
    if parts <= int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return bars
    return bars.repartition(parts, "sym")


def with_reference(bars: DataFrame, factor: Column | None = None) -> DataFrame:
    """``prev`` (previous close, times a corporate-action factor) and ``change``."""
    last = F.lag("close").over(Window.partitionBy("sym").orderBy("d"))
    prev = last if factor is None else last * factor
    return bars.withColumn("prev", prev).withColumn("change", F.col("close") - F.col("prev"))


def densify(bars: DataFrame, marks: Sequence[str] = (), sessions: DataFrame | None = None) -> DataFrame:
    """A row for every market session from a symbol's first bar on. On missing sessions the price
    is frozen and nothing trades, as for a suspended stock; columns named by ``marks`` are NULL there. Each bar is
    stretched over the sessions up to the next one, so the work is linear in the output and nothing is cross joined.
    The calendar, a row per session, goes to every task: the rows stay dealt by symbol and are never exchanged. It is read
    from ``sessions`` where that has the same dates at less cost than the bars, such as the bars before they are dealt."""
    calendar = market_calendar(bars if sessions is None else sessions)
    end = calendar.agg(F.max("s")).scalar()
    calendar = F.broadcast(calendar)
    indexed = bars.join(calendar, "d")
    following = F.lead("s").over(Window.partitionBy("sym").orderBy("d"))
    spans = indexed.withColumn("_stop", F.coalesce(following - 1, end))
    rows = spans.withColumn("_s", F.explode(F.sequence("s", "_stop")))
    real = F.col("_s") == F.col("s")
    frozen = F.col("close")
    zero = {c: F.when(real, F.col(c)).otherwise(F.lit(0).cast(dict(bars.dtypes)[c]))
            for c in ("volume", "value", "freq", "fbuy", "fsell") if c in bars.columns}
    prices = {c: F.when(real, F.col(c)).otherwise(F.lit(0.0)) for c in ("high", "low", "open") if c in bars.columns}
    prices |= {c: F.when(real, F.col(c)) for c in marks}
    if "prev" in bars.columns:
        prices["prev"] = F.when(real, F.col("prev")).otherwise(frozen)
        prices["change"] = F.when(real, F.col("change")).otherwise(F.lit(0.0))
    rows = rows.drop("d").withColumns({**zero, **prices}).drop("s", "_stop")
    return rows.join(calendar.withColumnRenamed("s", "_s"), "_s").withColumnRenamed("_s", "s")
