"""Streaming forms of the bar operators: windows over ticks, idempotent sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bars_from_ticks(ticks: DataFrame, width: str = "1 day", lateness: str = "14 days") -> DataFrame:
    """Open, high, low, close, volume, value and count per symbol and tumbling window of ``ts, sym, price,
    quantity, tick_id``. Works on static and streaming input; on streams, ticks later than the watermark
    are dropped and earlier ones still update their window."""
    order = F.struct("ts", "tick_id")
    src = ticks.withWatermark("ts", lateness) if ticks.isStreaming else ticks
    out = src.groupBy(F.window("ts", width), "sym").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"), F.sum((F.col("price") * F.col("quantity")).cast("decimal(28,4)")).cast("double").alias("value"),
        F.count(F.lit(1)).alias("freq"))
    return out.select(F.col("window.start").alias("ts"), "sym", "open", "high", "low", "close", "volume", "value", "freq")


def sliding_activity(ticks: DataFrame, length: str = "20 days", step: str = "1 day", lateness: str = "14 days") -> DataFrame:
    """Volume, value and count over sliding windows."""
    src = ticks.withWatermark("ts", lateness) if ticks.isStreaming else ticks
    out = src.groupBy(F.window("ts", length, step), "sym").agg(
        F.sum("quantity").alias("volume"), F.sum((F.col("price") * F.col("quantity")).cast("decimal(28,4)")).cast("double").alias("value"),
        F.count(F.lit(1)).alias("freq"))
    return out.select(F.col("window.end").alias("ts"), "sym", "volume", "value", "freq")


def sessions(ticks: DataFrame, gap: str = "30 minutes", lateness: str = "14 days") -> DataFrame:
    """Open, high, low, close, volume, value and count per symbol and session of ``ts, sym, price, quantity, tick_id``: ticks
    at most ``gap`` apart belong together, and a late tick that bridges two sessions merges them.

    ``start`` and ``finish`` are the times of a session's first and last tick. Works on static and streaming input; a
    stream emits a session (append mode) once the watermark has passed its end. Partial sessions are
    merged on the map side, so a hot symbol sends sessions, not ticks."""
    order = F.struct("ts", "tick_id")
    src = ticks.withWatermark("ts", lateness) if ticks.isStreaming else ticks
    out = src.groupBy(F.session_window("ts", gap).alias("_session"), "sym").agg(
        F.min("ts").alias("start"), F.max("ts").alias("finish"), F.min_by("price", order).alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"),
        F.sum((F.col("price") * F.col("quantity")).cast("decimal(28,4)")).cast("double").alias("value"), F.count(F.lit(1)).alias("freq"))
    return out.drop("_session")


def recheck(bars: DataFrame, days: int = 14, version: str = "version") -> DataFrame:
    """Streaming late-data policy: of the versions of a (symbol, date) that arrive inside the re-check horizon the
    newest wins, and is emitted when the horizon has passed; older rows are ignored by the watermark."""
    rest = [c for c in bars.columns if c not in ("sym", "ts")]
    newest = bars.withWatermark("ts", f"{days} days").groupBy("sym", "ts").agg(F.max_by(F.struct(*rest), version).alias("_new"))
    return newest.select(*[F.col(c) if c in ("sym", "ts") else F.col(f"_new.{c}") for c in bars.columns])


def settle(bars: DataFrame, newest: Column, days: int = 14, version: str = "version") -> DataFrame:
    """Batch twin with replacement: inside the horizon the newest version of a bar wins, outside it the
    first one stays."""
    inside = F.col("d") >= F.date_sub(newest, days)
    order = F.when(inside, -F.col(version)).otherwise(F.col(version))
    k = F.row_number().over(Window.partitionBy("sym", "d").orderBy(order))
    return bars.withColumn("_k", k).filter("_k = 1").drop("_k")


def write_days(stream: DataFrame, path: str, checkpoint: str):
    """Idempotent sink: every micro-batch owns one folder per date it touches, ``d=.../batch=...``, and replaces only
    that. A repeated batch writes the same folder again; a date that is spread over several batches keeps
    all of them. ``read_days`` merges them by key."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("d", "batch").parquet(path))
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def read_days(spark: SparkSession, path: str, keys: Sequence[str] = ("sym", "d"), version: str | None = None) -> DataFrame:
    """What ``write_days`` has written: per key the row of the greatest ``version``, by default of the last batch."""
    rows = spark.read.parquet(path)
    order = F.struct(*([version] if version else []), "batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_new"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_new.{c}") for c in rows.columns if c != "batch"])
