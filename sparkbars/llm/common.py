"""Helpers the operators share: work tables in the shared folder, order-preserving buckets, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text's bytes: bytes.split() cuts at 0x20 and 0x09-0x0D only, bytes.lower() maps A-Z only.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session, as in tests, may go without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="sparkbars-work-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: it cuts the lineage, survives lost
    executors and lets later readers prune columns."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, and at most ``rows`` rows in an Arrow batch of its session from here on: rows that hold whole texts are
    large, and a batch is in memory at once, in the executor and in its Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n`` - 1 ascending split points of a bigint column, from one mergeable sketch."""
    row = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(2000, 50 * n)).alias("q")).first() if n > 1 else None
    return sorted(set(row.q)) if row is not None and row.q else []


def bucket_of(key: str | Column, bounds: Sequence[int]) -> Column:
    """Number of split points below or equal to the key: buckets keep the key's order. Nulls come first."""
    key = F.col(key) if isinstance(key, str) else key
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(int(b)).cast("bigint") for b in bounds])
    # array_position finds nothing for a key between split points, so the count of smaller ones is taken.
    return F.coalesce(F.size(F.filter(table, lambda b: b <= key)), F.lit(0))


def cells(left: DataFrame, right: DataFrame, by: Sequence[str], per_left: int, per_right: int, left_key: str, right_key: str):
    """Cogrouped cells in which every row of ``left`` meets every row of ``right`` that agrees with it in ``by``, each
    pair once.

    Both sides of a group are dealt over blocks by the hash of their key, as many as its counts ask for, so the size of
    a cell is bounded whatever the group holds; a row is sent to each block of the other side of its group.
    """
    by = list(by)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides may come from one table
    n_left, n_right = left.groupBy(*by).agg(F.count("*").alias("n_left")), right.groupBy(*by).agg(F.count("*").alias("n_right"))
    sizes = stage(n_left.join(n_right, by).select(
        *by, F.ceil(F.col("n_left") / per_left).cast("int").alias("l_blocks"), F.ceil(F.col("n_right") / per_right).cast("int").alias("r_blocks")), "sizes")

    def dealt(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
        blocks = df.join(sizes, by).withColumn(f"{own}_block", F.pmod(F.xxhash64(key), F.col(f"{own}_blocks")).cast("int"))
        return blocks.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).drop("l_blocks", "r_blocks")

    cell, parts = [*by, "l_block", "r_block"], n_parts(left.sparkSession)
    # The number of partitions is given: cells are small in bytes and long in work, and would be coalesced.
    return dealt(left, "l", "r", left_key).repartition(parts, *cell).groupBy(*cell).cogroup(
        dealt(right, "r", "l", right_key).repartition(parts, *cell).groupBy(*cell))


class WordHashes(dict):
    """64-bit hash of each word seen; forgets everything when it is full, so memory is bounded."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads nearby values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by doubling: O(log size) passes over the words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    out, done, width, power = None, 0, 1, words
    left = size
    while left:
        if left & 1:
            if out is None:
                out, done = power, width
            else:
                n = min(len(out), len(power) - done)
                out, done = mixed(out[:n] * MULTIPLIER + power[done:done + n]), done + width
        left >>= 1
        if left:
            n = len(power) - width
            power, width = mixed(power[:n] * MULTIPLIER + power[width:width + n]), width * 2
    return out[:len(words) - size + 1]
