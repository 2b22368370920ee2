"""Keyed upserts and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], preserve: Sequence[str] = (), protect: Sequence[str] = (),
           placeholder: dict[str, Column] | None = None, order: str | None = None) -> DataFrame:
    """The table after applying ``delta``.

    Matched rows take the new values, except: ``preserve`` columns keep the old value when the new one
    is NULL; ``protect`` columns belong to another job and always keep the old value; a ``placeholder``
    condition (over the new row) marks values that never replace a real one. Within ``delta`` the row
    greatest in ``order`` wins."""
    if order:
        newest = Window.partitionBy(*keys).orderBy(F.desc(order))
        delta = delta.withColumn("_k", F.row_number().over(newest)).filter("_k = 1").drop("_k")
    placeholder = placeholder or {}
    columns = [c for c in base.columns if c not in keys]
    new = delta.select(*keys, F.struct(*[c for c in columns if c in delta.columns]).alias("_n"), *[cond.alias(f"_ph_{c}") for c, cond in placeholder.items()])
    old = base.select(*keys, F.struct(*columns).alias("_o"))
    j = old.join(new, list(keys), "full_outer")
    has_new, has_old = F.col("_n").isNotNull(), F.col("_o").isNotNull()
    out: list[Column] = []
    for c in columns:
        before = F.col(f"_o.{c}")
        if c not in delta.columns or c in protect:
            after = F.when(has_old, before).otherwise(F.col(f"_n.{c}")) if c in delta.columns else before
        else:
            fresh = F.col(f"_n.{c}")
            after = F.when(~has_new, before)
            if c in placeholder:
                after = after.when(F.col(f"_ph_{c}") & before.isNotNull(), before)
            after = after.otherwise(F.coalesce(fresh, before) if c in preserve else fresh)
        out.append(after.alias(c))
    return j.select(*keys, *out)


def replace_partitions(df: DataFrame, path: str, by: str = "d") -> None:
    """Replace exactly the dates that occur in ``df``, atomically per job commit; other dates stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


def write_bars(df: DataFrame, path: str) -> None:
    """Bar layout: partitioned by year, clustered and sorted by symbol inside files, so that filters on
    date prune folders and filters on symbol prune row groups."""
    (df.withColumn("year", F.year("d")).repartition("year", "sym").sortWithinPartitions("sym", "d")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path))


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str | Sequence[str] = "sym", path: str | None = None) -> None:
    """A table, one file a bucket, whose windows and joins over ``key`` need no exchange. Bucketed by symbol alone it serves
    per-symbol windows; joins by (symbol, date) want both in the key, which also spreads a symbol over all buckets. ``path``
    keeps the files outside of the warehouse."""
    keys = [key] if isinstance(key, str) else list(key)
    out = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*dict.fromkeys([*keys, "d"]))
    (out.option("path", path) if path else out).saveAsTable(table)


BOM = "﻿"


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV that opens in spreadsheets: every file starts with a byte order mark, carried by the
    first header name, and a quote inside a value is doubled."""
    first = df.columns[0]
    out = df.select(*[F.col(c).cast("string") for c in df.columns]).withColumnRenamed(first, BOM + first)
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
