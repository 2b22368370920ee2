"""A table of daily snapshots that changes by whole commits.

Layout under one path::

    data/batch=.../part-*            rows of a batch, ranged and sorted by date
    sources/batch=.../part-*         content hashes of the files a batch was read from
    manifest/part-*                  one file per commit: a row per date it replaces

A commit first writes its data and sources, which nobody sees yet, and then its manifest rows as a single file, which the
job commit publishes by one rename. Readers resolve every date through the manifest: the rows of a date, its log row and
the ledger of the files behind it appear together or not at all. A batch that died half-way is written again
under the same name and leaves the same table; one that is already published is left alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "batch string, version long, d date, row_count long, content_hash string, committed_at timestamp"


class Snapshots:
    """Daily snapshots under ``path``, replaced date by date."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """Every published (batch, date), the history of the table."""
        return self._read("manifest", MANIFEST)

    def log(self) -> DataFrame:
        """The newest published row of every date: batch, version, row_count (0: the date was emptied), hash, time."""
        newest = Window.partitionBy("d").orderBy(F.desc("version"), F.desc("batch"))
        return self.manifest().withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")

    def ledger(self) -> DataFrame:
        """``(sha256, path, batch)`` of the files behind published batches."""
        sources = self._read("sources", "sha256 string, path string, batch string")
        return sources.join(self.manifest().select("batch").distinct(), "batch", "left_semi").select("sha256", "path", "batch")

    def read(self) -> DataFrame:
        """The rows of every date as its newest commit has them. The batch is a partition column, so folders without a
        current date are pruned at run time; files are sorted by date."""
        current = self.log().where("row_count > 0").select("batch", "d")
        rows = self.spark.read.parquet(f"{self.path}/data").withColumn("batch", F.col("batch").cast("string"))
        return rows.join(current, ["batch", "d"], "left_semi").drop("batch")

    def prepare(self, df: DataFrame, batch: str, sources: DataFrame | None = None) -> None:
        """The first half of a commit: data and sources of an unpublished batch. Repeating it replaces them."""
        df.repartitionByRange("d").sortWithinPartitions("d").write.mode("overwrite").parquet(f"{self.path}/data/batch={batch}")
        if sources is not None:
            sources.select("sha256", "path").write.mode("overwrite").parquet(f"{self.path}/sources/batch={batch}")

    def publish(self, batch: str, dates: DataFrame | None = None) -> None:
        """The second half: counts and hashes of what has been written, as one manifest file. ``dates(d)`` adds dates the
        batch empties or finds empty, such as holidays."""
        rows = self.spark.read.parquet(f"{self.path}/data/batch={batch}")
        content = sorted(c for c in rows.columns if c != "d")
        # The sum of row hashes does not depend on the order of rows.
        per = rows.groupBy("d").agg(F.count("*").alias("row_count"), F.sum(F.xxhash64(*content).cast("decimal(38,0)")).cast("string").alias("content_hash"))
        if dates is not None:
            per = dates.select("d").distinct().join(per, "d", "full_outer").withColumns(
                {"row_count": F.coalesce("row_count", F.lit(0)), "content_hash": F.coalesce("content_hash", F.lit("0"))})
        version = self.manifest().agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first().v + 1
        per.select(F.lit(batch).alias("batch"), F.lit(version).cast("long").alias("version"), "d", "row_count", "content_hash",
                   F.current_timestamp().alias("committed_at")).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def published(self, batch: str) -> bool:
        return not self.manifest().where(F.col("batch") == batch).isEmpty()

    def commit(self, df: DataFrame, batch: str, dates: DataFrame | None = None, sources: DataFrame | None = None) -> bool:
        """Replaces the dates of ``df`` (and ``dates``); False if the batch had been published before. One writer at a
        time: of two at once, both are kept and the batch of the greater name wins where they share a date."""
        if self.published(batch):
            return False
        self.prepare(df, batch, sources)
        self.publish(batch, dates)
        return True

    def verify(self) -> DataFrame:
        """Dates whose rows are not what was published: ``(d, row_count, found, intact)``, broken ones only."""
        rows = self.read()
        content = sorted(c for c in rows.columns if c != "d")
        found = rows.groupBy("d").agg(F.count("*").alias("found"), F.sum(F.xxhash64(*content).cast("decimal(38,0)")).cast("string").alias("_hash"))
        checked = self.log().where("row_count > 0").join(found, "d", "left")
        intact = (F.col("found") == F.col("row_count")) & (F.col("_hash") == F.col("content_hash"))
        return checked.select("d", "row_count", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce(intact, F.lit(False)).alias("intact")).where("not intact")

    def obsolete(self) -> DataFrame:
        """Published batches none of whose dates is current: free to delete once no reader is on them."""
        return self.manifest().select("batch").distinct().join(self.log().select("batch"), "batch", "left_anti")
