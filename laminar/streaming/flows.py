"""Photos and edits as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import canonical_leaf_id, stem
from ..operators.measure import upsert_results


def stream_photos(spark: SparkSession, folder: str) -> DataFrame:
    """New photo files of a folder (listing columns only)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return raw.select("path", "modificationTime", "length", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))


def dedupe_stream(photos: DataFrame, time: str = "modificationTime", late: str = "1 day") -> DataFrame:
    """First arrival of every leaf within the watermark."""
    keyed = photos.withColumn("leaf_id", canonical_leaf_id(stem("name")))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["leaf_id"])


def edits_per_hour(edits: DataFrame, late: str = "1 hour") -> DataFrame:
    """Edits per image and hour."""
    return (
        edits.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "image_name")
        .agg(F.count("*").alias("n_edits"))
        .select(F.col("window.start").alias("hour"), "image_name", "n_edits")
    )


def stream_upsert(
    edits: DataFrame, read: Callable[[int], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str
):
    """Fold each batch of edits into the stored results.

    ``read`` receives the batch number and returns the newest stored version
    below it; ``write`` stores the new version under the number.  Both work
    on storage, so a restarted stream goes on where it stopped and a batch
    that is repeated is applied to the same version again.  Results that keep
    ``last_seq`` take no older edit, whatever batch it arrives in.
    """

    def apply(batch: DataFrame, number: int) -> None:
        write(upsert_results(read(number), batch), number)

    return (
        edits.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class VersionedResults:
    """Versions of a results table below one folder, one per batch."""

    def __init__(self, spark: SparkSession, folder: str, first: DataFrame):
        self.spark, self.folder, self.first = spark, folder.rstrip("/"), first

    def _numbers(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        done = [n for n in names if n.startswith("batch-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(int(n.removeprefix("batch-")) for n in done)

    def read(self, below: int | None = None) -> DataFrame:
        """Newest version, or the newest one older than a batch."""
        known = [n for n in self._numbers() if below is None or n < below]
        return self.spark.read.parquet(f"{self.folder}/batch-{known[-1]}") if known else self.first

    def write(self, results: DataFrame, number: int) -> None:
        results.write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
