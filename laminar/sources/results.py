"""Result tables and measurement exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import photo_number

RESULT_FIELDS = ("leaf_area_px", "damage_px", "damage_pct", "leaf_area_cm2", "damage_cm2")
PCT_FIELDS = ("image_name", "leaf_area_px", "damage_px", "undamaged_px", "damage_pct", "undamaged_pct")
CM2_FIELDS = ("scale_cm2_per_px", "leaf_area_cm2", "damage_cm2", "undamaged_cm2")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results CSV with either column set; absent columns come back null."""
    raw = spark.read.option("header", True).csv(path)
    have = set(raw.columns)
    return raw.where("trim(image_name) <> ''").select(
        F.trim("image_name").alias("image_name"),
        *[
            (F.col(c).try_cast("double") if c in have else F.lit(None).cast("double")).alias(c)
            for c in RESULT_FIELDS
        ],
    )


def write_results(results: DataFrame, path: str) -> None:
    """Results CSV ordered by leading photo number, then name."""
    number = photo_number("image_name")
    results.orderBy(number.asc_nulls_last(), "image_name").write.mode("overwrite").option("header", True).csv(path)


def write_measurements(rows: DataFrame, path: str, include_cm2: bool = False) -> None:
    """Measurement export: comma for csv, tab for txt; an empty one is refused."""
    if rows.limit(1).count() == 0:
        raise ValueError("no measurement rows to export")
    fields = PCT_FIELDS + (CM2_FIELDS if include_cm2 else ())
    have = set(rows.columns)
    sep = "\t" if path.rstrip("/").lower().endswith(".txt") else ","
    rows.orderBy("image_name").select(
        *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in fields]
    ).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def save_table(df: DataFrame, path: str, keys=("leaf_id",), files: int | None = None) -> None:
    """Parquet laid out by leaf: clustered and sorted, so a leaf is read from
    few row groups."""
    by = [*keys]
    laid = df.repartition(files, *by) if files else df.repartition(*by)
    sort = [c for c in (*by, "layer", "y", "x0", "x", "i") if c in df.columns]
    laid.sortWithinPartitions(*sort).write.mode("overwrite").parquet(path)


def save_bucketed(df: DataFrame, name: str, buckets: int, key: str = "leaf_id") -> None:
    """Table bucketed by leaf: later joins on the leaf need no shuffle."""
    sort = [c for c in (key, "y", "x0", "x") if c in df.columns]
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(*sort).saveAsTable(name)
