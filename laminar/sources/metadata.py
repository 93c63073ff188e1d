"""Segmentation metadata, manual calibration and scale maps from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import stem

SEG_META_SCHEMA = """image_id string, parent_image_id string, leaf_index int, original_size array<int>,
 output_size array<int>, scale_factor double, scale_source string, pre_ratio array<double>, crop_bbox array<int>,
 letterbox_offset array<int>,
 circle struct<found:boolean,center_px:array<double>,diameter_px:double,area_px:double,circularity:double,
  bbox:array<int>,method:string,score:double,low_confidence:boolean,mm_per_px:double,mm2_per_px2:double>,
 leaf struct<silhouette_area_px:bigint,remaining_leaf_area_px:bigint,damage_area_px:bigint,damage_percent:double>,
 segmentation struct<hybrid_mode:string,iou_models:double,low_confidence:boolean,fallback_used:string>,
 _corrupt_record string"""


def parse_seg_meta(text: Column | str) -> Column:
    """One JSON document to a struct; bad documents become ``_corrupt_record``."""
    return F.from_json(text, SEG_META_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def usable_meta(parsed: DataFrame) -> DataFrame:
    """Defaults for optional fields; unreadable documents are left out."""
    return (
        parsed.where("_corrupt_record is null")
        .withColumn("scale_source", F.coalesce("scale_source", F.lit("original_photo")))
        .withColumn("pre_scale", F.coalesce(F.try_element_at("pre_ratio", F.lit(1)), F.lit(1.0)))
    )


def read_seg_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata files of a folder; the file name stands in for a missing id."""
    raw = (
        spark.read.schema(SEG_META_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(folder)
        .withColumn("_file", stem(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)))
    )
    return usable_meta(raw.withColumn("image_id", F.coalesce("image_id", "_file"))).drop("_file", "_corrupt_record")


def _entries(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def parse_overrides(docs: DataFrame, text: str = "value") -> DataFrame:
    """``{image_id: {center_px, diameter_px}}`` documents to rows."""
    rows = docs.select(F.explode(_entries(F.col(text))).alias("image_id", "_v"))
    spec = F.from_json("_v", "center_px array<double>, diameter_px string, method string")
    return rows.select(
        "image_id",
        F.try_element_at(spec["center_px"], F.lit(1)).alias("cx"),
        F.try_element_at(spec["center_px"], F.lit(2)).alias("cy"),
        F.coalesce(spec["diameter_px"].try_cast("double"), F.lit(0.0)).alias("diameter_px"),
    )


def parse_scale_ref(docs: DataFrame, text: str = "value") -> DataFrame:
    """``{name: cm2_per_px2}`` documents to rows; nested objects are skipped."""
    rows = docs.select(F.explode(_entries(F.col(text))).alias("ref_key", "_v"))
    return rows.select("ref_key", F.col("_v").try_cast("double").alias("cm2_per_px2")).where(
        "cm2_per_px2 is not null"
    )


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return parse_overrides(spark.read.text(path, wholetext=True))


def read_scale_ref(spark: SparkSession, path: str) -> DataFrame:
    return parse_scale_ref(spark.read.text(path, wholetext=True))
