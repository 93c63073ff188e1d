"""Training-corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminar.llm.decontam import find_passages
from laminar.llm.importance import resample
from laminar.llm.lines import drop_duplicate_lines
from laminar.llm.minhash import near_duplicates
from laminar.llm.packing import pack_sidecars
from laminar.llm.queries import held_out_leaves, reviews, vocabulary
from laminar.llm.store import stored
from laminar.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TO_SIDECAR = {"doc_id": "image_id", "text": "meta_text"}
TO_DOCUMENT = {v: k for k, v in TO_SIDECAR.items()}


def _sidecars(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed(TO_SIDECAR)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose id is not in ``gone``; those without an id stay."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go."""
    drawn = resample(_sidecars(docs), reviews(spark, sf_dir))
    gone = drawn.groupBy(F.col("image_id").alias("doc_id")).agg(F.max("chosen").alias("chosen")).where("not chosen")
    return _without(docs, gone)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so do documents of which no line is left."""
    left = drop_duplicate_lines(_sidecars(docs)).where("n_dropped = 0 or n_dropped < n_lines")
    texts = left.withColumnsRenamed(TO_DOCUMENT)
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
    return texts.withColumn("n_chars", F.coalesce(changed, "n_chars")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    grouped = near_duplicates(_sidecars(docs))
    return _without(docs, grouped.where("not kept").withColumnRenamed("image_id", "doc_id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark text go."""
    found = find_passages(_sidecars(docs), held_out_leaves(spark, sf_dir))
    return found.where("size(spans) = 0").withColumnsRenamed(TO_DOCUMENT).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left with their places in training sequences."""
    return pack_sidecars(_sidecars(docs), vocabulary()).withColumnRenamed("image_id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: Language models, signatures and packing have no SQL form; tests/llm compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
