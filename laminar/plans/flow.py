"""End-to-end plans: leaf rasters to result rows, photos to leaf metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import joins as J
from ..operators import measure as M
from ..operators import metrics as X
from ..operators import runs as R
from ..session import cut_lineage


def quick_fragments(layers: DataFrame, frames: DataFrame) -> DataFrame:
    """Leaf and damage area per leaf from tissue and class-1 layers.

    The region is the filled tissue; damage is class 1 plus enclosed holes.
    One overlay yields every count.
    """
    tissue, damage = R.pick(layers, "tissue"), R.pick(layers, "damage")
    holes = C.enclosed(tissue, frames)
    size = F.col("x1") - F.col("x0")
    cut = R.overlay({"t": tissue, "h": holes, "d": damage})
    return cut.groupBy("leaf_id").agg(
        F.sum(F.when(F.expr("t or h"), size).otherwise(0)).cast("long").alias("leaf_area_px"),
        F.sum(F.when(F.expr("h or (t and d)"), size).otherwise(0)).cast("long").alias("damage_px"),
    )


def results(fragments: DataFrame, scale_ref: DataFrame) -> DataFrame:
    """Fragment rows with an image name to the results table."""
    names = fragments.select("image_name").distinct()
    scale = J.lookup_scale(names, scale_ref)
    return M.rollup_images(M.with_cm2(fragments, scale))


def analyse(px: DataFrame, classes: DataFrame, tissue: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analysis per fragment: fragments, edge filter, metrics.

    ``classes`` is a pixel class map.  Returns metric rows with ``leaf_id``
    and ``frag``, and the damage layer of each fragment.
    """
    frag = C.split_fragments(tissue, frames)
    key = F.concat_ws("#", F.hex(F.encode(F.col("leaf_id").cast("string"), "UTF-8")), F.col("frag").cast("string"))
    parts = cut_lineage(frag.select(key.alias("leaf_id"), F.col("leaf_id").alias("_leaf"), "frag", *R.SPAN))
    names = cut_lineage(parts.select("leaf_id", "_leaf", "frag").distinct())
    ids = names.drop("frag")
    fr = frames.withColumnRenamed("leaf_id", "_leaf").join(ids, "_leaf").select("leaf_id", "h", "w")
    cleaned, _ = X.filter_edge_artifacts(classes, tissue, frames)
    runs = R.to_runs(cleaned.where("cls <> 0"), keys=("leaf_id", "cls"))
    cls = runs.withColumnRenamed("leaf_id", "_leaf").join(ids, "_leaf").select("leaf_id", "cls", *R.SPAN)
    px_f = px.withColumnRenamed("leaf_id", "_leaf").join(ids, "_leaf").drop("_leaf")
    part = parts.drop("_leaf", "frag")
    roi = C.fill_holes(part, fr)
    rows, layer = X.leaf_metrics(px_f, cls, part, roi, fr)

    def named(df: DataFrame) -> DataFrame:
        return df.join(names, "leaf_id").drop("leaf_id").withColumnRenamed("_leaf", "leaf_id")

    return named(rows), named(layer)
