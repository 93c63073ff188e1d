"""Connected components of run tables, and what is built on them.

Labelling has two levels.  Inside a band of scan lines (at most
``BAND_ROWS`` high, so at most one canvas of runs) touching runs are linked
in vectorised batches; a band never depends on how large the collection or
one picture is.  Labels that meet across band borders form a small edge
table, which a DataFrame loop contracts.  The loop is skipped when no leaf
is taller than one band.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import cut_lineage, ship
from .runs import SPAN, combine, keys_of, mask_not, merge

BAND_ROWS = 1024
STRIDE = 1 << 21  # component ids are y * STRIDE + x of the first pixel


def _link(codes: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """Index of the first run of each run's component; rows sorted by
    (group, y, x0).  ``reach`` is 1 for 8-connectivity and 0 for 4."""
    n = len(y)
    line = codes * np.int64(BAND_ROWS + 2) + y
    span = np.int64(1) << 22
    starts, ends = line * span + x0, line * span + x1
    above = (line - 1) * span
    # runs of the previous line overlapping [x0 - reach, x1 + reach)
    lo = np.searchsorted(ends, above + x0 - reach, side="right")
    hi = np.searchsorted(starts, above + x1 + reach, side="left")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        while True:
            jump = nxt[nxt]
            if np.array_equal(jump, nxt):
                break
            nxt = jump
        root = nxt
        alive = root[a] != root[b]
        a, b = a[alive], b[alive]
    return root


def _changes(pdf: pd.DataFrame, group: list[str]) -> np.ndarray:
    """Where a new group begins after the first row; nulls equal nulls."""
    change = np.zeros(len(pdf), dtype=bool)
    for c in group:
        v, gone = pdf[c].to_numpy(), pdf[c].isna().to_numpy()
        change[1:] |= (v[1:] != v[:-1]) & ~(gone[1:] & gone[:-1])
    return change


def _label_batches(batches: Iterator[pd.DataFrame], keys: list[str], reach: int) -> Iterator[pd.DataFrame]:
    """Label sorted runs batch by batch; the unfinished last group waits."""
    group = [*keys, "_band"]
    held: list[pd.DataFrame] = []

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        change = _changes(pdf, group)
        codes = np.cumsum(change).astype(np.int64)
        y = pdf["y"].to_numpy(np.int64)
        x0 = pdf["x0"].to_numpy(np.int64)
        first = np.maximum.accumulate(np.where(np.r_[True, change[1:]], np.arange(len(pdf)), 0))
        rel = y - (y[first] // BAND_ROWS) * BAND_ROWS + 1
        root = _link(codes, rel, x0, pdf["x1"].to_numpy(np.int64), reach)
        return pdf.drop(columns="_band").assign(comp=y[root] * STRIDE + x0[root])

    for pdf in batches:
        if not len(pdf):
            continue
        joint = pd.concat([held[-1].iloc[-1:], pdf.iloc[:1]]) if held else pdf.iloc[:1]
        if not _changes(joint, group).any() and not _changes(pdf, group).any():
            held.append(pdf)
            continue
        whole = pd.concat([*held, pdf], ignore_index=True)
        cut = int(np.flatnonzero(_changes(whole, group))[-1])
        yield label(whole.iloc[:cut].reset_index(drop=True))
        held = [whole.iloc[cut:].reset_index(drop=True)]
    if held:
        yield label(pd.concat(held, ignore_index=True))


def _contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest reachable label per label over a (keys, a, b) edge table.

    Each round lowers every label to the smallest neighbour's and then jumps
    to that label's own parent; rounds grow with the logarithm of the longest
    chain of bands.
    """
    both = cut_lineage(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parent = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("p"))
    parent = cut_lineage(parent)
    while True:
        near = (
            both.join(parent.select(*keys, F.col("a").alias("b"), F.col("p").alias("_q")), [*keys, "b"])
            .groupBy(*keys, "a")
            .agg(F.min("_q").alias("_q"))
        )
        low = parent.join(near, [*keys, "a"]).select(*keys, "a", F.least("p", "_q").alias("_n"), "p")
        hop = low.select(*keys, F.col("a").alias("_n"), F.col("_n").alias("_nn"))
        nxt = cut_lineage(
            low.join(hop, [*keys, "_n"], "left").select(
                *keys, "a", F.least("_n", "_nn").alias("p"), F.col("p").alias("_old")
            )
        )
        moved = nxt.where("p <> _old").limit(1).count()
        parent = nxt.drop("_old")
        if not moved:
            return parent


def components(runs: DataFrame, conn: int = 8) -> DataFrame:
    """Runs with a ``comp`` column: the scan-order code of the component's
    first pixel, so ids are stable and ordered as a raster scan meets them.

    The labelled runs are checkpointed once, so everything above reads them
    instead of labelling again.  Bands are joined up only if some picture
    is taller than one.
    """
    ship(runs.sparkSession)
    reach = 1 if conn == 8 else 0
    keys = keys_of(runs)
    wide = F.greatest(F.abs("x0"), F.abs("x1")) >= STRIDE
    checked = F.when(wide, F.raise_error(F.lit(f"picture wider than {STRIDE} pixels"))).otherwise(F.col("x0"))
    banded = runs.select(*keys, "y", checked.cast(runs.schema["x0"].dataType).alias("x0"), "x1", F.expr(f"cast(y div {BAND_ROWS} as int)").alias("_band"))
    schema = T.StructType([f for f in runs.select(*keys, *SPAN).schema.fields] + [T.StructField("comp", T.LongType())])
    local = cut_lineage(
        banded.repartition(*keys, "_band")
        .sortWithinPartitions(*keys, "_band", "y", "x0")
        .mapInPandas(lambda it: _label_batches(it, keys, reach), schema)
    )
    if local.where(f"y >= {BAND_ROWS} or y < 0").isEmpty():
        return local
    edge_rows = local.where(F.expr(f"y % {BAND_ROWS} in (0, {BAND_ROWS - 1})"))
    upper = edge_rows.where(F.expr(f"y % {BAND_ROWS} = {BAND_ROWS - 1}")).select(
        *keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("comp").alias("b")
    )
    lower = edge_rows.where(F.expr(f"y % {BAND_ROWS} = 0 and y > 0")).select(*keys, *SPAN, F.col("comp").alias("a"))
    edges = (
        lower.join(upper, [*keys, "y"])
        .where(f"x0 < u1 + {reach} and u0 < x1 + {reach}")
        .select(*keys, "a", "b")
        .distinct()
    )
    edges = cut_lineage(edges)
    if edges.limit(1).count() == 0:
        return local
    parent = _contract(edges, keys).select(*keys, F.col("a").alias("comp"), F.col("p").alias("_p"))
    return local.join(parent, [*keys, "comp"], "left").select(
        *keys, *SPAN, F.coalesce("_p", "comp").alias("comp")
    )


def component_stats(comp: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Area, box, centroid and border contact per component."""
    keys = keys_of(comp)
    n = (F.col("x1") - F.col("x0")).cast("long")
    out = comp.groupBy(*keys).agg(
        F.sum(n).cast("long").alias("area"),
        F.min("x0").alias("bx0"),
        F.min("y").alias("by0"),
        F.max("x1").alias("bx1"),
        (F.max("y") + 1).alias("by1"),
        (F.sum(n * (F.col("x0") + F.col("x1") - 1)) / 2 / F.sum(n)).alias("cx"),
        (F.sum(n * F.col("y")) / F.sum(n)).alias("cy"),
    )
    if frames is not None:
        fkeys = [c for c in frames.columns if c not in ("h", "w")]
        out = (
            out.join(frames, fkeys)
            .withColumn("touches_border", F.expr("bx0 <= 0 or by0 <= 0 or bx1 >= w or by1 >= h"))
            .drop("h", "w")
        )
    return out


def _leaf_keys(comp: DataFrame) -> list[str]:
    return [k for k in keys_of(comp) if k != "comp"]


def keep(comp: DataFrame, chosen: DataFrame) -> DataFrame:
    """Runs of the chosen components, as a mask again."""
    keys = _leaf_keys(comp)
    return comp.join(chosen.select(*keys, "comp"), [*keys, "comp"], "left_semi").select(*keys, *SPAN)


def first_by(stats: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key in the given order, by map-side aggregation.

    ``min(struct(...))`` combines before the shuffle, so a leaf with millions
    of components is still reduced in parallel.
    """
    rest = [c for c in stats.columns if c not in keys]
    ranked = stats.groupBy(*keys).agg(
        F.min(
            F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])
        ).alias("_s")
    )
    return ranked.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def largest_stats(stats: DataFrame) -> DataFrame:
    keys = [c for c in stats.columns if c not in ("comp", "area", "bx0", "by0", "bx1", "by1", "cx", "cy", "touches_border")]
    return first_by(stats, keys, -F.col("area"), F.col("comp"))


def largest(runs: DataFrame) -> DataFrame:
    """The largest 8-connected component per leaf (the first one on ties)."""
    return largest_of(components(runs, 8))


def largest_of(comp: DataFrame) -> DataFrame:
    """The largest of labelled components per leaf, as a mask."""
    keys = _leaf_keys(comp)
    sizes = comp.groupBy(*keys, "comp").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    return keep(comp, first_by(sizes, keys, -F.col("area"), F.col("comp")))


def component_at(
    runs: DataFrame, points: DataFrame, fallback: str = "largest"
) -> DataFrame:
    """The component under a point ``(keys, px, py)``.

    A point on the background falls back to the ``largest`` component, to
    the ``nearest`` one by pixel distance, or to an ``empty`` mask.
    """
    comp = components(runs, 8)
    keys = _leaf_keys(comp)
    at = comp.join(points, keys)
    # distance of the point to the closest pixel of a run
    dx = F.greatest(F.col("x0") - F.col("px"), F.col("px") - F.col("x1") + 1, F.lit(0)).cast("long")
    dy = (F.col("y") - F.col("py")).cast("long")
    dist = at.groupBy(*keys, "comp").agg(
        F.min(F.struct((dx * dx + dy * dy).alias("d"), F.col("y"), F.greatest("x0", F.least(F.col("px"), F.col("x1") - 1)).alias("x"))).alias("_n"),
        F.sum(F.col("x1") - F.col("x0")).alias("area"),
    )
    if fallback == "nearest":
        order = [F.col("_n")]
    else:
        order = [F.when(F.col("_n.d") == 0, 0).otherwise(1), -F.col("area"), F.col("comp")]
    best = first_by(dist, keys, *order)
    if fallback == "empty":
        best = best.where("_n.d = 0")
    return keep(comp, best)


def filter_components(
    runs: DataFrame,
    min_area: int | Column = 0,
    max_area: int | None = None,
    conn: int = 8,
    fallback_largest: bool = False,
) -> DataFrame:
    """Drop components outside an area range; optionally keep the largest
    when nothing qualifies."""
    comp = components(runs, conn)
    keys = _leaf_keys(comp)
    sizes = comp.groupBy(*keys, "comp").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
    ok = F.col("area") >= min_area
    if max_area is not None:
        ok = ok & (F.col("area") <= max_area)
    if not fallback_largest:
        return keep(comp, sizes.where(ok))
    best = sizes.groupBy(*keys).agg(
        F.max(ok.cast("int")).alias("_any"), F.max(F.struct("area", -F.col("comp"))).alias("_b")
    )
    chosen = sizes.join(best, keys).where(
        ((F.col("_any") == 1) & ok) | ((F.col("_any") == 0) & (F.col("comp") == -F.col("_b.col2")))
    )
    return keep(comp, chosen)


def remove_small(runs: DataFrame, frames: DataFrame, ratio: float = 0.002, floor: int = 80):
    """Drop components below ``max(floor, ratio * h * w)``; if nothing is left
    keep the largest."""
    fkeys = [c for c in frames.columns if c not in ("h", "w")]
    comp = components(runs, 8)
    keys = _leaf_keys(comp)
    sizes = (
        comp.groupBy(*keys, "comp")
        .agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
        .join(frames, fkeys)
        .withColumn("_ok", F.col("area") >= min_area_floor(ratio, floor))
    )
    best = sizes.groupBy(*keys).agg(F.max("_ok").alias("_any"), F.max(F.struct("area", -F.col("comp"))).alias("_b"))
    chosen = sizes.join(best, keys).where("(_any and _ok) or (not _any and comp = -_b.col2)")
    return keep(comp, chosen)


def min_area_floor(ratio: float = 0.002, floor: int = 80) -> Column:
    return F.greatest(F.lit(floor), F.floor(F.col("h") * F.col("w") * ratio).cast("int"))


def leaf_instances(
    runs: DataFrame, min_area: int = 5000, max_leaves: int | None = None
) -> DataFrame:
    """Number the leaves of a photo.

    Components below ``min_area`` go, the ``max_leaves`` largest stay, and
    the rest are counted left to right, then top to bottom, by rounded
    centroid.  Ranking runs over component rows, never over pixels.
    """
    comp = components(runs, 8)
    stats = component_stats(comp).where(F.col("area") >= min_area)
    keys = _leaf_keys(comp)
    if max_leaves:
        by_size = W.partitionBy(*keys).orderBy(F.desc("area"), "comp")
        stats = stats.withColumn("_r", F.row_number().over(by_size)).where(F.col("_r") <= max_leaves).drop("_r")
    stats = stats.withColumn("rx", F.rint("cx").cast("int")).withColumn("ry", F.rint("cy").cast("int"))
    place = W.partitionBy(*keys).orderBy("rx", "ry", "comp")
    return stats.withColumn("leaf_index", F.row_number().over(place))


def split_fragments(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Tissue fragments, largest first, as runs with a ``frag`` number; a
    leaf without a large enough piece stays whole."""
    fkeys = [c for c in frames.columns if c not in ("h", "w")]
    comp = components(runs, 8)
    keys = _leaf_keys(comp)
    sizes = (
        comp.groupBy(*keys, "comp")
        .agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))
        .join(frames, fkeys)
        .where(F.col("area") >= min_area_floor())
    )
    order = W.partitionBy(*keys).orderBy(F.desc("area"), "comp")
    numbered = sizes.select(*keys, "comp", F.row_number().over(order).alias("frag"))
    split = comp.join(numbered, [*keys, "comp"]).select(*keys, "frag", *SPAN)
    whole = runs.join(numbered.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit(1).alias("frag"), *SPAN
    )
    return split.unionByName(whole)


def enclosed(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Background enclosed by the mask (4-connected, not touching the rim)."""
    fkeys = [c for c in frames.columns if c not in ("h", "w")]
    gaps = mask_not(runs, frames)
    comp = components(gaps, 4)
    keys = _leaf_keys(comp)
    open_comp = (
        comp.join(frames, fkeys)
        .groupBy(*keys, "comp")
        .agg(F.max(F.expr("x0 <= 0 or y <= 0 or x1 >= w or y >= h - 1")).alias("_open"))
        .where("not _open")
    )
    return keep(comp, open_comp)


def fill_holes(runs: DataFrame, frames: DataFrame) -> DataFrame:
    return merge(runs.unionByName(enclosed(runs, frames).select(*runs.columns)))


def internal_holes(tissue: DataFrame, roi: DataFrame, frames: DataFrame) -> DataFrame:
    """Enclosed background of the tissue that lies inside the region."""
    return combine({"_h": enclosed(tissue, frames), "_r": roi}, "_h and _r")


def centroid_of_largest(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Truncated centroid of the largest component; picture centre if empty."""
    comp = components(runs, 8)
    keys = _leaf_keys(comp)
    best = first_by(component_stats(comp), keys, -F.col("area"), F.col("comp"))
    return frames.join(best, keys, "left").select(
        *keys,
        F.coalesce(F.floor("cx"), F.floor(F.col("w") / 2)).cast("int").alias("cx"),
        F.coalesce(F.floor("cy"), F.floor(F.col("h") / 2)).cast("int").alias("cy"),
    )


def drop_islands(mask: DataFrame, partial: DataFrame, frames: DataFrame) -> DataFrame:
    """Keep added pieces only where they touch the partial mask."""
    from .runs import dilate_square

    added = combine({"_m": mask, "_p": partial}, "_m and not _p")
    comp = components(added, 8)
    keys = _leaf_keys(comp)
    touch = dilate_square(partial, 3, frames)
    met = (
        comp.join(touch.select(*keys, "y", F.col("x0").alias("t0"), F.col("x1").alias("t1")), [*keys, "y"])
        .where("x0 < t1 and t0 < x1")
        .select(*keys, "comp")
        .distinct()
    )
    return merge(partial.unionByName(keep(comp, met)))
