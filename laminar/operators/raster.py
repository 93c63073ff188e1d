"""Pixel statistics: medians, box means, thresholds, balance, depth, resizing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import colour as K
from ..session import cut_lineage, ship
from .runs import SPAN, combine, dilate, disk_kernel, keys_of, mask_not, merge, to_runs


def settle(df: DataFrame) -> DataFrame:
    """Compute the row's expressions once.

    Unfolding a one-element array keeps the optimiser from copying long
    colour formulas into every filter that mentions their result, which
    would outgrow a generated method.  ``leaf_id`` stays outside, so rows
    spread by leaf remain so.
    """
    kept = [c for c in df.columns if c == "leaf_id"]
    rest = [c for c in df.columns if c != "leaf_id"]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*rest)))).select(*df.columns)


def with_hsv(px: DataFrame) -> DataFrame:
    return settle(px.withColumns(K.hsv_columns()))


def with_lab(px: DataFrame) -> DataFrame:
    return settle(px.withColumns(K.lab_columns()))


def paper_colour(px: DataFrame, frames: DataFrame, frac: float = 0.08) -> DataFrame:
    """Median colour of the four border strips (corners count twice).

    The percentile buffers hold counts of at most 256 values, so partial
    aggregation keeps every leaf small whatever its size.
    """
    bw = F.greatest(F.lit(4), F.floor(F.least("h", "w") * frac))
    times = (
        (F.col("y") < bw).cast("int") + (F.col("y") >= F.col("h") - bw).cast("int")
        + (F.col("x") < bw).cast("int") + (F.col("x") >= F.col("w") - bw).cast("int")
    )
    strip = px.join(frames, "leaf_id").withColumn("_t", times).where("_t > 0")
    return strip.groupBy("leaf_id").agg(
        *[F.percentile(c, F.lit(0.5), F.col("_t")).alias(f"paper_{c}") for c in "rgb"]
    )


def box_sum(px: DataFrame, frames: DataFrame, col: str, n: int, name: str = "box_sum", keep: Sequence[str] = ()) -> DataFrame:
    """Sum of ``col`` over the n x n window around every pixel.

    Borders reflect without repeating the edge.  Rows first, then columns:
    each pass groups one scan line, never a whole leaf.  Columns named in
    ``keep`` travel with their pixel, which saves joining the sums back.
    """
    r = n // 2
    keep = list(keep)
    base = px.select("leaf_id", "y", "x", F.col(col).cast("long").alias("_v"), *keep).join(
        frames.select("leaf_id", F.col("h").alias("_h"), F.col("w").alias("_w")), "leaf_id"
    )

    def padded(df: DataFrame, axis: str, size: str) -> DataFrame:
        # a pixel appears at its own place and at its reflections beyond the edge
        spots = F.array_compact(
            F.array(
                F.col(axis),
                F.when((F.col(axis) >= 1) & (F.col(axis) <= r), -F.col(axis)),
                F.when(
                    (F.col(axis) <= F.col(size) - 2) & (F.col(axis) >= F.col(size) - 1 - r),
                    2 * (F.col(size) - 1) - F.col(axis),
                ),
            )
        )
        return df.withColumn(axis, F.explode(spots))

    row = W.partitionBy("leaf_id", "y").orderBy("x").rowsBetween(-r, r)
    across = padded(base, "x", "_w").select("leaf_id", "y", "x", F.sum("_v").over(row).alias("_v"), "_h", "_w", *keep).where(
        "x >= 0 and x < _w"
    )
    column = W.partitionBy("leaf_id", "x").orderBy("y").rowsBetween(-r, r)
    return (
        padded(across, "y", "_h")
        .select("leaf_id", "y", "x", F.sum("_v").over(column).alias(name), "_h", *keep)
        .where("y >= 0 and y < _h")
        .drop("_h")
    )


def box_mean(px: DataFrame, frames: DataFrame, col: str, n: int, name: str = "box_mean") -> DataFrame:
    out = box_sum(px, frames, col, n, "_s")
    return out.select("leaf_id", "y", "x", (F.col("_s") / (n * n)).alias(name))


def histogram(px: DataFrame, col: str | Column, keys: Sequence[str] = ("leaf_id",)) -> DataFrame:
    c = F.col(col) if isinstance(col, str) else col
    return px.groupBy(*keys, c.alias("v")).agg(F.count("*").alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """Threshold with the largest between-class variance (lowest on ties).

    Works on at most 256 histogram rows per leaf.
    """
    keys = [c for c in hist.columns if c not in ("v", "n")]
    upto = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys).orderBy("v").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = hist.select(
        *keys, "v",
        F.sum("n").over(upto).alias("_n1"), F.sum(F.col("n") * F.col("v")).over(upto).alias("_s1"),
        F.sum("n").over(whole).alias("_n"), F.sum(F.col("n") * F.col("v")).over(whole).alias("_s"),
    )
    gap = (F.col("_s") * F.col("_n1") - F.col("_n") * F.col("_s1")).cast("double")
    score = F.when(F.col("_n1") < F.col("_n"), gap * gap / (F.col("_n1") * (F.col("_n") - F.col("_n1")))).otherwise(-1.0)
    return c.groupBy(*keys).agg(
        F.min_by("v", F.struct(-score, F.col("v"))).cast("int").alias("otsu"), F.max(score).alias("_best")
    ).select(*keys, F.when(F.col("_best") <= 0, 0).otherwise(F.col("otsu")).cast("int").alias("otsu"))


def pct(px: DataFrame, col: str | Column, q: float, name: str = "pct", keys: Sequence[str] = ("leaf_id",)) -> DataFrame:
    """Exact interpolated percentile per leaf, pre-counted by value."""
    c = F.col(col) if isinstance(col, str) else col
    return histogram(px, c, keys).groupBy(*keys).agg(F.percentile("v", F.lit(q), F.col("n")).alias(name))


def leaf_levels(px: DataFrame, percentile: tuple[str, float], mean: str, split: str) -> DataFrame:
    """``pct`` of one column, average of another and ``otsu`` of a third, in one pass over the pixels.

    Returns ``leaf_id, pct, mean, otsu``; all three whole-number columns are counted by value together.
    """
    kinds = [F.struct(F.lit(i).alias("kind"), F.col(c).alias("v")) for i, c in enumerate((percentile[0], mean, split))]
    counted = px.select("leaf_id", F.explode(F.array(*kinds)).alias("_k")).groupBy("leaf_id", "_k.kind", "_k.v").agg(F.count("*").alias("n"))
    of = lambda i, c: F.when(F.col("kind") == i, F.col(c))
    levels = cut_lineage(
        counted.groupBy("leaf_id").agg(
            F.percentile(of(0, "v"), F.lit(percentile[1]), F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("pct"),
            (F.sum(of(1, "v") * F.col("n")) / F.sum(of(1, "n"))).alias("mean"),
            F.collect_list(F.when(F.col("kind") == 2, F.struct("v", "n"))).alias("_hist"),
        )
    )
    cut = otsu(levels.select("leaf_id", F.inline("_hist")))
    return levels.select("leaf_id", "pct", "mean").join(cut, "leaf_id")


def gray_world(px: DataFrame) -> DataFrame:
    """Scale every channel so that its mean meets the common grey mean."""
    means = px.groupBy("leaf_id").agg(*[F.avg(c).alias(f"_m{c}") for c in "rgb"]).hint("shuffle_hash")
    grey = (F.col("_mb") + F.col("_mg") + F.col("_mr")) / 3.0
    j = px.join(means, "leaf_id")
    fixed = {
        c: F.floor(F.least(F.greatest(F.col(c) * (grey / (F.col(f"_m{c}") + 1e-6)), F.lit(0.0)), F.lit(255.0))).cast("int")
        for c in "rgb"
    }
    return j.withColumns(fixed).drop("_mr", "_mg", "_mb")


def normalise_bg(px: DataFrame, frames: DataFrame, near: float = 42.0, bright: int = 200, sat: int = 55,
                 feather: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Blend paper-like, non-green pixels to white with a feathered edge.

    The colours travel through the feathering sums with their pixels, so
    no raster is drawn again or sent anywhere to meet its own sums.
    Returns the new pixels and the background share per leaf.  The feather
    width follows the shorter side of each leaf's own picture; leaves of one
    width are summed together, and only the widths in use, a small share of
    the longest side, reach the driver.
    """
    paper = paper_colour(px, frames)
    width = F.greatest(F.lit(3), F.floor(F.least("h", "w") * feather).cast("int").bitwiseOR(F.lit(1)))
    sized = frames.withColumn("_k", width)
    flagged = (
        with_hsv(px).join(paper.hint("shuffle_hash"), "leaf_id")
        .withColumn("_bg", ((K.paper_distance() < near) | ((F.col("sat") < sat) & (F.col("val") > bright))) & ~K.is_green())
        .withColumn("_bgi", F.col("_bg").cast("int") * 255)
    )
    share = flagged.groupBy("leaf_id").agg(F.bround(F.avg(F.col("_bg").cast("int")), 4).alias("bg_fraction"))
    rest = [c for c in px.columns if c not in ("leaf_id", "y", "x")]
    parts = []
    for row in sized.select("_k").distinct().orderBy("_k").collect():
        k = row["_k"]
        own = sized.where(F.col("_k") == k).drop("_k")
        summed = box_sum(flagged, own, "_bgi", k, "_s", rest)
        parts.append(summed.withColumn("_alpha", F.rint(F.col("_s") / (k * k)) / 255.0).drop("_s"))
    if not parts:
        return px.limit(0), share
    soft = parts[0]
    for part in parts[1:]:
        soft = soft.unionByName(part)
    return soft.withColumns(
        {c: F.floor(F.col(c) * (1.0 - F.col("_alpha")) + 255.0 * F.col("_alpha")).cast("int") for c in "rgb"}
    ).select(*px.columns), share


# --------------------------------------------------------------------------
# depth
# --------------------------------------------------------------------------


def depth(runs: DataFrame, frames: DataFrame, cap: int) -> DataFrame:
    """Squared distance of inside pixels to the nearest outside pixel.

    Exact Euclidean, as integers, capped at ``cap * cap``.  The distance
    along the row comes from the run itself; the vertical part looks at most
    ``cap`` rows up and down in one window per column.  The world beyond the
    picture does not count as outside.
    """
    keys = keys_of(runs)
    fkeys = [c for c in frames.columns if c not in ("h", "w")]
    big = cap
    left = F.when(F.col("x0") > 0, F.col("x") - F.col("x0") + 1).otherwise(big)
    right = F.when(F.col("x1") < F.col("w"), F.col("x1") - F.col("x")).otherwise(big)
    px = (
        runs.join(frames, fkeys)
        .select(*keys, "y", "x0", "x1", "h", "w", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"))
        .select(*keys, "y", "x", "h", F.least(left, right, F.lit(big)).alias("_g"))
    )
    col = W.partitionBy(*keys, "x").orderBy("y")
    seen = px.select(
        *keys, "y", "x", "h", "_g",
        *[F.lag("y", d).over(col).alias(f"_yu{d}") for d in range(1, cap)],
        *[F.lag("_g", d).over(col).alias(f"_gu{d}") for d in range(1, cap)],
        *[F.lead("y", d).over(col).alias(f"_yd{d}") for d in range(1, cap)],
        *[F.lead("_g", d).over(col).alias(f"_gd{d}") for d in range(1, cap)],
    )
    terms = [F.col("_g") * F.col("_g"), F.lit(cap * cap)]
    for d in range(1, cap):
        up = F.when(F.col(f"_yu{d}") == F.col("y") - d, F.col(f"_gu{d}") * F.col(f"_gu{d}") + d * d).when(
            F.col("y") - d >= 0, F.lit(d * d)
        )
        down = F.when(F.col(f"_yd{d}") == F.col("y") + d, F.col(f"_gd{d}") * F.col(f"_gd{d}") + d * d).when(
            F.col("y") + d < F.col("h"), F.lit(d * d)
        )
        terms += [up, down]
    return seen.select(*keys, "y", "x", F.least(*terms).cast("int").alias("d2"))


def rim_band(runs: DataFrame, frames: DataFrame, t: float) -> DataFrame:
    """Mask pixels closer than ``t`` to the outside."""
    grown = dilate(mask_not(runs, frames), disk_kernel(t * t), frames)
    return combine({"_m": runs, "_g": grown}, "_m and _g")


def deeper_than(runs: DataFrame, frames: DataFrame, t: float) -> DataFrame:
    """Mask pixels farther than ``t`` from the outside."""
    grown = dilate(mask_not(runs, frames), disk_kernel(t * t, strict=False), frames)
    return combine({"_m": runs, "_g": grown}, "_m and not _g")


def _deepest(runs: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Largest squared depth of each component, given its runs and its picture's size."""
    out = []
    for spans, height, width in zip(runs, h, w):
        y, x0, x1 = np.array([(s["y"], s["x0"], s["x1"]) for s in spans], np.int64).T
        # one pixel around the component, as far as the picture goes: the nearest outside pixel is always in there
        top, left = max(0, y.min() - 1), max(0, x0.min() - 1)
        rows, cols = min(height, y.max() + 2) - top, min(width, x1.max() + 1) - left
        step = np.zeros((rows, cols + 1), np.int8)
        np.add.at(step, (y - top, x0 - left), 1)
        np.add.at(step, (y - top, x1 - left), -1)
        inside = np.cumsum(step, axis=1, dtype=np.int8)[:, :cols] > 0
        # columns: steps to the nearest outside pixel above or below
        most = max(height, width)
        kind = np.int32 if most < 30000 else np.int64
        g = np.full((rows, cols), most, kind)
        for order in (range(rows), range(rows - 1, -1, -1)):
            run = np.full(cols, most, kind)
            for r in order:
                run = np.where(inside[r], np.minimum(run + 1, most), 0)
                np.minimum(g[r], run, out=g[r])
        # rows: the lowest of the parabolas over the columns, as far as any depth can still shrink
        g *= g
        d2, dx = g.copy(), 1
        while dx < cols and dx * dx < d2.max():
            np.minimum(d2[:, dx:], g[:, :-dx] + dx * dx, out=d2[:, dx:])
            np.minimum(d2[:, :-dx], g[:, dx:] + dx * dx, out=d2[:, :-dx])
            dx += 1
        out.append(int(d2.max()))
    return pd.Series(out, dtype="int64")


def max_depth2(comp: DataFrame, frames: DataFrame) -> DataFrame:
    """Largest squared depth of each 8-connected component, exact and without a cap.

    A separable transform in Arrow batches: steps within each column, then the lowest parabola along each row of the
    component's box.  Only runs travel, one row per component, which the picture bounds.  The world beyond the picture is
    not outside; a component that fills its picture is as deep as the longer side.
    """
    ship(comp.sparkSession)
    keys = keys_of(comp)
    fkeys = [c for c in frames.columns if c not in ("h", "w")]
    rows = comp.groupBy(*keys).agg(F.collect_list(F.struct(*SPAN)).alias("_runs")).join(frames, fkeys)
    deepest = F.pandas_udf(_deepest, "long")
    return rows.select(*keys, deepest("_runs", "h", "w").alias("max_d2"))


# --------------------------------------------------------------------------
# geometry of rasters
# --------------------------------------------------------------------------


def crop_letterbox(boxes: DataFrame, target: int = 512, pad_frac: float = 0.05, margin: float = 0.03) -> DataFrame:
    """Padded crop box of a mask, and the scale and offset of fitting the
    crop into a ``target`` square (``boxes`` is keys, bx0..by1, h, w)."""
    keys = [c for c in boxes.columns if c not in ("bx0", "by0", "bx1", "by1", "h", "w")]
    pad = F.greatest(F.lit(4), F.floor(F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")) * pad_frac).cast("int"))
    inner = max(int(target * (1.0 - 2 * margin)), target - 4)
    crop = boxes.select(
        *keys,
        F.greatest(F.lit(0), F.col("bx0") - pad).alias("cx0"),
        F.greatest(F.lit(0), F.col("by0") - pad).alias("cy0"),
        F.least(F.col("w"), F.col("bx1") + pad).alias("cx1"),
        F.least(F.col("h"), F.col("by1") + pad).alias("cy1"),
    ).withColumn("scale", F.lit(float(inner)) / F.greatest(F.col("cx1") - F.col("cx0"), F.col("cy1") - F.col("cy0")))
    new_w = F.greatest(F.lit(1), F.rint((F.col("cx1") - F.col("cx0")) * F.col("scale")).cast("int"))
    new_h = F.greatest(F.lit(1), F.rint((F.col("cy1") - F.col("cy0")) * F.col("scale")).cast("int"))
    return crop.select(
        "*",
        F.floor((target - new_w) / 2).cast("int").alias("pad_left"),
        F.floor((target - new_h) / 2).cast("int").alias("pad_top"),
    )


def resize_nearest(runs: DataFrame, frames: DataFrame, h: int, w: int) -> DataFrame:
    """Nearest-neighbour resize without touching pixels.

    Target x shows source ``floor(x * w_in / w_out)``, so a source run is
    again one target run, and a source line fills a range of target lines.
    """
    keys = keys_of(runs)
    fkeys = [c for c in frames.columns if c not in ("h", "w")]
    up = lambda c, n, size: F.ceil(F.col(c) * n / F.col(size)).cast("int")
    sized = runs.join(frames.select(*fkeys, F.col("h").alias("_h"), F.col("w").alias("_w")), fkeys)
    out = sized.select(
        *keys,
        F.ceil(F.col("y") * h / F.col("_h")).cast("int").alias("_y0"),
        F.ceil((F.col("y") + 1) * h / F.col("_h")).cast("int").alias("_y1"),
        up("x0", w, "_w").alias("x0"),
        up("x1", w, "_w").alias("x1"),
    ).where("_y1 > _y0 and x1 > x0")
    return merge(out.select(*keys, F.explode(F.expr("sequence(_y0, _y1 - 1)")).alias("y"), "x0", "x1"))


def geom_copies(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """The five rotated and flipped copies, as runs with a ``geom`` key.

    Half turn and flips move runs; only quarter turns go through pixels.
    """
    keys = keys_of(runs)
    fkeys = [c for c in frames.columns if c not in ("h", "w")]
    s = runs.join(frames, fkeys)
    my, m0, m1 = F.col("h") - 1 - F.col("y"), F.col("w") - F.col("x1"), F.col("w") - F.col("x0")
    moves = F.array(
        *[
            F.struct(F.lit(g).alias("g"), y.cast("int").alias("y"), a.cast("int").alias("a"), b.cast("int").alias("b"))
            for g, y, a, b in (
                ("r180", my, m0, m1), ("fh", F.col("y"), m0, m1), ("fv", my, F.col("x0"), F.col("x1")),
            )
        ]
    )
    flat = s.select(*keys, F.explode(moves).alias("m")).select(
        *keys, F.col("m.g").alias("geom"), F.col("m.y").alias("y"), F.col("m.a").alias("x0"), F.col("m.b").alias("x1")
    )
    px = s.select(*keys, "h", "w", "y", F.explode(F.expr("sequence(x0, x1 - 1)")).alias("x"))
    turns = F.array(
        F.struct(F.lit("r90").alias("g"), F.col("x").alias("y"), (F.col("h") - 1 - F.col("y")).cast("int").alias("x")),
        F.struct(F.lit("r270").alias("g"), (F.col("w") - 1 - F.col("x")).cast("int").alias("y"), F.col("y").alias("x")),
    )
    turned = px.select(*keys, F.explode(turns).alias("m")).select(*keys, F.col("m.g").alias("geom"), "m.y", "m.x")
    return flat.unionByName(to_runs(turned, keys=[*keys, "geom"]))
