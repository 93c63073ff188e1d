"""Hulls, outer contours, curvature, convexity defects and edge gaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut_lineage, spread
from . import components as C
from .runs import SPAN, _starts, area, combine, dilate, ellipse_kernel, in_groups, mask_or, merge, row_profile

N_POINTS = 512
# Weights of the five gap signals.
GAP_WEIGHTS = {"coarse": 0.25, "depth": 0.30, "aspect": 0.15, "white": 0.20, "aperiodic": 0.10}


# --------------------------------------------------------------------------
# convex hull
# --------------------------------------------------------------------------


ROWS = 1 << 15  # rows of small leaves that Python steps take together
PASSES = 24  # after these, what is left of a hull is finished point by point


def _half(group: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Places of one side's hull corners among points in order, for many groups at once.

    A point on or behind the line between its neighbours is no corner, so all such points of a pass go together.
    """
    at, done = np.arange(len(group)), []
    for _ in range(PASSES):
        a, b, c = at[:-2], at[1:-1], at[2:]
        behind = (px[b] - px[a]) * (py[c] - py[a]) <= (py[b] - py[a]) * (px[c] - px[a])
        gone = np.zeros(len(at), bool)
        gone[1:-1] = behind & (group[a] == group[c])
        if not gone.any():
            break
        changed = np.zeros(int(group.max()) + 1, bool)
        changed[group[at[gone]]] = True
        at = at[~gone]
        live = changed[group[at]]
        done.append(at[~live])
        at = at[live]
    else:
        for points in np.split(at, np.flatnonzero(np.diff(group[at])) + 1):
            x, y = px[points].tolist(), py[points].tolist()
            out: list[int] = []
            for c in range(len(x)):
                while len(out) > 1:
                    a, b = out[-2:]
                    if (x[b] - x[a]) * (y[c] - y[a]) > (y[b] - y[a]) * (x[c] - x[a]):
                        break
                    out.pop()
                out.append(c)
            done.append(points[out])
        at = at[:0]
    return np.sort(np.concatenate([*done, at]))


def hulls(group: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hull corners of many point sets, clockwise on screen from the leftmost: set, number, x and y."""
    order = np.lexsort((py, px, group))
    group, px, py = group[order], px[order], py[order]
    new = np.r_[True, (np.diff(group) != 0) | (np.diff(px) != 0) | (np.diff(py) != 0)]
    group, px, py = group[new], px[new], py[new]
    there = _half(group, px, py)
    back = len(group) - 1 - _half(-group[::-1] + group[-1], px[::-1], py[::-1])
    # each side leaves its last point to the other; a single point stays
    last = np.r_[group[1:] != group[:-1], True]
    first = np.r_[True, group[1:] != group[:-1]]
    ring = np.r_[there[~last[there] | first[there]], back[~first[back]]]
    ring = ring[np.argsort(group[ring], kind="stable")]
    of = group[ring]
    return of, np.arange(len(of)) - np.searchsorted(of, of), px[ring], py[ring]


def group_numbers(batch: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every row, and the first row of every group."""
    new = _starts(batch, keys)
    return np.cumsum(new), np.r_[0, np.flatnonzero(new)]


def _number(batch: pa.Table, column: str) -> np.ndarray:
    return batch.column(column).to_numpy().astype(np.int64)


def int_batch(batch: pa.Table | pa.RecordBatch, keys: Sequence[str], rows: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Keys of the rows named, with integer columns."""
    of = pa.array(rows)
    own = [c.combine_chunks() if isinstance(c := batch.column(k).take(of), pa.ChunkedArray) else c for k in keys]
    return pa.RecordBatch.from_arrays([*own, *[pa.array(v.astype(np.int32)) for v in columns.values()]], [*keys, *columns])


def line_ends(batch: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, x and y of the two ends of every scan line, from runs in order of their lines."""
    y, x0, x1 = (_number(batch, c) for c in SPAN)
    line = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(y) != 0)])
    ends = np.r_[np.minimum.reduceat(x0, line), np.maximum.reduceat(x1, line) - 1]
    return np.tile(group[line], 2), ends, np.tile(y[line], 2)


def _hull_batch(batch: pa.Table) -> Iterator[pa.RecordBatch]:
    """Hull corners of whole leaves from runs in order of their lines."""
    group, first = group_numbers(batch, ["leaf_id"])
    of, v, px, py = hulls(*line_ends(batch, group))
    yield int_batch(batch, ["leaf_id"], first[of], v=v, px=px, py=py)


def hull_vertices(runs: DataFrame) -> DataFrame:
    """Hull corners per leaf, clockwise on screen; many leaves share a call."""
    id_type = runs.schema["leaf_id"].dataType.simpleString()
    return in_groups(runs.select("leaf_id", *SPAN), ["leaf_id"], ["y"], _hull_batch, f"leaf_id {id_type}, v int, px int, py int", ROWS)


def _edges(vertices: DataFrame) -> DataFrame:
    ring = W.partitionBy("leaf_id").orderBy("v")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return vertices.select(
        "leaf_id", "v", "px", "py",
        F.coalesce(F.lead("px").over(ring), F.first("px").over(whole)).alias("qx"),
        F.coalesce(F.lead("py").over(ring), F.first("py").over(whole)).alias("qy"),
    )


def polygon_runs(vertices: DataFrame) -> DataFrame:
    """Pixels inside a convex polygon, row by row between its edges."""
    e = _edges(vertices)
    rows = e.select("leaf_id", "px", "py", "qx", "qy", F.explode(F.sequence(F.least("py", "qy"), F.greatest("py", "qy"))).alias("y"))
    # a flat edge contributes both of its ends
    at = F.when(
        F.col("py") == F.col("qy"), F.array(F.col("px").cast("double"), F.col("qx").cast("double"))
    ).otherwise(
        F.array(F.col("px") + (F.col("qx") - F.col("px")) * (F.col("y") - F.col("py")) / F.when(F.col("py") != F.col("qy"), F.col("qy") - F.col("py")))
    )
    return (
        rows.select("leaf_id", "y", F.explode(at).alias("x"))
        .groupBy("leaf_id", "y")
        .agg(F.ceil(F.min("x") - 1e-9).cast("int").alias("x0"), (F.floor(F.max("x") + 1e-9) + 1).cast("int").alias("x1"))
        .where("x1 > x0")
        .select("leaf_id", *SPAN)
    )


def convex_hull(runs: DataFrame) -> DataFrame:
    """Filled convex hull of each leaf's largest component."""
    return polygon_runs(hull_vertices(C.largest(runs)))


ROI_MODES = ("mask", "filled", "closed", "hull", "lama", "reconstruction")


def expand_roi(runs: DataFrame, mode: str, frames: DataFrame) -> DataFrame:
    """Region a leaf's damage is measured against."""
    if mode not in ROI_MODES:
        raise ValueError(f"roi mode must be one of {ROI_MODES}, got {mode!r}")
    base = cut_lineage(C.fill_holes(runs, frames))
    if mode not in ("closed", "hull"):
        return base
    from .runs import close_adaptive

    closed = close_adaptive(base, frames)
    if mode == "closed":
        return closed
    sized = area(base).where("area >= 50").select("leaf_id")
    hull = convex_hull(base.join(sized, "leaf_id", "left_semi"))
    return C.fill_holes(mask_or(hull.select(*base.columns), closed, base), frames)


# --------------------------------------------------------------------------
# contours
# --------------------------------------------------------------------------

_STEPS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


CANVAS = 1 << 22  # pixels of small leaves drawn together
# Next step for a way one came and the neighbours there are (a bit each): the first found, starting behind the right hand.
_TURN = np.array([[next(((f + 3 - t) % 8 for t in range(8) if near >> (f + 3 - t) % 8 & 1), 0) for near in range(256)] for f in range(8)], np.int8)


def _walk(near: np.ndarray, start: np.ndarray, pitch: int) -> tuple[np.ndarray, np.ndarray]:
    """Border walks from every start over a canvas of neighbour bits: walk number and place, step by step within a walk."""
    move = np.array([dy * pitch + dx for dx, dy in _STEPS])
    who, at, facing = np.arange(len(start)), start.copy(), np.zeros(len(start), np.int8)
    leave = _TURN[facing, near[at]]
    walks, places = [who], [at]
    alone = near[at] == 0
    who, at, turn = who[~alone], at[~alone], leave[~alone]
    while len(who) > 8:
        at, facing = at + move[turn], turn
        turn = _TURN[facing, near[at]]
        on = (at != start[who]) | (turn != leave[who])
        who, at, turn = who[on], at[on], turn[on]
        walks.append(who)
        places.append(at)
    # few long walks: one by one
    steps, turns, cells = move.tolist(), _TURN.tolist(), memoryview(near)
    for one, place, d in zip(who.tolist(), at.tolist(), turn.tolist()):
        begin, out, path = int(start[one]), int(leave[one]), []
        while True:
            place += steps[d]
            d = turns[d][cells[place]]
            if place == begin and d == out:
                break
            path.append(place)
        walks.append(np.full(len(path), one))
        places.append(np.array(path, np.int64))
    walk, place = np.concatenate(walks), np.concatenate(places)
    order = np.argsort(walk, kind="stable")
    return walk[order], place[order]


def traces(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Border pixels of many leaves of one component each, down the left side first: leaf, number, x and y.

    Leaves are drawn below each other with a blank rim, as many as fit a canvas, or one.
    """
    first = np.flatnonzero(np.r_[True, np.diff(group) != 0])
    top, bottom = np.minimum.reduceat(y, first), np.maximum.reduceat(y, first)
    left, wide = np.minimum.reduceat(x0, first), np.maximum.reduceat(x1, first)
    high, wide = bottom - top + 3, wide - left + 2
    ends = np.r_[first[1:], len(group)]
    a = 0
    while a < len(first):
        room = np.cumsum(high[a:]) * np.maximum.accumulate(wide[a:])
        b = a + max(1, int(np.searchsorted(room, CANVAS, "right")))
        pitch, rows = int(wide[a:b].max()), int(high[a:b].sum())
        base = np.cumsum(high[a:b]) - high[a:b] + 1  # canvas row of each leaf's top
        own = slice(first[a], ends[b - 1])
        leaf = np.repeat(np.arange(b - a), (ends - first)[a:b])
        line = (base[leaf] + y[own] - top[a:b][leaf]) * pitch - left[a:b][leaf] + 1
        change = np.zeros(rows * pitch, np.int32)
        np.add.at(change, line + x0[own], 1)
        np.add.at(change, line + x1[own], -1)
        drawn = (np.cumsum(change, out=change) > 0).view(np.uint8)
        near = np.zeros(len(drawn), np.uint8)
        for d, (dx, dy) in enumerate(_STEPS):
            by = dy * pitch + dx
            if by > 0:
                near[:-by] |= drawn[by:] << np.uint8(d)
            else:
                near[-by:] |= drawn[:by] << np.uint8(d)
        begin = np.full(b - a, len(near), np.int64)
        highest = y[own] == top[a:b][leaf]
        np.minimum.at(begin, leaf[highest], (line + x0[own])[highest])
        walk, place = _walk(near, begin, pitch)
        px = place % pitch - 1 + left[a:b][walk]
        py = place // pitch - base[walk] + top[a:b][walk]
        yield walk + a, np.arange(len(walk)) - np.searchsorted(walk, walk), px, py
        a = b


def _trace_batch(batch: pa.Table) -> Iterator[pa.RecordBatch]:
    group, first = group_numbers(batch, ["leaf_id"])
    for leaf, i, px, py in traces(group, *(_number(batch, c) for c in SPAN)):
        yield int_batch(batch, ["leaf_id"], first[leaf], i=i, px=px, py=py)


def contour(runs: DataFrame) -> DataFrame:
    """Outer border of the largest component, pixel by pixel.

    One leaf's silhouette is drawn as a whole; its size is bounded by the picture.  Small leaves are walked together.
    """
    return _traced(C.largest(runs))


def _traced(big: DataFrame) -> DataFrame:
    """Outer border of leaves of one component each."""
    id_type = big.schema["leaf_id"].dataType.simpleString()
    return in_groups(big.select("leaf_id", *SPAN), ["leaf_id"], (), _trace_batch, f"leaf_id {id_type}, i int, px int, py int", ROWS)


def contour_lengths(cnt: DataFrame) -> DataFrame:
    """Closed length and enclosed polygon area of a contour."""
    ring = W.partitionBy("leaf_id").orderBy("i")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx = F.coalesce(F.lead("px").over(ring), F.first("px").over(whole))
    ny = F.coalesce(F.lead("py").over(ring), F.first("py").over(whole))
    s = cnt.select("leaf_id", "px", "py", nx.alias("nx"), ny.alias("ny"))
    return s.groupBy("leaf_id").agg(
        F.sum(F.hypot(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))).alias("perimeter"),
        (F.abs(F.sum(F.col("px") * F.col("ny") - F.col("nx") * F.col("py"))) / 2.0).alias("poly_area"),
        F.count("*").alias("n_points"),
    )


def resample(cnt: DataFrame, n: int = N_POINTS) -> DataFrame:
    """``n`` points at equal arc length.  Every contour step emits the
    samples that fall on it, so no range join is needed."""
    w = W.partitionBy("leaf_id").orderBy("i")
    step = F.hypot(F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w))
    # a contour is small, but what is made of its points is not: they stay in many partitions
    arc = spread(cnt, "leaf_id").withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("_arc", F.sum("_d").over(w))
    seg = arc.select(
        "leaf_id", "px", "py", "_arc", F.lead("_arc").over(w).alias("_end"), F.lead("px").over(w).alias("_nx"),
        F.lead("py").over(w).alias("_ny"), F.max("_arc").over(W.partitionBy("leaf_id")).alias("_total"),
    ).where("_end > _arc")
    at = seg.withColumn("_step", F.col("_total") / n).withColumn("_k0", F.ceil(F.col("_arc") / F.col("_step"))).withColumn(
        "_k1", F.ceil(F.col("_end") / F.col("_step")) - 1
    )
    out = at.where("_k1 >= _k0").withColumn("i", F.explode(F.sequence("_k0", "_k1"))).where(F.col("i") < n)
    t = (F.col("i") * F.col("_step") - F.col("_arc")) / (F.col("_end") - F.col("_arc"))
    moved = out.select(
        "leaf_id", F.col("i").cast("int").alias("i"),
        (F.col("px") + t * (F.col("_nx") - F.col("px"))).alias("px"), (F.col("py") + t * (F.col("_ny") - F.col("py"))).alias("py"),
    )
    # a contour without length repeats its point
    still = arc.groupBy("leaf_id").agg(F.max("_arc").alias("_total"), F.min_by(F.struct("px", "py"), "i").alias("_p")).where("_total = 0")
    held = still.select(
        "leaf_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.col("_p.px").cast("double").alias("px"), F.col("_p.py").cast("double").alias("py")
    )
    return moved.unionByName(held)


def _concave(smooth: np.ndarray, reach: int) -> np.ndarray:
    """Points of negative curvature, and ``reach`` to each side; every cut of ``k_threshold`` is negative."""
    low = smooth < 0
    return np.logical_or.reduce([np.roll(low, d, 1) for d in range(-reach, reach + 1)])


def curvature(points: DataFrame, sigmas=(2.0, 8.0, 20.0), near: int | None = None) -> DataFrame:
    """Signed curvature of the smoothed closed contour at several scales.

    Rows are fixed-length coordinate arrays, so a batch is smoothed as one
    matrix product in an Arrow UDF.  With ``near``, only points concave at the
    last scale remain, and those at most so many places from one: with the
    ``merge_gap`` of ``gap_candidates``, all points of all gaps.
    """

    @F.pandas_udf("array<array<double>>")
    def bend(xs: pd.Series, ys: pd.Series) -> pd.Series:
        X, Y = np.stack(xs.to_numpy()), np.stack(ys.to_numpy())
        n = X.shape[1]
        out = []
        for sigma in sigmas:
            r = int(4.0 * sigma + 0.5)
            g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
            ring = np.zeros(n)
            np.add.at(ring, np.arange(-r, r + 1) % n, g / g.sum())
            turn = ring[(np.arange(n)[:, None] - np.arange(n)[None, :]) % n]
            a, b = X @ turn, Y @ turn
            dx, dy = (np.roll(a, -1, 1) - np.roll(a, 1, 1)) / 2, (np.roll(b, -1, 1) - np.roll(b, 1, 1)) / 2
            ddx, ddy = np.roll(a, -1, 1) - 2 * a + np.roll(a, 1, 1), np.roll(b, -1, 1) - 2 * b + np.roll(b, 1, 1)
            out.append((dx * ddy - dy * ddx) / np.maximum((dx * dx + dy * dy) ** 1.5, 1e-8))
        if near is not None:
            out.append(_concave(out[-1], near).astype(float))
        return pd.Series([[o[j].tolist() for o in out] for j in range(len(X))])

    lists = points.groupBy("leaf_id").agg(F.sort_array(F.collect_list(F.struct("i", "px", "py"))).alias("_p"))
    k = lists.select("leaf_id", "_p", bend(F.col("_p.px"), F.col("_p.py")).alias("_k"))
    names = [f"k{int(s)}" for s in sigmas]
    columns = names if near is None else [*names, "_near"]
    flat = k.select("leaf_id", "_p", *[F.get("_k", F.lit(j)).alias(c) for j, c in enumerate(columns)])
    rows = flat.select("leaf_id", F.explode(F.arrays_zip("_p", *columns)).alias("_z"))
    kept = rows if near is None else rows.where("_z._near > 0")
    return kept.select("leaf_id", "_z._p.i", "_z._p.px", "_z._p.py", *[f"_z.{n}" for n in names])


def k_threshold(points: DataFrame, col: str = "k2", also: Sequence[Column] = ()) -> DataFrame:
    """Concavity cut per leaf: 2.5 deviations beyond its own convexity; further aggregates share the pass."""
    pos = F.when(F.col(col) > 0, F.col(col))
    return points.groupBy("leaf_id").agg(
        *also, F.when(F.count(pos) < 10, -0.04).otherwise(-(F.avg(pos) + 2.5 * F.stddev_pop(pos))).alias("k_thresh")
    )


def classify_morphology(runs: DataFrame) -> DataFrame:
    """compound / lobed / serrated / smooth from component share, solidity
    and the perimeter against the hull's."""
    comp = C.components(runs, 8)
    big = C.largest_of(comp)
    share = (
        comp.groupBy("leaf_id", "comp").agg(F.sum(F.col("x1") - F.col("x0")).alias("a"))
        .groupBy("leaf_id").agg((F.max("a") / F.sum("a")).alias("share"), F.count("*").alias("n"))
    )
    c = contour_lengths(_traced(big))
    hv = hull_vertices(big).withColumnRenamed("v", "i")
    h = contour_lengths(hv).select("leaf_id", F.col("perimeter").alias("hp"), F.col("poly_area").alias("ha"))
    j = share.join(c, "leaf_id").join(h, "leaf_id").withColumn("solidity", F.col("poly_area") / F.greatest(F.lit(1.0), F.col("ha"))).withColumn(
        "perim_ratio", F.col("perimeter") / F.greatest(F.lit(1.0), F.col("hp"))
    )
    s, p = F.col("solidity"), F.col("perim_ratio")
    return j.select(
        "leaf_id", "solidity", "perim_ratio",
        F.when((F.col("n") > 1) & (F.col("share") < 0.80), "compound")
        .when(F.col("poly_area") < 100, "smooth")
        .when((s < 0.70) | (p > 1.45), "lobed")
        .when(p > 1.25, "serrated")
        .when((s < 0.85) & (p > 1.15), "lobed")
        .otherwise("smooth").alias("morphology"),
    )


def convexity_defects(cnt: DataFrame, vertices: DataFrame) -> DataFrame:
    """Farthest contour point from each hull edge, with its depth.

    Contour points are assigned to the hull corner passed last; the stretch
    before the first corner belongs to the last one.
    """
    first_at = cnt.join(vertices.select("leaf_id", "px", "py"), ["leaf_id", "px", "py"]).groupBy("leaf_id", "px", "py").agg(F.min("i").alias("i"))
    marked = cnt.join(first_at.select("leaf_id", "i", F.col("i").alias("_h")), ["leaf_id", "i"], "left")
    w = W.partitionBy("leaf_id").orderBy("i")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    seg = marked.withColumn("_s", F.coalesce(F.last("_h", True).over(upto), F.max("_h").over(W.partitionBy("leaf_id"))))
    corners = first_at.select("leaf_id", F.col("i").alias("_s"), F.col("px").alias("sx"), F.col("py").alias("sy"))
    ring = W.partitionBy("leaf_id").orderBy("_s")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pairs = corners.select(
        "leaf_id", "_s", "sx", "sy", F.coalesce(F.lead("sx").over(ring), F.first("sx").over(whole)).alias("ex"),
        F.coalesce(F.lead("sy").over(ring), F.first("sy").over(whole)).alias("ey"),
    )
    chord = F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))
    off = F.abs((F.col("ex") - F.col("sx")) * (F.col("py") - F.col("sy")) - (F.col("ey") - F.col("sy")) * (F.col("px") - F.col("sx")))
    j = seg.join(pairs, ["leaf_id", "_s"]).withColumn("_c", chord).where("_c > 0").withColumn("depth", off / F.col("_c"))
    return (
        j.groupBy("leaf_id", F.col("_s").alias("start_i"), "sx", "sy", "ex", "ey")
        .agg(F.max(F.struct("depth", -F.col("i"), F.col("px"), F.col("py"))).alias("_m"))
        .select("leaf_id", "start_i", "sx", "sy", "ex", "ey", F.col("_m.px").alias("fx"), F.col("_m.py").alias("fy"), F.col("_m.depth").alias("depth"))
        .where("depth > 0")
    )


# --------------------------------------------------------------------------
# gaps
# --------------------------------------------------------------------------


MERGE_GAP = 4  # points between concave stretches of one gap


def gap_candidates(points: DataFrame, thresholds: DataFrame, merge_gap: int = MERGE_GAP, min_len: int = 6, n: int = N_POINTS) -> DataFrame:
    """Concave stretches of the closed contour, close ones joined."""
    f = points.join(thresholds, "leaf_id").where(F.col("k20") < F.col("k_thresh"))
    w = W.partitionBy("leaf_id").orderBy("i")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    prev = F.coalesce(F.lag("i").over(w), F.last("i").over(whole) - n)
    cut = f.withColumn("_new", (F.col("i") - prev - 1 > merge_gap).cast("int"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    grp = cut.withColumn("_g", F.sum("_new").over(upto)).withColumn("_n", F.sum("_new").over(whole))
    # what comes before the first break closes the circle with the last stretch
    grp = grp.withColumn("gap_id", F.when(F.col("_g") == 0, F.col("_n")).otherwise(F.col("_g"))).withColumn(
        "_pos", F.when((F.col("_g") == 0) & (F.col("_n") > 0), F.col("i") + n).otherwise(F.col("i"))
    )
    g = grp.groupBy("leaf_id", "gap_id", "k_thresh").agg(
        F.min("_pos").alias("_a"), F.max("_pos").alias("_b"), F.min("k20").alias("k_min"),
        F.min_by(F.struct("px", "py"), "_pos").alias("_p"), F.max_by(F.struct("px", "py"), "_pos").alias("_q"),
        F.avg("px").alias("cx"), F.avg("py").alias("cy"),
    )
    return g.where(F.col("_b") - F.col("_a") + 1 >= min_len).select(
        "leaf_id", "gap_id", (F.col("_a") % n).alias("start_idx"), (F.col("_b") % n).alias("end_idx"),
        (F.col("_b") - F.col("_a") + 1).alias("n_pts"), "k_thresh", "k_min", "cx", "cy",
        F.hypot(F.col("_p.px") - F.col("_q.px"), F.col("_p.py") - F.col("_q.py")).alias("width_px"),
        (-F.col("k_min") * 50.0).alias("depth_proxy"),
    )


def deepest_defects(gaps: DataFrame, points: DataFrame, defects: DataFrame, reach: float = 60.0, n: int = N_POINTS) -> DataFrame:
    """Deepest convexity defect, with its corners, that has a key point near each gap's arc.

    Defects and arcs meet on 60-pixel grid cells, not as all pairs.
    """
    arc = gaps.select("leaf_id", "gap_id", F.explode(F.sequence("start_idx", F.col("start_idx") + F.col("n_pts") - 1)).alias("i")).select(
        "leaf_id", "gap_id", (F.col("i") % n).cast("int").alias("i")
    ).join(points.select("leaf_id", "i", "px", "py"), ["leaf_id", "i"])
    cell = lambda c: F.floor(F.col(c) / reach)
    arc = arc.withColumn("_cx", cell("px")).withColumn("_cy", cell("py"))
    corners = ("sx", "sy", "ex", "ey", "fx", "fy")
    own = F.struct("depth", (-F.col("start_i")).alias("first"), *corners).alias("defect")
    keyp = defects.select("leaf_id", own, F.explode(F.array(
        F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y")),
        F.struct(F.col("fx").alias("x"), F.col("fy").alias("y")))).alias("_k")).select("leaf_id", "defect", "_k.x", "_k.y")
    near = F.expr("sequence(-1, 1)")
    keyp = keyp.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).select(
        "leaf_id", "defect", "x", "y", (cell("x") + F.col("_dx")).alias("_cx"), (cell("y") + F.col("_dy")).alias("_cy")
    )
    hit = arc.join(keyp, ["leaf_id", "_cx", "_cy"]).where(F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")) <= reach)
    best = hit.groupBy("leaf_id", "gap_id").agg(F.max("defect").alias("_d"))
    return best.select("leaf_id", "gap_id", F.col("_d.depth").alias("defect_depth"), *[f"_d.{c}" for c in corners])


def match_defects(gaps: DataFrame, points: DataFrame, defects: DataFrame, reach: float = 60.0, n: int = N_POINTS) -> DataFrame:
    """Depth of the deepest convexity defect near each gap's arc."""
    return deepest_defects(gaps, points, defects, reach, n).select("leaf_id", "gap_id", "defect_depth")


# Least depth and arc length of a gap by leaf morphology.
MORPHOLOGY_LIMITS = {"serrated": (18.0, 7), "lobed": (22.0, 10)}


def score_gaps(gaps: DataFrame, points: DataFrame, thresholds: DataFrame, depths: DataFrame, whiteness: DataFrame | None = None,
               min_depth: float = 10.0, threshold: float = 0.55, excluded: DataFrame | None = None,
               morphology: DataFrame | None = None) -> DataFrame:
    """Five signals per gap, their weighted sum and the verdict.

    ``excluded`` holds runs of the petiole and tip zones: a gap whose centre
    lies there is never confirmed.  ``morphology`` (``leaf_id, morphology``)
    raises the least depth, and drops gaps with too few points, on serrated
    and lobed leaves.
    """
    w = W.partitionBy("leaf_id").orderBy("i")
    # stretches of concave points begin where the point before is missing
    low = points.join(thresholds, "leaf_id").where(F.col("k20") < F.col("k_thresh"))
    starts = low.select("leaf_id", (F.col("i") - F.coalesce(F.lag("i").over(w), F.lit(-2)) > 1).cast("int").alias("_s"))
    ap = starts.groupBy("leaf_id").agg(F.sum("_s").alias("_r")).select(
        "leaf_id", F.when(F.col("_r") <= 2, 1.0).when(F.col("_r") >= 8, 0.0).otherwise(1.0 - (F.col("_r") - 2) / 6.0).alias("aperiodic")
    )
    j = gaps.join(depths, ["leaf_id", "gap_id"], "left").join(ap, "leaf_id", "left").fillna(1.0, ["aperiodic"])
    j = j.withColumn("_least", F.lit(min_depth))
    if morphology is not None:
        j = j.join(morphology.select("leaf_id", "morphology"), "leaf_id", "left")
        for kind, (deep, long) in MORPHOLOGY_LIMITS.items():
            own = F.coalesce(F.col("morphology") == kind, F.lit(False))
            j = j.where(~own | (F.col("n_pts") >= long)).withColumn(
                "_least", F.when(own, F.greatest("_least", F.lit(deep))).otherwise(F.col("_least"))
            )
        j = j.drop("morphology")
    if whiteness is not None:
        j = j.join(whiteness, ["leaf_id", "gap_id"], "left")
    else:
        j = j.withColumn("whiteness", F.lit(None).cast("double"))

    def unit(c):
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    d = F.coalesce("defect_depth", F.lit(0.0))
    out = j.withColumns({
        "coarse": unit((F.col("k_thresh") - F.col("k_min")) / (2.0 * F.abs("k_thresh") + 1e-9)),
        "depth": F.when(d < F.col("_least"), 0.0).otherwise(unit((d - F.col("_least")) / (2.0 * F.col("_least") + 1e-9))),
        "aspect": unit(1.0 - (F.col("width_px") / F.greatest(F.col("depth_proxy"), F.lit(1.0)) - 1.5) / 5.0),
        "white": F.when(F.col("whiteness").isNull(), 0.5).otherwise(unit((F.col("whiteness") - 0.80) / 0.20)),
    })
    total = sum((F.col(k) * v for k, v in GAP_WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("composite", total).drop("_least")
    if excluded is None:
        return out.withColumn("confirmed", F.col("composite") >= threshold)
    zone = merge(excluded.select("leaf_id", *SPAN))
    at = out.select("leaf_id", "gap_id", F.floor("cx").cast("int").alias("_x"), F.floor("cy").cast("int").alias("y"))
    inside = at.join(zone, ["leaf_id", "y"]).where("_x >= x0 and _x < x1").select("leaf_id", "gap_id", F.lit(True).alias("_out"))
    return out.join(inside, ["leaf_id", "gap_id"], "left").withColumn(
        "confirmed", (F.col("composite") >= threshold) & F.col("_out").isNull()
    ).drop("_out")


def petiole_zone(runs: DataFrame, frames: DataFrame, neck: float = 0.30, bottom: float = 0.50) -> DataFrame:
    """First row of the lower part narrower than a share of the widest row;
    rows without tissue count as narrow."""
    widths = row_profile(runs)
    top = widths.groupBy("leaf_id").agg(F.max("width").alias("_max")).where("_max >= 1")
    lines = frames.join(top, "leaf_id").select(
        "leaf_id", "w", "h", "_max", F.explode(F.expr(f"sequence(cast(floor(h * {1.0 - bottom}) as int), cast(h as int) - 1)")).alias("y")
    )
    j = lines.join(widths.select("leaf_id", "y", "width"), ["leaf_id", "y"], "left")
    return j.where(F.coalesce("width", F.lit(0)) < F.col("_max") * neck).groupBy("leaf_id").agg(F.min("y").alias("petiole_row"))


def exclusion_zones(runs: DataFrame, frames: DataFrame, neck: float = 0.30, arc: float = 0.06) -> DataFrame:
    """Petiole rows and a disc around the tip, as one mask.

    The tip is the contour point farthest from the petiole's middle; the
    disc follows the contour length (radius 5 to 40).
    """
    pet = petiole_zone(runs, frames, neck)
    lines = row_profile(runs)
    mid = runs.groupBy("leaf_id", "y").agg((F.sum((F.col("x1") - F.col("x0")) * (F.col("x0") + F.col("x1") - 1) / 2.0) / F.sum(F.col("x1") - F.col("x0"))).alias("mx"))
    whole = runs.groupBy("leaf_id").agg(
        (F.sum((F.col("x1") - F.col("x0")) * (F.col("x0") + F.col("x1") - 1) / 2.0) / F.sum(F.col("x1") - F.col("x0"))).alias("ax"), F.max("y").alias("ay")
    )
    ref = (
        frames.join(whole, "leaf_id").join(pet, "leaf_id", "left")
        .join(mid.withColumnRenamed("y", "petiole_row"), ["leaf_id", "petiole_row"], "left")
        .select("leaf_id", "h", "w", "petiole_row",
                F.when(F.col("petiole_row").isNull(), F.col("ax")).otherwise(F.coalesce("mx", F.col("w") / 2.0)).alias("rx"),
                F.coalesce("petiole_row", "ay").cast("double").alias("ry"))
    )
    cnt = cut_lineage(contour(runs))
    far = cnt.join(ref, "leaf_id").groupBy("leaf_id").agg(
        F.max(F.struct(F.hypot(F.col("px") - F.col("rx"), F.col("py") - F.col("ry")), -F.col("i"))).alias("_m"), F.count("*").alias("n")
    ).where("n >= 10").select("leaf_id", (-F.col("_m.col2")).alias("apex"), "n")
    half = F.greatest(F.lit(1), F.rint(F.col("n") * arc / 2.0).cast("int"))
    away = F.least(F.pmod(F.col("i") - F.col("apex"), F.col("n")), F.pmod(F.col("apex") - F.col("i"), F.col("n")))
    reach = F.least(F.lit(40), F.greatest(F.lit(5), F.rint(F.col("n") * arc * 0.5).cast("int"))).alias("_r")
    tip = cnt.join(far, "leaf_id").where(away <= half).select(
        "leaf_id", reach,
        F.col("py").alias("y"), F.col("px").alias("x0"), (F.col("px") + 1).alias("x1"),
    )
    sized = frames.join(far, "leaf_id").select("leaf_id", reach, "h", "w")
    disc = dilate(tip, "_r", sized).drop("_r")
    rows = ref.where("petiole_row is not null").select(
        "leaf_id", F.explode(F.expr("sequence(cast(petiole_row as int), cast(h as int) - 1)")).alias("y"), F.lit(0).alias("x0"), F.col("w").cast("int").alias("x1")
    )
    return mask_or(disc, rows)


def triangle_runs(tri: DataFrame) -> DataFrame:
    """Filled triangles ``(keys, sx, sy, ex, ey, fx, fy)`` as runs."""
    corners = F.array(*[F.struct(F.col(f"{c}x").cast("int").alias("px"), F.col(f"{c}y").cast("int").alias("py"), F.lit(i).alias("v")) for i, c in enumerate("sef")])
    keyed = tri.select(F.struct("leaf_id", "tri_id").alias("leaf_id"), F.explode(corners).alias("_c")).select("leaf_id", "_c.v", "_c.px", "_c.py")
    return polygon_runs(keyed).select("leaf_id.leaf_id", "leaf_id.tri_id", *SPAN)


def budget_fill(cands: DataFrame, budget: DataFrame) -> DataFrame:
    """Greedy choice under an area budget, deepest first, skipping what
    would overflow.  An ordered fold over one leaf's few candidates.

    ``cands`` is ``leaf_id, cand_id, depth, area``; ``budget`` is
    ``leaf_id, budget``.
    """
    ordered = cands.groupBy("leaf_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), (-F.col("area")).alias("a"), F.col("cand_id").alias("c")))).alias("_l"))
    fold = F.expr(
        """aggregate(_l, struct(cast(0 as bigint) as used, cast(array() as array<bigint>) as kept),
           (s, e) -> case when s.used - e.a <= budget then struct(s.used - e.a as used, array_append(s.kept, cast(e.c as bigint)) as kept) else s end)"""
    )
    return ordered.join(budget, "leaf_id").select("leaf_id", F.explode(fold["kept"]).alias("cand_id"))


def bite_gaps(runs: DataFrame, frames: DataFrame, min_depth: float = 5.0, min_area: int = 40, min_dc: float = 0.15,
              max_area_frac: float = 0.35) -> DataFrame:
    """Compact open-margin gaps between a leaf and its hull.

    Depth and depth per chord must be large enough; gaps near the tip, the
    base or the exclusion zones must lie well off the midrib.
    """
    from .detectors import intersect_runs
    from .raster import max_depth2

    base = cut_lineage(runs)
    hull = convex_hull(base)
    filled = C.fill_holes(base, frames)
    gap = cut_lineage(combine({"_h": hull, "_f": filled}, "_h and not _f"))
    comp = cut_lineage(C.components(gap, 8))
    stats = C.component_stats(comp)
    d2 = max_depth2(comp, frames)
    excl = exclusion_zones(base, frames, 0.22, 0.045)
    inx = intersect_runs(comp, excl).groupBy("leaf_id", "comp").agg(F.sum(F.col("x1") - F.col("x0")).alias("_ex"))
    n = F.col("x1") - F.col("x0")
    leaf = base.groupBy("leaf_id").agg(
        F.min("y").alias("y0"), F.max("y").alias("yl"), F.greatest(F.lit(1), F.max("x1") - 1 - F.min("x0")).alias("wid"),
        (F.sum(n * (F.col("x0") + F.col("x1") - 1) / 2.0) / F.sum(n)).alias("mid"), F.sum(n).alias("la"),
    ).withColumn("span", F.greatest(F.lit(1), F.col("yl") - F.col("y0")))
    j = stats.join(d2, ["leaf_id", "comp"]).join(leaf, "leaf_id").join(inx, ["leaf_id", "comp"], "left")
    dep = F.sqrt("max_d2")
    dc = dep / F.greatest(F.lit(1), F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")))
    off = F.abs(F.col("cx") - F.col("mid"))
    end = (F.col("cy") <= F.col("y0") + 0.12 * F.col("span")) | (F.col("cy") >= F.col("yl") - 0.18 * F.col("span"))
    ok = (
        F.col("area").between(min_area, 1 << 30)
        & (F.col("area") <= F.greatest(F.lit(min_area), F.floor(F.col("la") * max_area_frac)))
        & (dep >= min_depth) & (dc >= min_dc)
        & ~(end & ~((off > 0.18 * F.col("wid")) & (dc >= max(min_dc, 0.20))))
        & ~((F.coalesce("_ex", F.lit(0)) / F.col("area") >= 0.45) & ~(off > 0.22 * F.col("wid")))
    )
    return C.keep(comp, j.where(ok))


REFINE_MODES = ("raw", "mask", "closed", "hull", "complete", "perforated")


def refine_leaf_mask(runs: DataFrame, frames: DataFrame, mode: str = "complete", erode_px: int = 1, open_px: int = 2,
                     divisor: float = 12.0, min_ratio: float = 0.002) -> DataFrame:
    """Leaf mask cleaned by mode, then reduced to its largest component.

    ``raw`` and ``mask`` fill holes, ``closed`` adds the adaptive closing,
    ``hull`` the convex hull, ``complete`` opens and erodes the closed mask,
    ``perforated`` does so without filling holes.
    """
    from .runs import close_adaptive, erode, morph_open

    if mode not in REFINE_MODES:
        raise ValueError(f"mode must be one of {REFINE_MODES}, got {mode!r}")
    keep_holes = mode == "perforated"
    fill = (lambda m: m) if keep_holes else (lambda m: C.fill_holes(m, frames))
    base = cut_lineage(fill(C.largest(runs)))
    out = base
    if mode in ("closed", "complete", "perforated", "hull"):
        closed = close_adaptive(base, frames, divisor)
        if mode == "hull":
            closed = mask_or(convex_hull(base).select(*base.columns), closed, base)
        out = fill(closed)
    if mode in ("hull", "complete", "perforated"):
        if open_px > 0:
            out = morph_open(out, ellipse_kernel(2 * open_px + 1), frames)
        if erode_px > 0:
            out = erode(out, ellipse_kernel(2 * erode_px + 1), frames)
        if mode != "hull":
            out = fill(out)
    out = C.remove_small(cut_lineage(out), frames, min_ratio)
    return C.largest(out)


def gap_severity(runs: DataFrame, frames: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Missing share of the hull per leaf, and the number of confirmed gaps."""
    hull = contour_lengths(hull_vertices(C.largest(runs)).withColumnRenamed("v", "i")).select("leaf_id", F.col("poly_area").alias("hull_area"))
    j = area(runs).join(hull, "leaf_id").select(
        "leaf_id",
        F.when(F.col("hull_area") < 1, 0.0).otherwise(
            F.least(F.greatest((F.col("hull_area") - F.col("area")) / F.col("hull_area"), F.lit(0.0)), F.lit(1.0))
        ).alias("severity"),
    )
    if gaps is None:
        return j
    n = gaps.where("confirmed").groupBy("leaf_id").agg(F.count("*").alias("n_regions"))
    return j.join(n, "leaf_id", "left").fillna(0, ["n_regions"]).withColumn("damaged", F.col("n_regions") > 0)
