"""Steps that take whole leaves many at a time, against plain versions that take one."""

import random

import numpy as np
import pytest

from laminar.operators import bites as B
from laminar.operators import contour as G
from laminar.operators import runs as R


def plain_hull(points):
    """Corners from the leftmost on; cross products decide."""

    def half(pts):
        out = []
        for x, y in pts:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out

    pts = sorted(set(points))
    return half(pts)[:-1] + half(pts[::-1])[:-1] if len(pts) > 1 else pts


def plain_walk(cells):
    """Border of a set of (y, x), from the first pixel in scan order, looking around from behind the right hand."""
    steps = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
    y, x = min(cells)
    path, facing, first = [(x, y)], 0, None
    while True:
        ways = [(facing + 3 - t) % 8 for t in range(8)]
        d = next((d for d in ways if (y + steps[d][1], x + steps[d][0]) in cells), None)
        if d is None:
            return path
        if first is None:
            first = (x, y, d)
        elif (x, y, d) == first:
            return path[:-1]
        x, y, facing = x + steps[d][0], y + steps[d][1], d
        path.append((x, y))


def blob(rng, size):
    """A connected set of pixels with thin parts and holes."""
    cells = [(0, 0)]
    for _ in range(size):
        y, x = rng.choice(cells)
        cells.append((y + rng.choice((-1, 0, 1)), x + rng.choice((-1, 0, 1))))
    return set(cells)


def as_runs(cells):
    return [(y, x, x + 1) for y, x in sorted(cells)]


@pytest.mark.parametrize("passes", [24, 1])
def test_hulls_of_many_sets(monkeypatch, passes):
    monkeypatch.setattr(G, "PASSES", passes)
    rng = random.Random(4)
    sets = [[(rng.randrange(m), rng.randrange(m)) for _ in range(rng.randrange(1, 40))] for m in (1, 2, 5, 9, 50) for _ in range(60)]
    sets.append([(x, x * x) for x in range(40)] + [(40, -100000)])  # every corner but the ends goes, one after another
    flat = np.array([(i, x, y) for i, pts in enumerate(sets) for x, y in pts], np.int64)
    of, number, px, py = G.hulls(*flat.T)
    for i, pts in enumerate(sets):
        own = of == i
        assert list(zip(px[own].tolist(), py[own].tolist())) == plain_hull(pts)
        assert number[own].tolist() == list(range(own.sum()))


@pytest.mark.parametrize("canvas", [1 << 22, 200])
def test_walks_of_many_leaves(monkeypatch, canvas):
    monkeypatch.setattr(G, "CANVAS", canvas)
    rng = random.Random(5)
    leaves = [blob(rng, rng.choice((0, 1, 3, 10, 60))) for _ in range(120)] + [{(y, x) for y in range(30) for x in range(50)}]
    flat = np.array([(i, *run) for i, cells in enumerate(leaves) for run in as_runs(cells)], np.int64)
    found = [np.concatenate(c) for c in zip(*G.traces(*flat.T))]
    for i, cells in enumerate(leaves):
        own = found[0] == i
        assert found[1][own].tolist() == list(range(own.sum()))
        assert list(zip(found[2][own].tolist(), found[3][own].tolist())) == plain_walk(cells)


def test_farthest_pairs_of_many_sets():
    rng = random.Random(6)
    sets = [[(rng.randrange(m), rng.randrange(m)) for _ in range(rng.randrange(1, 30))] for m in (1, 3, 12) for _ in range(60)]
    flat = np.array([(i, x, y) for i, pts in enumerate(sets) for x, y in pts], np.int64)
    found = {int(r[0]): tuple(int(v) for v in r[1:]) for r in zip(*B.widest(*flat.T))}
    for i, pts in enumerate(sets):
        corners = sorted(plain_hull(pts), key=lambda p: p[::-1])
        pairs = [((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2, *a, *b) for k, a in enumerate(corners) for b in corners[k + 1 :]]
        assert found.get(i) == (max(pairs, key=lambda p: p[0]) if pairs else None)


def test_contours_and_hulls_of_a_table(spark):
    """Keys of any type, nulls among them, over batches of every size; no call per leaf."""
    rng = random.Random(7)
    leaves = {k: blob(rng, 40) for k in [*(f"leaf {i}" for i in range(30)), None]}
    rows = [(k, *run) for k, cells in leaves.items() for run in as_runs(cells)]
    rng.shuffle(rows)
    runs = R.merge(spark.createDataFrame(rows, "leaf_id string, y int, x0 int, x1 int"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        walked, corners = G._traced(runs), G.hull_vertices(runs)
        got = {"i": walked.collect(), "v": corners.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for column, plain in (("i", plain_walk), ("v", lambda cells: plain_hull([(x, y) for y, x in cells]))):
        for k, cells in leaves.items():
            own = sorted((r[column], r.px, r.py) for r in got[column] if r.leaf_id == k)
            assert [r[1:] for r in own] == plain(cells)
    for df in (walked, corners):
        assert "MapInArrow" in (plan := df._jdf.queryExecution().toString()) and "FlatMapGroupsInPandas" not in plan


@pytest.mark.parametrize("copies", [1 << 21, 50])
def test_elements_that_differ_by_leaf(spark, monkeypatch, copies):
    """A radius held in a key column gives each leaf what its own fixed element gives, across bands too."""
    monkeypatch.setattr(R, "COPIES", copies)
    rng = random.Random(8)
    height, width = R.MORPH_ROWS + 40, 30
    radii = {1: 1, 2: 3, 3: 3, 4: 7}
    rows = [
        (k, r, y, x, x + rng.randrange(1, 4)) for k, r in radii.items() for _ in range(90)
        for y, x in [(R.MORPH_ROWS + rng.randrange(-30, 30), rng.randrange(-2, width))]
    ]
    runs = R.merge(spark.createDataFrame(rows, "leaf_id int, _r int, y int, x0 int, x1 int"))
    frames = spark.createDataFrame([(k, r, height, width) for k, r in radii.items()], "leaf_id int, _r int, h int, w int")
    for step in (R.dilate, R.erode, R.morph_open, R.morph_close):
        together = step(runs, "_r", frames)
        assert "MapInArrow" in together._jdf.queryExecution().toString()
        got = {k: set() for k in radii}
        for r in together.collect():
            got[r.leaf_id] |= {(r.y, x) for x in range(r.x0, r.x1)}
        for k, radius in radii.items():
            alone = step(runs.where(f"leaf_id = {k}"), R.ellipse_kernel(2 * radius + 1), frames.where(f"leaf_id = {k}"))
            assert got[k] == {(r.y, x) for r in alone.collect() for x in range(r.x0, r.x1)}


def test_curvature_is_not_stored(spark, monkeypatch):
    """The 512 points of every leaf are far more than its border; only the latter is written down."""
    from laminar.plans import q_contour

    kept = []
    monkeypatch.setattr(q_contour, "cut_lineage", lambda df, f=q_contour.cut_lineage: kept.append(df.columns) or f(df))
    out = q_contour.contour_curvature(spark, "/root/testdata/sf0.001")
    assert set(out.columns) == {"leaf_id", "n", "k2", "k8", "k20", "k_thresh"}
    assert not [c for c in kept if "k20" in c]


def test_points_near_gaps_are_all_that_gaps_need(spark):
    """Candidates and scores of drawn leaves are the same from the points kept near concave ones."""
    from laminar.plans import fixtures

    cnt = G.contour(R.to_runs(fixtures.leaf_masks(spark, "/root/testdata/sf0.001").where("tissue = 1"))).cache()
    whole = G.curvature(G.resample(cnt)).cache()
    few = G.curvature(G.resample(cnt), near=G.MERGE_GAP).cache()
    thr = G.k_threshold(whole)
    low = {(r.leaf_id, r.i) for r in whole.where("k20 < 0").collect()}
    near = {(k, (i + d) % G.N_POINTS) for k, i in low for d in range(-G.MERGE_GAP, G.MERGE_GAP + 1)}
    assert low and {(r.leaf_id, r.i) for r in few.collect()} == near and len(near) < whole.count()

    def found(points):
        gaps = G.gap_candidates(points, thr)
        depths = gaps.selectExpr("leaf_id", "gap_id", "20.0 as defect_depth")
        return sorted(map(tuple, G.score_gaps(gaps, points, thr, depths).collect()))

    assert found(few) == found(whole) != []


def test_strokes_and_bridges_take_many_leaves_a_call(spark):
    """Strokes against distances, for lines that are few rows in one file; no generated method or call per leaf."""
    from laminar.operators import shapes as S

    rng = random.Random(10)
    lines = [(k, *[rng.randrange(0, 30) for _ in range(4)]) for k in range(40)] + [(40, 5, 5, 5, 5), (41, 3, 7, 20, 7), (42, 6, 2, 6, 9)]
    df = spark.createDataFrame([*lines, (43, None, 1, 2, 3)], "leaf_id int, ax int, ay int, bx int, by int").coalesce(1)
    for thickness in (1.0, 3.0):
        strokes = S.stroke_runs(df, thickness)
        assert "MapInArrow" in strokes._jdf.queryExecution().toString()
        got = {}
        for r in strokes.collect():
            got.setdefault(r.leaf_id, set()).update((r.y, x) for x in range(r.x0, r.x1))
        for k, ax, ay, bx, by in lines:
            dx, dy = bx - ax, by - ay
            want = set()
            for y in range(-3, 34):
                for x in range(-3, 34):
                    t = min(1, max(0, ((x - ax) * dx + (y - ay) * dy) / ((dx * dx + dy * dy) or 1)))
                    if (x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2 <= thickness**2 / 4 + 1e-9:
                        want.add((y, x))
            assert got.get(k, set()) == want
    square = spark.createDataFrame([(k, y, 2, 30 if y < 10 or y > 20 else 10) for k in (1, 2) for y in range(2, 30)], "leaf_id int, y int, x0 int, x1 int")
    frames = spark.createDataFrame([(1, 40, 40), (2, 40, 40)], "leaf_id int, h int, w int")
    added = S.bridge_gaps(square, frames)
    assert "FlatMapCoGroupsInPandas" not in added._jdf.queryExecution().toString()


def test_levels_of_a_leaf_in_one_pass(spark):
    """Percentile, mean and threshold counted together are those found one by one."""
    from pyspark.sql import functions as F

    from laminar.operators import raster as P

    rng = random.Random(11)
    rows = [(k, *[rng.choice((rng.randrange(256), 20, 200)) for _ in range(3)]) for k in range(5) for _ in range(rng.choice((1, 2, 150)))]
    px = spark.createDataFrame(rows, "leaf_id int, gray int, b int, blue int")
    one = P.pct(px, "gray", 0.9).join(px.groupBy("leaf_id").agg(F.avg("b").alias("mean")), "leaf_id").join(P.otsu(P.histogram(px, "blue")), "leaf_id")
    got = P.leaf_levels(px, ("gray", 0.9), "b", "blue")
    assert got.columns == one.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))
