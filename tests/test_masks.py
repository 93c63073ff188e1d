"""Golden masks and brute-force checks of the run algebra."""

import random

import pytest
from pyspark.sql import functions as F

from laminar.operators import components as C
from laminar.operators import contour as G
from laminar.operators import edits as E
from laminar.operators import raster as P
from laminar.operators import runs as R
from laminar.operators import synth as S

H = W = 14


def masks():
    """Hand-made masks plus random ones, as sets of (y, x)."""
    ring = {(y, x) for y in range(3, 9) for x in range(3, 9)} - {(y, x) for y in range(5, 7) for x in range(5, 7)}
    named = {
        "one": {(5, 5)}, "full": {(y, x) for y in range(H) for x in range(W)}, "diagonal": {(i, i) for i in range(6)},
        "ring": ring, "broken": ring - {(3, 5), (4, 5)}, "border": {(0, x) for x in range(W)} | {(H - 1, 3)},
        "plus": {(6, x) for x in range(4, 9)} | {(y, 6) for y in range(4, 9)},
    }
    rng = random.Random(7)
    for i in range(6):
        p = 0.25 + 0.1 * i
        named[f"random{i}"] = {(y, x) for y in range(H) for x in range(W) if rng.random() < p} or {(1, 1)}
    return dict(enumerate(named.values()))


MASKS = masks()


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(k, y, x) for k, m in MASKS.items() for y, x in m]
    return R.to_runs(spark.createDataFrame(rows, "leaf_id int, y int, x int")).cache()


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame([(k, H, W) for k in MASKS], "leaf_id int, h int, w int")


def as_sets(df):
    out = {k: set() for k in MASKS}
    for r in R.to_pixels(df).collect():
        out[r.leaf_id].add((r.y, r.x))
    return out


def flood(cells, conn):
    cells, groups = set(cells), []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (conn == 8 or a * b == 0)]
    while cells:
        todo, seen = [cells.pop()], set()
        while todo:
            c = todo.pop()
            seen.add(c)
            for d in steps:
                n = (c[0] + d[0], c[1] + d[1])
                if n in cells:
                    cells.remove(n)
                    todo.append(n)
        groups.append(seen)
    return groups


ALL = {(y, x) for y in range(H) for x in range(W)}


def test_round_trip_and_complement(runs, frames):
    assert as_sets(runs) == MASKS
    assert as_sets(R.mask_not(runs, frames)) == {k: ALL - m for k, m in MASKS.items()}


@pytest.mark.parametrize("conn", [4, 8])
def test_components_match_flood_fill(runs, conn):
    got = {}
    for r in C.components(runs, conn).collect():
        got.setdefault(r.leaf_id, {}).setdefault(r.comp, set()).update((r.y, x) for x in range(r.x0, r.x1))
    for k, m in MASKS.items():
        assert sorted(map(sorted, got[k].values())) == sorted(map(sorted, flood(m, conn)))


def test_components_across_bands(spark, monkeypatch):
    """A picture taller than a band is stitched to the same components."""
    monkeypatch.setattr(C, "BAND_ROWS", 4)
    rng = random.Random(3)
    cells = {(y, x) for y in range(30) for x in range(12) if rng.random() < 0.55}
    df = R.to_runs(spark.createDataFrame([(1, y, x) for y, x in cells], "leaf_id int, y int, x int"))
    got = {}
    for r in C.components(df, 8).collect():
        got.setdefault(r.comp, set()).update((r.y, x) for x in range(r.x0, r.x1))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, flood(cells, 8)))


def test_holes(runs, frames):
    want = {}
    for k, m in MASKS.items():
        inner = [g for g in flood(ALL - m, 4) if all(0 < y < H - 1 and 0 < x < W - 1 for y, x in g)]
        want[k] = m.union(*inner) if inner else m
    filled = C.fill_holes(runs, frames)
    assert as_sets(filled) == want
    assert as_sets(C.fill_holes(filled, frames)) == want


@pytest.mark.parametrize("k", [3, 5])
def test_morphology(runs, frames, k):
    offs = [(dy, dx) for dy, lo, hi in R.ellipse_kernel(k) for dx in range(-lo, hi + 1)]

    def grow(m):
        return {(y + a, x + b) for y, x in m for a, b in offs} & ALL

    def shrink(m):
        return m - grow(ALL - m)

    ker = R.ellipse_kernel(k)
    assert as_sets(R.dilate(runs, ker, frames)) == {i: grow(m) for i, m in MASKS.items()}
    assert as_sets(R.erode(runs, ker, frames)) == {i: shrink(m) for i, m in MASKS.items()}
    assert as_sets(R.morph_close(runs, ker, frames, 2)) == {i: shrink(shrink(grow(grow(m)))) for i, m in MASKS.items()}
    assert as_sets(R.close_then_open(runs, ker, frames)) == {
        i: grow(shrink(shrink(shrink(grow(grow(m)))))) for i, m in MASKS.items()
    }


def test_depth_is_euclidean(runs, frames):
    got = {}
    for r in P.depth(runs, frames, 5).collect():
        got[(r.leaf_id, r.y, r.x)] = r.d2
    for k, m in MASKS.items():
        for y, x in m:
            d = min(((y - a) ** 2 + (x - b) ** 2 for a, b in ALL - m), default=99)
            assert got[(k, y, x)] == min(d, 25)


def test_contour_walks_the_border(runs):
    got = {}
    for r in G.contour(runs).orderBy("leaf_id", "i").collect():
        got.setdefault(r.leaf_id, []).append((r.py, r.px))
    for k, path in got.items():
        big = max(flood(MASKS[k], 8), key=lambda g: (len(g), -min(g)[0], -min(g)[1]))
        assert set(path) <= big
        for a, b in zip(path, path[1:] + path[:1]):
            assert max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1
        # the outside reaches every border pixel of a walk
        assert {min(big)} <= set(path)


def test_hull_contains_mask_and_is_idempotent(runs):
    hull = as_sets(G.convex_hull(runs))
    for k, m in MASKS.items():
        big = max(flood(m, 8), key=lambda g: (len(g), -min(g)[0], -min(g)[1]))
        assert big <= hull[k]
    again = as_sets(G.convex_hull(G.convex_hull(runs)))
    assert again == hull


def test_synthetic_damage_stays_inside(spark):
    leaf = {(y, x) for y in range(40) for x in range(40) if ((y - 20) / 18) ** 2 + ((x - 20) / 12) ** 2 <= 1}
    df = R.to_runs(spark.createDataFrame([(1, y, x) for y, x in leaf], "leaf_id int, y int, x int"))
    fr = spark.createDataFrame([(1, 40, 40)], "leaf_id int, h int, w int")
    for out in (S.synth_holes(df, fr, 3, 1, 4, 3), S.synth_scallops(df, 3, 2.0, 4.0, 5.0), S.synth_bite(df)):
        px = {(r.y, r.x) for r in R.to_pixels(out).collect()}
        assert px < leaf
    bite = R.area(S.synth_bite(df)).first().area
    assert 0.10 <= 1 - bite / len(leaf) <= 0.30


def test_strokes_may_leave_the_picture(spark):
    discs = spark.createDataFrame([(1, 0, "add", 0, 0, 2), (1, 1, "remove", 1, 1, 1)], "leaf_id int, seq int, op string, cx int, cy int, r int")
    none = R.to_runs(spark.createDataFrame([(1, 9, 9)], "leaf_id int, y int, x int"))
    got = {(r.y, r.x) for r in R.to_pixels(E.apply_edits(none, E.disc_runs(discs))).collect()}
    big = {(y, x) for y in range(-2, 3) for x in range(-2, 3) if y * y + x * x <= 4}
    small = {(1, 1), (0, 1), (2, 1), (1, 0), (1, 2)}
    assert got == (big - small) | {(9, 9)}


def test_morphology_of_tall_pictures_moves_its_runs_once(spark):
    high, wide, rng = 3 * R.MORPH_ROWS + 5, 9, random.Random(11)
    near = {y + d for y in range(0, high, R.MORPH_ROWS) for d in range(-6, 7)}
    cells = {(y, x) for y in near for x in range(wide) if 0 <= y < high and rng.random() < 0.4}
    px = spark.createDataFrame([(k, "a", y, x) for k in (None, "p") for y, x in cells], "leaf_id string, kind string, y int, x int")
    runs = R.to_runs(px, keys=("leaf_id", "kind"))
    frames = spark.createDataFrame([("p", "a", high, wide), (None, "a", high, wide), ("q", "a", 2, 3)], "leaf_id string, kind string, h int, w int")
    every = {(y, x) for y in range(high) for x in range(wide)}
    kernel = R.square_kernel(4)
    offs = [(dy, dx) for dy, lo, hi in kernel for dx in range(-lo, hi + 1)]

    def grow(m):  # an even kernel looks at source = output + offset
        return {(y - a, x - b) for y, x in m for a, b in offs} & every

    closed, opened = R.morph_close(runs, kernel, frames), R.morph_open(runs, kernel, frames)
    for got, want in ((closed, every - grow(every - grow(cells))), (opened, grow(every - grow(every - cells)))):
        rows = R.to_pixels(got).collect()
        assert len(rows) == 2 * len(want)
        assert {(r.y, r.x) for r in rows if r.leaf_id == "p"} == {(r.y, r.x) for r in rows if r.leaf_id is None} == want
    stored = spark.createDataFrame(runs.collect(), runs.schema)
    plan = R.morph_close(stored, kernel, frames)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_layers_become_runs_without_sorting_scan_lines(spark):
    rng = random.Random(3)
    cells = {(k, rng.randrange(-2, 3), rng.choice((-40, -1, 0, 30, 31, 32, 33, 63, 64, 65, 128))) for k in range(4) for _ in range(20)}
    px = spark.createDataFrame(sorted(cells), "leaf_id int, y int, x int")
    named = {"all": F.lit(True), "odd": F.expr("x % 2 <> 0"), "none": F.lit(False)}
    out = R.to_runs(px, named)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert {(r.layer, r.leaf_id, r.y, x) for r in rows for x in range(r.x0, r.x1)} == {("all", *c) for c in cells} | {
        ("odd", *c) for c in cells if c[2] % 2
    }
    starts = {(r.layer, r.leaf_id, r.y, r.x0) for r in rows}
    assert len(starts) == len(rows) and not {(r.layer, r.leaf_id, r.y, r.x1) for r in rows} & starts
