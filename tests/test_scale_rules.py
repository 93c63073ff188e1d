"""Cases in which rows or settings of one picture must not touch another's, and restartable streams."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from laminar.functions import naming as N
from laminar.operators import circles as O
from laminar.operators import components as C
from laminar.operators import contour as G
from laminar.operators import measure as M
from laminar.operators import raster as P
from laminar.sources import photos as PH
from laminar.streaming import flows

RUN = "leaf_id string, y int, x0 int, x1 int"


def square(leaf, at, side):
    return [(leaf, y, at, at + side) for y in range(at, at + side)]


def test_feather_follows_the_own_picture(spark):
    def pixels(leaf, n):
        return [(leaf, y, x, *((255, 255, 255) if (x + y) % 3 else (40, 120, 40))) for y in range(n) for x in range(n)]

    big, small = pixels("big", 110), pixels("small", 12)
    sizes = [("big", 110, 110), ("small", 12, 12)]
    schema = "leaf_id string, y int, x int, r int, g int, b int"

    def sums(rows, frames):
        out, _ = P.normalise_bg(spark.createDataFrame(rows, schema), spark.createDataFrame(frames, "leaf_id string, h int, w int"))
        return {r.leaf_id: r.s for r in out.groupBy("leaf_id").agg(F.sum("r").alias("s")).collect()}

    both = sums(big + small, sizes)
    assert both == sums(big, sizes[:1]) | sums(small, sizes[1:])


def test_picture_taller_than_a_band(spark):
    rows = [("tall", y, 5 + (y // 3) % 2, 9) for y in range(2600) if y % 1100 != 1099]
    stats = C.components(spark.createDataFrame(rows, RUN)).groupBy("comp").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    assert sorted((r.a, r.b) for r in stats.collect()) == [(0, 1098), (1100, 2198), (2200, 2599)]


def test_null_keys_and_wide_pictures(spark):
    runs = spark.createDataFrame([(None, 0, 0, 2), (None, 1, 1, 3), ("a", 0, 0, 1)], RUN)
    assert C.components(runs).select("leaf_id", "comp").distinct().count() == 2
    with pytest.raises(Exception, match="wider"):
        C.components(spark.createDataFrame([("a", 0, 1 << 21, (1 << 21) + 1)], RUN)).count()


def test_names_with_separators_keep_their_rows(spark):
    names = ["a#b", "a|b", "plain"]
    mask = spark.createDataFrame([r for n in names for r in square(n, 4, 12)], RUN)
    frames = spark.createDataFrame([(n, 40, 40) for n in [*names, "empty"]], "leaf_id string, h int, w int")
    got = {r.leaf_id: (r.found, r.reason) for r in O.circle_from_mask(mask, frames).collect()}
    assert set(got) == {*names, "empty"}
    assert got["empty"] == (False, "empty_mask") and got["a#b"] == got["plain"]


def test_one_pixel_leaf_keeps_its_contour(spark):
    pts = G.resample(G.contour(spark.createDataFrame([("dot", 3, 7, 8)], RUN)), 16).collect()
    assert len(pts) == 16 and {(r.px, r.py) for r in pts} == {(7.0, 3.0)}


def test_gap_in_an_excluded_zone_is_not_confirmed(spark):
    gaps = spark.createDataFrame(
        [("a", 1, 0, 9, 10, -0.1, -0.9, 5.4, 6.6, 4.0, 45.0), ("a", 2, 30, 39, 10, -0.1, -0.9, 25.0, 26.0, 4.0, 45.0)],
        "leaf_id string, gap_id int, start_idx int, end_idx int, n_pts int, k_thresh double, k_min double, cx double, cy double, width_px double, depth_proxy double",
    )
    points = spark.createDataFrame([("a", i, float(i), 0.0, -1.0 if i < 10 else 1.0) for i in range(60)], "leaf_id string, i int, px double, py double, k20 double")
    thr = spark.createDataFrame([("a", -0.1)], "leaf_id string, k_thresh double")
    depths = spark.createDataFrame([("a", 1, 40.0), ("a", 2, 40.0)], "leaf_id string, gap_id int, defect_depth double")
    zone = spark.createDataFrame([("a", 6, 5, 6), ("a", 6, 0, 3)], RUN)
    kinds = spark.createDataFrame([("a", "lobed")], "leaf_id string, morphology string")

    def verdict(**more):
        return {r.gap_id: (r.confirmed, r.depth) for r in G.score_gaps(gaps, points, thr, depths, **more).collect()}

    assert verdict()[1][0] and verdict()[2][0]
    out = verdict(excluded=zone, morphology=kinds)
    assert not out[1][0] and out[2][0]
    assert out[2][1] < verdict()[2][1]


def test_images_without_candidates_are_reported(spark):
    cands = spark.createDataFrame([("p", 1, "m", 20.0, 300.0, 0.7)], "image_id string, method_rank int, method string, diameter_px double, area_px double, score double")
    images = spark.createDataFrame([("p",), ("q",)], "image_id string")
    got = {r.image_id: (r.found, r.low_confidence) for r in M.best_circle(cands, images).collect()}
    assert got == {"p": (True, False), "q": (False, True)}


def test_long_numbers_sort_as_numbers(spark):
    names = ["p" + "9" * 39, "p1" + "0" * 40, "p007", "p12"]
    frame = spark.createDataFrame([(n,) for n in names], "name string").orderBy(N.natural_key("name"))
    assert [r.name for r in frame.collect()] == ["p007", "p12", "p" + "9" * 39, "p1" + "0" * 40]


def test_edits_out_of_order_and_after_a_restart(spark, tmp_path):
    first = spark.createDataFrame([("p", 0, None), ("q", 5, None)], "image_name string, damage_px long, last_seq long")
    log = str(tmp_path / "log")
    batches = [[("p", 3, 30)], [("p", 1, 10), ("q", 2, 20)], [("p", 4, 40), ("r", 9, 9)]]
    schema = "image_name string, seq long, damage_px long"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        store = flows.VersionedResults(spark, str(tmp_path / "out"), first)  # a new process each time
        stream = spark.readStream.schema(schema).parquet(log)
        flows.stream_upsert(stream, store.read, store.write, str(tmp_path / "state")).awaitTermination()
    store = flows.VersionedResults(spark, str(tmp_path / "out"), first)
    assert sorted(tuple(r) for r in store.read().collect()) == [("p", 40, 4), ("q", 20, 2)]
    assert sorted(tuple(r) for r in store.read(2).collect()) == [("p", 30, 3), ("q", 20, 2)]


def test_only_unknown_extensions_are_opened(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"not read")
    (tmp_path / "b.dat").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 90)
    (tmp_path / "c.txt").write_bytes(b"words")
    got = {r.photo_id: r.magic for r in PH.read_photos(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": None, "b.dat": "PNG"}


def test_photos_with_unusual_names_are_sniffed(spark, tmp_path):
    names = ["with space", "leaf#1", "leaf%41", "leaf[1]", "leaf{a,b}", "leaf?*", "back\\\\slash", "é"]
    (tmp_path / "a #folder%20").mkdir()
    for n in names:
        (tmp_path / "a #folder%20" / n.replace("\\\\", "")).write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 90)
    (tmp_path / "a #folder%20" / "words here").write_bytes(b"no picture at all")
    got = {r.photo_id: r.magic for r in PH.read_photos(spark, str(tmp_path / "a #folder%20")).collect()}
    assert got == {n.replace("\\\\", ""): "PNG" for n in names}


def test_a_failed_read_is_not_dropped(spark, tmp_path):
    (tmp_path / "b.dat").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 90)
    files = PH.list_files(spark, str(tmp_path)).localCheckpoint()
    (tmp_path / "b.dat").unlink()
    with pytest.raises(Exception):
        PH.with_heads(files).collect()


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from laminar.session import local_session\n"
        "import __spark_entry__ as e\n"
        "print('rows', e.queries()['component_statistics'](local_session(2, memory='2g'), '/root/testdata/sf0.001').count())\n"
    ) % sys.path[0]
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = code.replace(repr(sys.path[0]), repr(root))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in out.stdout, out.stderr[-2000:]
