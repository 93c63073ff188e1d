"""Files, streams and queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from laminar.operators import contour as G
from laminar.sources import metadata as MD
from laminar.sources import photos as P
from laminar.sources import results as RS
from laminar.streaming import flows

SF = "/root/testdata/sf0.001"
QUICK = ["pixels_to_runs", "hole_filling", "scale_lookup", "image_rollup", "name_parsing", "leaf_damage_results"]


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    cur = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)

    def key(rows):
        return sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows), key=repr)

    assert key(df.select(*cols).collect()) == key(cur.fetchall())


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_photo_folder(spark, tmp_path):
    (tmp_path / "IMG_10.jpg").write_bytes(b"\xff\xd8\xff\xe0" + b"0" * 40)
    (tmp_path / "IMG_2.txt").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 40)
    (tmp_path / "notes.txt").write_bytes(b"hello world")
    got = [r.photo_id for r in P.read_photos(spark, str(tmp_path)).orderBy("sort_key").collect()]
    assert got == ["IMG_2.txt", "IMG_10.jpg"]
    bad = {r.name: r.reason for r in P.format_issues(P.with_magic(P.list_files(spark, str(tmp_path), True))).collect()}
    assert set(bad) == {"IMG_2.txt", "notes.txt"}


def test_metadata_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"scale_factor": 0.5, "pre_ratio": [2.0, 2.0], "circle": {"found": true}}')
    (tmp_path / "b.json").write_text('{"image_id": "x", broken')
    got = MD.read_seg_meta(spark, str(tmp_path)).collect()
    assert [(r.image_id, r.pre_scale, r.scale_source) for r in got] == [("a", 2.0, "original_photo")]


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("10_a.png", 5.0), ("2_b.png", 1.5), ("x.png", 0.0)], "image_name string, damage_pct double")
    RS.write_results(rows.coalesce(1), str(tmp_path / "r"))
    back = RS.read_results(spark, str(tmp_path / "r"))
    assert {(r.image_name, r.damage_pct, r.leaf_area_cm2) for r in back.collect()} == {("10_a.png", 5.0, None), ("2_b.png", 1.5, None), ("x.png", 0.0, None)}
    with pytest.raises(ValueError):
        RS.write_measurements(rows.limit(0), str(tmp_path / "m.csv"))


def test_photo_stream_drops_repeated_leaves(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in ("a.jpg", "a_white_bg.png", "b.jpg"):
        (src / n).write_bytes(b"x")
    out = flows.dedupe_stream(flows.stream_photos(spark, str(src))).select("leaf_id")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.leaf_id for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b"]


def test_budget_fill_is_greedy(spark):
    cands = spark.createDataFrame([(1, 1, 9.0, 50), (1, 2, 8.0, 60), (1, 3, 7.0, 40), (1, 4, 6.0, 5)], "leaf_id int, cand_id bigint, depth double, area bigint")
    budget = spark.createDataFrame([(1, 95)], "leaf_id int, budget bigint")
    assert sorted(r.cand_id for r in G.budget_fill(cands, budget).collect()) == [1, 3, 4]


def test_bad_roi_mode(spark):
    with pytest.raises(ValueError):
        G.expand_roi(spark.createDataFrame([(1, 1, 0, 3)], "leaf_id int, y int, x0 int, x1 int"), "sideways", spark.createDataFrame([(1, 4, 4)], "leaf_id int, h int, w int"))
