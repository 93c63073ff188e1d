"""Nearest descriptors against brute force, and the pipeline against a plain version of its stages."""

import os
import subprocess
import sys

import numpy as np
import pytest

import corpus_pipeline
from laminar.llm import vptree
from laminar.llm.graph import smallest_reachable

KIND = "leaf_id long, curvature array<double>, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], KIND)


def plain(rows, queries, k):
    sound = {i: np.array(v, float) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = {}
    for q in queries:
        if q in sound:
            order = sorted((-float(np.dot(sound[q], x)), i) for i, x in sound.items() if i != q)[:k]
            out[q] = [(i, round(-s, 9)) for s, i in order]
    return out


@pytest.mark.parametrize("shard_rows", [4096, 40])
def test_factor_one_is_exact(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(vptree, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(vptree, "LEAF", 5)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.5]) for i in range(60)]  # a common vector
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (None, [1.0] * 6)]
    table = frame(spark, rows)
    got = {}
    for r in vptree.nearest_leaves(table, table.where("leaf_id % 5 = 0"), k=7, factor=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.leaf_id, round(r.score, 9)))
    want = plain(rows, [i for i, _ in rows if i is not None and i % 5 == 0], 7)
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == want


def test_few_candidates_and_empty_tables(spark):
    table = frame(spark, [(0, [1.0, 0.0]), (5, [0.5, 0.5]), (7, [0.0, -2.0])])
    got = sorted(tuple(r)[:3] for r in vptree.nearest_leaves(table, table.where("leaf_id = 0"), k=20).collect())
    assert got == [(0, 1, 5), (0, 2, 7)]
    assert vptree.nearest_leaves(table.where("false"), table, k=3).count() == 0
    assert vptree.nearest_leaves(table, table.where("false"), k=3).count() == 0
    alone = table.where("leaf_id = 0")
    assert vptree.nearest_leaves(alone, alone, k=3).count() == 0


def test_repeated_ids_ask_with_the_smallest_descriptor(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).round(3).tolist()) for i in range(200)]
    twice = [(i, rng.normal(size=4).round(3).tolist()) for i in range(0, 200, 10)]
    table = frame(spark, rows + twice + rows[:40])
    got = {}
    for r in vptree.nearest_leaves(table, table.where("leaf_id % 10 = 0"), k=5, factor=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.leaf_id, round(r.score, 9)))
    for i, other in twice:
        asked = min(rows[i][1], other)
        scores = {}
        for j, v in rows + twice:
            if j != i:
                scores.setdefault(j, []).append(float(np.dot(asked, v)))
        near = sorted((-s, j) for j, all_of in scores.items() for s in all_of)[:5]
        assert [(j, s) for _, j, s in sorted(got[i])] == [(j, round(-s, 9)) for s, j in near]


def test_package_reaches_workers_of_operators_called_first(tmp_path):
    """From another folder, without the queries: each operator with Python workers on a table of its own."""
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from laminar.llm import minhash
texts = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "image_id long, meta_text string")
print("rows", minhash.near_duplicates(texts).count())
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 2" in done.stdout, done.stderr[-2000:]


def test_relaxed_search_finds_most(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(1500, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    table = frame(spark, rows)
    found = vptree.nearest_leaves(table, table.where("leaf_id % 20 = 0")).collect()
    want = plain(rows, range(0, 1500, 20), 20)
    hits = sum(r.leaf_id in {i for i, _ in want[r.query_id]} for r in found)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_chains_are_contracted(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)]
    got = {r.node: r.root for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_pipeline_stages(spark, tmp_path):
    docs = "doc_id long, text string, lang string, source string, n_chars long"
    clean = [(i, f"w{i}a w{i}b w{i}c w{i}d w{i}e w{i}f w{i}g w{i}h w{i}i w{i}j w{i}k") for i in range(40)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [
        *clean, (50, clean[0][1]), (51, f"{passage}\nown words of fifty one"), (52, f"{passage}\nother words here"),
        (53, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"), (54, None), (55, ""), (None, "no id here"),
    ]
    for name, data, schema in (
        ("documents", [(i, t, "en", "s", len(t or "")) for i, t in rows], docs),
        ("labels", [(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10")], "item_id long, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing",
    ]
    table, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
        left[name] = {r.doc_id for r in table.collect()}
        if name == "line_dedup":
            texts = {r.doc_id: (r.text, r.n_chars) for r in table.collect()}
        if name != "best_fit_packing":
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    everything = {i for i, _ in rows}
    assert left["quality_classifier"] == everything
    assert left["line_dedup"] == everything - {50}
    assert texts[52] == ("other words here", 16) and texts[51][0].startswith("p0 p1")
    assert left["minhash_near_dedup"] == left["line_dedup"]
    assert left["benchmark_decontamination"] == left["line_dedup"] - {53}
    assert left["best_fit_packing"] == left["benchmark_decontamination"]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == left["best_fit_packing"]
