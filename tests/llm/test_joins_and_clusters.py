"""Jaccard join, centroid clustering and spelling variants against brute force, on sidecar texts and descriptors."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from laminar.llm import setjoin
from laminar.llm.clusters import Centres, cluster_descriptors
from laminar.llm.setjoin import similar_sidecars
from laminar.llm.spelling import near_words, spelling_variants, word_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- Jaccard join ------------------------------------------------------------------------------------------------------


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def joined(rows, percent=80):
    """Expected ``{row: (n_shingles, component)}`` by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
            continue
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    return Counter((k, len(s), None if k is None else min(least[find(i)])) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def check_join(spark, rows, percent=80):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "image_id long, meta_text string, num string, component_id long")
    got = similar_sidecars(table, percent=percent)
    assert Counter((r.image_id, r.n_shingles, r.component_id) for r in got.collect()) == joined(rows, percent)


def edited(rng, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return out


@pytest.mark.parametrize("seed,percent,rounds", [(1, 80, 6), (2, 60, 0), (3, 90, 1)])
def test_join_equals_all_pairs(spark, monkeypatch, seed, percent, rounds):
    monkeypatch.setattr(setjoin, "ROUNDS", rounds)
    rng = random.Random(seed)
    vocabulary = [f"leaf{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(30)]  # a common run parameter block
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 7)):
            body = edited(rng, base, rng.randrange(0, 3), vocabulary)
            rows.append((n, " ".join(body + passage * (rng.random() < 0.5))))
            n += 1
    rows += [(n, "one two"), (n + 1, "ONE  two"), (n + 2, ""), (n + 3, None), (n + 4, " \t "), (None, "one two"), (0, rows[5][1])]
    rows.append((n + 5, " ".join(f"long{i}" for i in range(20000))))
    rows.append((n + 6, " ".join(f"long{i}" for i in range(20001))))
    check_join(spark, rows, percent)


def test_join_of_a_large_group(spark):
    """Near copies of one text whose pairs lie on both sides of the threshold, and many copies of one row."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 4), vocabulary))) for i in range(120)]
    rows += [(500, " ".join(base))] * 50 + [(600 + i, " ".join(base[:40] + [f"own{i}x{k}" for k in range(40)])) for i in range(60)]
    check_join(spark, rows)


def check_links(spark, rows, percent=80):
    """``n_links`` counts the other sets that meet the threshold, whether or not one leader joins them."""
    table = spark.createDataFrame(rows, "image_id long, meta_text string")
    sets = [shingles(t) for _, t in rows]
    kinds = {s for (key, _), s in zip(rows, sets) if s and key is not None}
    met = {s: sum(s != o and 100 * len(s & o) >= percent * len(s | o) for o in kinds) for s in kinds}
    want = Counter((key, 0 if key is None else met.get(s, 0)) for (key, _), s in zip(rows, sets))
    assert Counter((r.image_id, r.n_links) for r in similar_sidecars(table, percent=percent).collect()) == want


@pytest.mark.parametrize("tile,percent", [(2048, 80), (7, 80), (16, 60)])
def test_all_links_are_counted(spark, monkeypatch, tile, percent):
    monkeypatch.setattr(setjoin, "TILE", tile)
    rng = random.Random(tile)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(0, 4), vocabulary) + vocabulary[: i % 30])) for i in range(90)]
    rows += [(200 + i, " ".join(base[i:])) for i in range(0, 40, 2)] + [(300 + i, " ".join(base)) for i in range(5)]
    rows += [(None, " ".join(base)), (400, "one two"), (401, "One two"), (402, ""), (403, None)]
    check_links(spark, rows, percent)


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], "image_id long, meta_text string")
    assert similar_sidecars(empty).count() == 0
    check_join(spark, [(1, None), (2, "")])


# -- centroid clustering -----------------------------------------------------------------------------------------------


def clustered(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(p) for _, p in order[:k]]

    def assign():
        out = []
        for i, p in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(p, q)), c) for c, q in enumerate(centres))
            out.append((i, c, d, p))
        return out

    for _ in range(rounds):
        drawn = defaultdict(list)
        for _, c, _, p in assign():
            drawn[c].append(p)
        for c, points in drawn.items():
            centres[c] = [sum(col) // len(points) for col in zip(*points)]
    final = assign()
    inertia = Counter()
    for _, c, d, _ in final:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), tuple(centres[c])) for i, c, d, _ in final)


KIND = "leaf_id long, curvature array<float>, cluster string, centroid int"


def check_clusters(spark, rows, **kw):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)
    got = Counter((r.leaf_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in cluster_descriptors(table, **kw).collect())
    assert got == clustered(rows, kw.get("clusters", 8), kw.get("rounds", 10), kw.get("components", 64))


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    mid = rng.normal(size=(5, 64))
    points = (mid[rng.integers(0, 5, 250)] + rng.normal(size=(250, 64)) * 0.3).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [rows[3]] * 40 + [(900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [None] + [0.0] * 63), (904, [float("inf")] * 64)]
    rows += [(None, [0.5] * 64), (905, [0.0] * 64)]
    check_clusters(spark, rows)


def test_clusters_with_ties_and_few_descriptors(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(18)]
    check_clusters(spark, grid, clusters=4, rounds=3, components=2)
    check_clusters(spark, [(1, [0.0, 0.0])] * 5, clusters=4, rounds=2, components=2)
    check_clusters(spark, grid[:2], clusters=4, rounds=2, components=2)
    assert cluster_descriptors(spark.createDataFrame([], KIND)).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        cluster_descriptors(spark.createDataFrame([(1, [1e9, 0.0], "x", 1)], KIND), components=2).count()


def test_ptolemaic_bounds_hold():
    rng = np.random.default_rng(8)
    pivots = rng.integers(-2000, 2000, (6, 16)).tolist()
    centres = rng.integers(-2000, 2000, (9, 16)).tolist() + pivots[:2]
    points = np.vstack([rng.integers(-2000, 2000, (400, 16)), np.array(centres), np.array(pivots)])
    now = Centres(centres, pivots)
    cached = np.sqrt(np.stack([((points - np.array(p)) ** 2).sum(axis=1) for p in pivots], axis=1))
    exact = ((points[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
    lower = now.lower(cached)
    assert (lower <= exact).all() and (lower > 0.2 * exact).mean() > 0.1
    label, best = now.assign(points, cached)
    assert (best == exact.min(axis=1)).all() and (label == exact.argmin(axis=1)).all()


# -- spelling variants -------------------------------------------------------------------------------------------------


def counted(rows, slip):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) - len(s) == 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def variants(words):
    near = defaultdict(list)
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


def check_spelling(spark, rows, slip=None):
    table = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "image_id long, meta_text string, word string, n int")
    got = [tuple(r) for r in spelling_variants(table, slip=slip).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    want = variants(counted(rows, slip))
    assert len(got) == len(want) and set(got) == want


def test_spelling_equals_brute_force(spark):
    rng = random.Random(4)
    letters = "abcdéÿøß"
    stock = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 8))) for _ in range(120)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(60):
            w = rng.choice(stock[: rng.choice((10, 120))])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]))
            text.append(w if rng.random() < 0.8 else w.upper())
        rows.append((i, rng.choice((" ", "-", ", ", "7")).join(text)))
    rows += [(900, None), (901, ""), (902, "Āā 123"), (None, "without without without"), rows[0], rows[0]]
    check_spelling(spark, rows, slip=7)
    check_spelling(spark, rows)


def test_spelling_chains_and_edges(spark):
    chain = " ".join(w for k, w in enumerate(("quercusaa", "quercusab", "quercuscb", "quercdscb", "queradscb")) for _ in range(3 * 2**k))
    check_spelling(spark, [(1, chain), (2, "x" * 200000), (3, "ééééé " * 4 + "éééé " * 9 + "×÷×÷× " * 3)])
    check_spelling(spark, [(1, "Anna anna ANNA"), (2, None)])
    assert spelling_variants(spark.createDataFrame([], "image_id string, meta_text string")).count() == 0


def test_every_near_pair_meets(spark):
    """All words one edit from each other are found, whatever the edit and its place."""
    base = "querces"
    around = {base[:i] + c + base[i + d :] for i in range(len(base) + 1) for c in ("", "a", "é", "q") for d in (0, 1)}
    words = {w: 3 for w in around if len(w) >= 5}
    table = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    got = {tuple(sorted((r.a, r.b))) for r in near_words(table).collect()}
    assert got == {tuple(sorted(p)) for p in combinations(words, 2) if one_edit(*p)}
    assert word_counts(spark.createDataFrame([(1, "Leaf leaf_leaf LEAFS")], "image_id long, meta_text string"), 1, 4).count() == 2
