"""Operators on sidecar texts against plain versions, and their defined edge cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from laminar.llm import chat, credentials, decontam, importance, lines, minhash, mixing, packing, shards, tokens
from laminar.llm.queries import vocabulary

LOW = {65 + i: 97 + i for i in range(26)}
SIDE = "image_id long, meta_text string, n_words string, kept int"


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def made(seed, n, vocab=40, longest=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(vocab)]
    return [" ".join(rng.choices(words, k=rng.randint(0, longest))) for _ in range(n)]


def sidecars(spark, texts):
    """Texts with extra columns whose names clash with results."""
    rows = texts if texts and isinstance(texts[0], tuple) else list(enumerate(texts))
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SIDE)


# --- near-duplicates ---------------------------------------------------------


def plain_groups(rows):
    sets = {}
    for i, t in rows:
        w = blank_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n):
    rng, out = random.Random(seed), []
    base = made(seed, 6, 60, 120)
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if w:
                w[rng.randrange(len(w))] = rng.choice("pqrst") * 3
        out.append(" ".join(w))
    return out


def test_near_duplicates_match_all_pairs(spark):
    rows = list(enumerate(near_copies(3, 150) + ["", None, "One two", "one TWO", "\t\n", "a b c d e", "word " * 3000]))
    got = minhash.near_duplicates(sidecars(spark, rows)).collect()
    want = plain_groups(rows)
    assert {r.image_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.image_id == r.component_id) for r in got)


def test_near_duplicates_edge_cases(spark):
    assert minhash.near_duplicates(sidecars(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f")]
    got = minhash.near_duplicates(sidecars(spark, rows)).collect()
    assert sorted((r.image_id or -1, r.component_id, r.kept) for r in got if r.image_id) == [
        (2, 2, True), (4, 2, False), (4, 2, False),
    ]
    assert [(r.component_id, r.kept) for r in got if r.image_id is None] == [(None, True)] * 2


def test_repeated_rows_are_compared_once(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(0, text)] * 1000 + [(1, text + " end")] * 1000 + [(2, "other words")] * 5
    got = {(r.image_id, r.component_id, r.kept, r.n_links) for r in minhash.near_duplicates(sidecars(spark, rows)).collect()}
    assert got == {(0, 0, True, 1), (1, 0, False, 1), (2, 2, True, 0)}


def test_superminhash_estimates_overlap():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 9000).astype(np.uint64)
    a, b = pool[:6000], pool[2000:8000]
    sig = minhash.superminhash([a, b, a[::-1], a[:1]], 512)
    assert (sig[0] == sig[2]).all() and (sig[3] >> np.uint64(32)).max() == 511
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.08


# --- passages ----------------------------------------------------------------


def test_passages_match_plain_search(spark):
    rng = random.Random(1)
    vocab = ["a", "b", "c", "dé", "zz"]
    items = [(k, " ".join(rng.choices(vocab[:4], k=rng.choice([0, 1, 3, 9, 10, 11, 14])))) for k in range(25)]
    texts = [" ".join(rng.choices(vocab, k=rng.choice([0, 1, 5, 30, 600]))) for _ in range(40)] + [None, "a", "A--b.c"]
    held_out = spark.createDataFrame([*items, (None, "b b b"), (99, None), (3, items[3][1])], "leaf_id long, leaf_text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for block_bytes in (1 << 20, 200):
        got = decontam.find_passages(sidecars(spark, texts), held_out, block_bytes=block_bytes).collect()
        assert len(got) == len(texts)
        for r in got:
            w = word.findall((r.meta_text or "").translate(LOW))
            hit, names = [False] * len(w), set()
            for k, t in items:
                own = word.findall(t.translate(LOW))
                m = min(10, len(own))
                windows = {tuple(own[j : j + m]) for j in range(len(own) - m + 1)} if own else set()
                for j in range(len(w) - m + 1) if windows else ():
                    if tuple(w[j : j + m]) in windows:
                        names.add(str(k))
                        hit[j : j + m] = [True] * m
            marked = [any(s.first <= j < s.end for s in r.spans) for j in range(len(w))]
            assert (r.n_words, marked, r.leaf_ids) == (len(w), hit, sorted(names))
            assert r.kept == 7


def test_passages_of_nothing(spark):
    none = spark.createDataFrame([], "leaf_id long, leaf_text string")
    got = decontam.find_passages(sidecars(spark, ["a b", None]), none).collect()
    assert [(r.n_words, r.spans, r.leaf_ids) for r in sorted(got, key=lambda r: r.image_id)] == [(2, [], []), (0, [], [])]
    assert decontam.find_passages(sidecars(spark, []), none).count() == 0


# --- lines -------------------------------------------------------------------


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return p + s >= min(len(a), len(b)) - (len(a) == len(b))


def plain_lines(rows, least=4):
    seen, out = [], {}
    for i, text in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        left = []
        for line in text.split("\n"):
            words = line.strip(" ").split(" ")
            if line.strip(" "):
                near = any(
                    words == other or (len(words) >= least and len(other) >= least and within_one(words, other))
                    for other in seen
                )
                seen.append(words)
                if near:
                    continue
            left.append(line)
        out[i] = "\n".join(left)
    return out


def test_lines_match_plain_version(spark):
    rng = random.Random(8)
    vocab = list("abcdef")
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 9))) for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(base).split(" ")
            kind, at = rng.randint(0, 5), rng.randrange(len(w))
            if kind == 0:
                w[at] = rng.choice(vocab)
            elif kind == 1:
                w.pop(at)
            elif kind == 2:
                w.insert(at, rng.choice(vocab))
            text.append(rng.choice(["", " "]) + " ".join(w))
        rows.append((i, "\n".join(text)))
    rows += [(70, None), (71, ""), (72, "\n\n x \n"), (73, "long " * 4000), (74, "long " * 3999)]
    want = plain_lines(rows)
    got = {r.image_id: r for r in lines.drop_duplicate_lines(sidecars(spark, rows), least_words=4).collect()}
    assert {i: r.meta_text for i, r in got.items() if i != 70} == want
    assert (got[70].meta_text, got[70].n_lines, got[70].n_dropped, got[70].kept) == (None, 0, 0, 7)
    assert got[72].n_lines == 1


def test_short_lines_are_compared_as_shipped(spark):
    nine = "a b c d e f g h i"
    rows = [(1, "Tolyoued with by of nteres atre are."), (2, "Anat with by of nteres atre are."), (3, nine), (4, nine + " j"),
            (5, "one two three"), (6, "one two four"), (7, "x y"), (8, "x z"), (9, "one two")]
    got = {r.image_id: r.n_dropped for r in lines.drop_duplicate_lines(sidecars(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 8: 0, 9: 0}


def test_lines_edge_cases(spark):
    assert lines.drop_duplicate_lines(sidecars(spark, [])).count() == 0
    got = lines.drop_duplicate_lines(sidecars(spark, [(None, "a\na"), (1, "a\na"), (1, "a\na"), (2, "a")])).collect()
    assert sorted((r.image_id or 0, r.meta_text) for r in got) == [(0, "a\na"), (1, "a"), (1, "a"), (2, "")]
    two = [(0, "alpha beta gamma"), (1, "new line of one text"), (1, "alpha beta gamma"), (2, "new line of one text")]
    got = [(r.image_id, r.n_dropped) for r in lines.drop_duplicate_lines(sidecars(spark, two)).collect()]
    assert sorted(got) == [(0, 0), (1, 0), (1, 1), (2, 1)]


# --- tokens, shards, packing ---------------------------------------------------

ODD = [
    "", None, "  ", "Don't we'LL go\x00\x1f \x85 naïve ÀÉÎ ×÷ª 東京 é ÁB <|endoftext|> <|ENDOFTEXT|> a|b 12ab3 --x-- Straße",
    "́x İstanbul ΣΑΣ 'S", "x" * 300, "word " * 5000, "​x\U0001f600ok   y", "“q” don’t…",
]


def test_encoder_equals_the_tokenizer():
    own = tokens.Encoder(vocabulary())
    texts = ODD + made(2, 40)
    ids, at = own.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_encoder_on_any_text(text):
    own = tokens.encoder(vocabulary())
    assert own.encode(pa.array([text]))[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["byte", "bit"]))
def test_planes_round_trip(ids, kind):
    array = np.array(ids, np.uint32)
    assert shards.ids_of(shards.planes_of(array, kind), len(array), kind).tolist() == ids


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_shards_round_trip(spark, kind):
    rows = [(9 - k, t) for k, t in enumerate(ODD)] + [(None, "last"), (-4, "neg"), (3, "same id")]
    got = shards.read_shards(shards.write_shards(sidecars(spark, rows), vocabulary(), kind)).collect()
    encode = tokens.encoder(vocabulary()).tokenizer.encode
    want, at = Counter(), 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    for i, t in rows:
        ids = np.array(encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.image_id, r.n_tokens, r.ids_crc32) for r in got) == want
    known = [r.image_id for r in sorted(got, key=lambda r: r.start)]
    assert known[0] is None and known[1:] == sorted(known[1:])
    assert shards.read_shards(shards.write_shards(sidecars(spark, []), vocabulary())).count() == 0
    with pytest.raises(ValueError):
        shards.unpack_shard(b"x" * 40)


def test_packing_is_whole_and_gapless(spark):
    rows = [*enumerate(ODD), (None, "x"), (1, "again"), *((100 + k, t) for k, t in enumerate(made(4, 120, 30, 90)))]
    got = packing.pack_sidecars(sidecars(spark, rows), vocabulary(), capacity=128).collect()
    encode = tokens.encoder(vocabulary()).tokenizer.encode
    want = Counter()
    for i, t in rows:
        ids = np.array(encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p, a in enumerate(range(0, len(ids), 128)):
            want[i, p, a, len(ids[a : a + 128]), zlib.crc32(ids[a : a + 128].tobytes())] += 1
    assert Counter((r.image_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= 1.02 * sum(r.length for r in got) / 128 + 2
    assert packing.pack_sidecars(sidecars(spark, []), vocabulary()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_once(counts):
    keys, first, offsets = packing.plan_sequences(counts, 64)
    used = {}
    for length, n in counts.items():
        for rank in range(n):
            want = length << 40 | rank
            k = int(np.searchsorted(keys, want, "right")) - 1
            used.setdefault(int(first[k] + want - keys[k]), []).append((int(offsets[k]), length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


# --- credentials ---------------------------------------------------------------


def test_credentials_and_verdicts(spark):
    key, own = "AKIA" + "A1B2C3D4E5F6", "Zx9Qw8Er7Ty6Ui5Op4As3"
    rows = [
        (1, f'say "password" : "{key}x" and é {key}', "p1", "ann"),
        (2, f"token=short1 API_KEY={'0123456789abcdef' * 2}", "p2", "bob"),
        (3, f"loose {own} here", "p3", "cat"), (4, "shared Mn8Bv7Cx6Za5Sd4Fg3Hj2", "p4", "dan"),
        (5, "shared Mn8Bv7Cx6Za5Sd4Fg3Hj2", "p5", "eve"), (6, None, None, None), (None, f"ſecret=abcdefgh1 {key}", None, "ann"),
        (8, "ſecret toKen = abcdefghij", "p", "x"),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "image_id long, meta_text string, project string, owner string, spans int")
    got = {r.image_id: [(s.kind, s.start, s.end, s.verdict) for s in r.spans] for r in credentials.scan_credentials(frame).collect()}
    assert [s[0] for s in got[1]] == ["assign", "access", "access"]
    assert got[1][2][:3] == ("access", len(rows[0][1]) - len(key), len(rows[0][1]))
    assert [s[0] for s in got[2]] == ["assign", "hex"] and got[2][0][3] == "live"
    assert [s[0] for s in got[3]] == ["owned"] and got[4] == got[5] == got[6] == []
    assert [s[0] for s in got[None]] == ["access"] and [s[0] for s in got[8]] == ["assign"]
    assert credentials.scan_credentials(frame.where("false")).count() == 0


# --- importance ------------------------------------------------------------------


def test_importance_keeps_wanted_and_drops_offensive(spark):
    rng = random.Random(3)
    good = made(6, 400, 300, 60)
    rows = [(i, t + (" " + " ".join(rng.choices(["idiot", "scum", "moron"], k=4)) if i % 4 == 0 else "")) for i, t in enumerate(good)]
    reviews = spark.createDataFrame(
        [(i, 1, int(i % 4 == 0)) for i, _ in rows if i < 300] + [(None, 1, 1), (5, None, 0)], "image_id long, usable int, offensive int"
    )
    got = {r.image_id: r for r in importance.resample(sidecars(spark, rows), reviews).collect()}
    held = [r for i, r in got.items() if i >= 300]
    assert sum(r.chosen for r in held if r.image_id % 4) >= 0.95 * sum(r.image_id % 4 > 0 for r in held)
    assert sum(r.chosen for r in held if r.image_id % 4 == 0) <= 2
    again = {r.image_id: r.draw for r in importance.resample(sidecars(spark, rows).repartition(5), reviews).collect()}
    assert again == {i: r.draw for i, r in got.items()}


def test_importance_edge_cases(spark):
    none = spark.createDataFrame([], "image_id long, usable int, offensive int")
    got = importance.resample(sidecars(spark, [(None, "a"), (1, None), (1, ""), (2, "b " * 9000)]), none).collect()
    assert len(got) == 4 and all(r.chosen and abs(r.log_weight) < 1e-9 for r in got)
    assert importance.resample(sidecars(spark, []), none).count() == 0


@pytest.mark.parametrize("k", [1, 7, 250, 499])
def test_kth_largest_is_exact(spark, k):
    rng = np.random.default_rng(k)
    values = sorted(rng.normal(size=480).tolist() + [0.5] * 20, reverse=True)
    frame = spark.createDataFrame([(v,) for v in values], "draw double")
    assert importance.kth_largest(frame, k, bins=8) == values[k - 1]


# --- language model ---------------------------------------------------------------


def test_scores_match_plain_counts(spark):
    texts = made(9, 80, 25, 50) + ["", None, "A a", "z" * 5000]
    frame = sidecars(spark, texts).selectExpr("*", "image_id % 5 = 1 as held_out", "'x' as score")
    got = mixing.score_sidecars(frame, block_bytes=2000).collect()
    count = Counter()
    for i, t in enumerate(texts):
        if i % 5 != 1:
            count.update([*blank_words(t), None])
    n, v = sum(count.values()), len(count)
    for r in got:
        words = [*blank_words(texts[r.image_id]), None]
        base = sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    again = {r.image_id: r.score for r in mixing.score_sidecars(frame.repartition(3), block_bytes=700).collect()}
    assert all(abs(again[r.image_id] - r.score) < 1e-3 for r in got)
    learned = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.bits_per_byte for r in learned) / len(learned) < 4
    assert mixing.score_sidecars(frame.where("false")).count() == 0


def test_model_is_a_distribution():
    pairs = np.zeros((256, mixing.SYMBOLS), np.int64)
    paths = mixing.huffman_paths(pairs)
    model = mixing.Model(paths, [np.zeros(2 << b, np.uint32) for b in mixing.TABLE_BITS])
    model.inputs = [np.random.default_rng(k).normal(size=len(x)).astype(np.float32) for k, x in enumerate(model.inputs)]
    ends = 10 ** model.score(pa.array([b""], pa.binary()))[0]
    # What remains after the end mark is the chance of all first bytes: of each, summed over everything that follows.
    first, length, nodes, bits = paths
    total = 0.0
    for byte in range(256):
        both = 10 ** model.score(pa.array([bytes([byte])], pa.binary()))[0]
        assert 0 < both < 1
        total += both
    assert 0 < ends < 1 and total < 1 - ends
    start = mixing.START * mixing.SYMBOLS
    kraft = sum(2.0 ** -int(n) for n in length[start : start + mixing.SYMBOLS])
    assert abs(kraft - 1) < 1e-12


def test_decisions_do_not_depend_on_later_text(monkeypatch):
    """Texts with a common beginning give its decisions the same probability, also inside a row that they share."""
    paths = mixing.huffman_paths(np.zeros((256, mixing.SYMBOLS), np.int64))
    known = pa.array([b"the leaf was eaten by a snail at night" * 3], pa.binary())
    tables = [np.zeros(2 << b, np.uint32) for b in mixing.TABLE_BITS]
    made = mixing.Decisions(known, paths)
    for k, table in enumerate(tables):
        np.add.at(table, made.slots(k) * 2 + made.bit, 9)
    model = mixing.Model(paths, tables)
    seen = []
    monkeypatch.setattr(mixing, "mixed", lambda *a, f=mixing.mixed: seen.append(f(*a)) or seen[-1])
    begin = b"the leaf was eaten by a snail at "
    for more in (b"night", b"\x01\x02", b"", b"\xff" * 40):
        model.score(pa.array([begin + more], pa.binary()))
    first, length, _, _ = paths
    before = [mixing.START, *begin[:-1]]
    n = sum(int(length[a * mixing.SYMBOLS + b]) for a, b in zip(before, begin))
    assert n % mixing.STRIDE and all(np.allclose(s[:n], seen[0][:n], atol=1e-6) for s in seen)


def test_counts_do_not_blur_on_large_input(spark):
    """Training text in letters of its own changes nothing for other texts, however many contexts it adds."""
    rng = random.Random(5)
    words = ["tree", "trunk", "twig", "tip", "thorn", "tendril", "tuber", "tissue"]
    rows = [(i, "t" + " ".join(rng.choices(words, k=30)), i % 4 == 0) for i in range(80)]
    foreign = "t" + "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(700_000))
    schema = "image_id long, meta_text string, held_out boolean"
    few, many = (
        {r.image_id: r.score for r in mixing.score_sidecars(spark.createDataFrame(x, schema)).where("image_id % 4 = 0").collect()}
        for x in (rows, [*rows, (1001, foreign, False)])
    )
    assert few.keys() == many.keys() and all(abs(few[i] - many[i]) < 0.1 for i in few)


def test_context_counts_are_exact():
    texts = pa.array(["abcabd abc", "abd", "", "abcabd" * 9])
    use = np.array([True, False, True, True])
    block = mixing.Block(texts)
    sizes, symbols, counts = block.counts(use)
    count = Counter()
    for text, on in zip(texts.to_pylist(), use):
        for i, symbol in enumerate([*text.encode(), mixing.END] if on else []):
            before = ([mixing.START] * 6 + list(text.encode()))[i : i + 6]
            count.update([(*before[-o:], symbol) for o in mixing.ORDERS])
    got = Counter()
    owner = np.repeat(block.keys, sizes)
    for key in {c[:-1] for c in count}:
        h = mixing._context(np.array(key), np.array([0, len(key)]), mixing.ORDERS.index(len(key)))[-1]
        for s, n in zip(symbols[owner == h], counts[owner == h]):
            got[(*key, int(s))] += int(n)
    assert got == count


# --- tool calls -------------------------------------------------------------------

LOG = "image_name string, seq int, kind string, edit_id string, after_id string, op string, body string, level string"


def test_edits_are_linked_ordered_and_checked(spark):
    rows = [
        ("p", 5, "request", "c", "b", "fill", '{"y": 2, "x": 1}'), ("p", 1, "request", "a", None, "fill", '{"x":1,"y":2}'),
        ("p", 3, "request", "b", "a", "fill", '{"x":"1","z":0}'), ("p", 2, "outcome", "a", None, None, "ok"),
        ("p", 9, "outcome", "a", None, None, "late"), ("p", 4, "outcome", "zz", None, None, "?"),
        ("p", 6, "request", "l1", "l2", "fill", '{"x":1,"y":1}'), ("p", 7, "request", "l2", "l1", "fill", '{"x":1,"y":1}'),
        ("p", 8, "request", "a", None, "erase", "[1"), ("q", 1, "request", "c", "nope", "fill", None),
        ("q", 2, "note", None, None, None, "hé \"x\"\n"), (None, 1, "request", None, None, None, '{"a":{"c":1,"b":[2]}}'),
    ]
    ops = spark.createDataFrame([("fill", "x", "integer", True), ("fill", "y", "integer", True)], "op string, name string, type string, required boolean")
    got = chat.link_edits(spark.createDataFrame([(*r, "9") for r in rows], LOG), ops).collect()
    by = {(r.image_name, r.seq): r for r in got}
    assert len(got) == len(rows)
    assert [by["p", s].level for s in (1, 3, 5, 6, 7)] == [0, 1, 2, None, None]
    assert by["p", 1].problems == [] and by["p", 1].outcome_seq == 2
    assert by["p", 3].problems == ["missing y", "no outcome", "type x", "unknown z"]
    assert by["p", 6].problems == ["cycle", "no outcome"]
    assert by["p", 8].problems == ["bad json", "repeated id", "unknown op"]
    assert by["p", 9].problems == ["repeated id"] and by["p", 4].problems == ["no request"]
    assert by["q", 1].problems == ["missing x", "missing y", "no outcome", "unknown after_id"]
    assert by["p", 5].message == '{"arguments":{"x":1,"y":2},"id":"c","kind":"request","op":"fill","outcome":null,"seq":5}'
    assert json.loads(by["q", 2].message)["content"] == 'hé "x"\n'
    assert '"arguments":{"a":{"b":[2],"c":1}}' in by[None, 1].message
    assert chat.link_edits(spark.createDataFrame([], LOG), ops).count() == 0


def test_digest_of_nothing_is_defined():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
