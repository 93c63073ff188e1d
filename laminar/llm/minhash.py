"""Near-duplicate sidecar texts: SuperMinHash signatures, banding, verification and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .graph import smallest_reachable
from .store import stored
from .text import BLANK_TABLE, GOLDEN, Words, mix, shingle_sets, slices

BLOCK = 4096  # set elements signed at once; their permutations stay in cache
_LOW32, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)


def superminhash(sets: list[np.ndarray], hashes: int, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures, one row of ``hashes`` ranks per non-empty set.

    Each element walks a random permutation of the positions.  At step j it offers j plus a random fraction to the
    j-th position; a position keeps its smallest offer.  A set stops as soon as all its positions hold less than the
    next step could offer, so large sets need few steps.  Ranks are fixed-point: the step above 32 bits of fraction.
    """
    count = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), hashes), np.iinfo(np.uint64).max, np.uint64)
    place = np.arange(hashes, dtype=np.uint16)
    begin = 0
    while begin < len(sets):
        end, load = begin + 1, int(count[begin])
        while end < len(sets) and load + count[end] <= BLOCK:
            load += int(count[end])
            end += 1
        if count[begin] > BLOCK:  # one large set, in parts: minima of parts are minima of the whole
            for part in range(0, int(count[begin]), BLOCK):
                piece = sets[begin][part : part + BLOCK]
                np.minimum(out[begin], _sign(piece, np.zeros(len(piece), np.int64), 1, place, seed)[0], out[begin])
        else:
            owner = np.repeat(np.arange(end - begin), count[begin:end])
            out[begin:end] = _sign(np.concatenate(sets[begin:end]), owner, end - begin, place, seed)
        begin = end
    return out


def _step(j: int) -> np.uint64:
    return np.uint64(j * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)


def _sign(elements: np.ndarray, owner: np.ndarray, n: int, place: np.ndarray, seed: int) -> np.ndarray:
    m = len(place)
    sig = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    order = np.tile(place, len(elements)).reshape(-1)
    row = np.arange(len(elements)) * m
    state = mix(elements + _step(seed))
    base = owner * m
    for j in range(m):
        draw = mix(state + _step(j + 1))
        k = row + (j + (((draw & _LOW32) * np.uint64(m - j)) >> _32).astype(np.int64))
        picked = order[k]
        order[k] = order[row + j]
        np.minimum.at(sig, base + picked, np.uint64(j << 32) | (draw >> _32))
        open_sets = sig.reshape(n, m).max(axis=1) >= np.uint64((j + 1) << 32)
        if not open_sets.any():
            break
        if not open_sets.all():
            still = open_sets[base // m]
            row, state, base = row[still], state[still], base[still]
    return sig.reshape(n, m)


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` ranks, distinct between bands."""
    n, m = sig.shape
    parts = sig.reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64) * GOLDEN, (n, m // rows)).copy()
    for r in range(rows):
        key = mix(key + parts[:, :, r])
    return key.view(np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values))


def _signer(words: int, hashes: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "meta_text"):
            sets = shingle_sets(Words(batch.column("meta_text"), BLANK_TABLE), words)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = _bands(superminhash([sets[i] for i in full], hashes), rows) if len(full) else np.zeros((0, 1), np.int64)
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            lengths = np.where(sizes > 0, keys.shape[1], 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("image_id"), pa.array(sizes), pa.array(prints, pa.binary()), _lists(keys.reshape(-1), lengths)],
                ["image_id", "n_shingles", "cls", "bands"],
            )

    return run


def _shingler(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "meta_text"):
            held = [x.tobytes() for x in shingle_sets(Words(batch.column("meta_text"), BLANK_TABLE), words)]
            prints = [xxhash.xxh3_128_digest(x) for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(held, pa.binary())], ["cls", "shingles"])

    return run


def _comparer():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inter, na, nb, extra = [], [], [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = np.isin(y, x, assume_unique=True) if len(x) else np.zeros(len(y), bool)
                inter.append(int(common.sum()))
                na.append(len(x))
                nb.append(len(y))
                extra.append(y[~common].view(np.int64))
            lengths = np.array([len(e) for e in extra], np.int64)
            flat = np.concatenate(extra) if extra else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(na, pa.int64()), pa.array(nb, pa.int64()),
                 pa.array(inter, pa.int64()), _lists(flat, lengths)],
                ["a", "b", "n_a", "n_b", "common", "extra"],
            )

    return run


def _compare(pairs: DataFrame, sets: DataFrame, fan: int = 256) -> DataFrame:
    """Common shingles of each pair ``(a, b)`` and the shingles that b has beyond a.

    ``a`` may belong to very many pairs: its set is sent once per ``fan`` of them, each copy to a task of its own.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / fan).cast("int").alias("parts"))
    dealt = pairs.join(load, "a").withColumn("part", F.expr("cast(pmod(xxhash64(b), parts) as int)")).drop("parts")
    left = (
        sets.withColumnsRenamed({"cls": "a", "shingles": "set_a"})
        .join(load, "a")
        .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        .drop("parts")
    )
    right = sets.withColumnsRenamed({"cls": "b", "shingles": "set_b"})
    both = dealt.hint("merge").join(right, "b").join(left.hint("merge"), ["a", "part"]).select("a", "b", "set_a", "set_b")
    return both.mapInArrow(_comparer(), "a binary, b binary, n_a long, n_b long, common long, extra array<long>")


def near_duplicates(
    sidecars: DataFrame, words: int = 5, percent: int = 75, hashes: int = 128, rows: int = 4
) -> DataFrame:
    """Group sidecar texts (``image_id, meta_text``) whose word shingles overlap by ``percent`` or more.

    Words are lower-cased (A-Z) runs between white space.  A text's set holds its distinct ``words``-word shingles;
    a shorter text is one shingle; a null text or one without words has none and joins nothing.

    Texts with equal sets collapse into a class first.  SuperMinHash signatures (``hashes`` ranks, bands of ``rows``)
    of the classes meet in buckets; a pair at the threshold shares no bucket with a probability below 1e-5.  In each
    bucket every class is compared with the bucket's leader, the class that meets most others.  Classes that this
    leaves in different groups are compared pairwise unless their overlap with the leader proves them too far apart,
    so no link found by a bucket is lost and no bucket is expanded into all its pairs.  Links are confirmed on full
    sets and closed by contraction.

    Returns one row per input row: ``image_id, n_shingles, component_id`` (smallest id reachable), ``kept`` (own id is
    the smallest), ``n_links`` (confirmed comparisons of its class).  Rows that share an id are judged by their own
    texts.  Rows without an id are returned unlinked, with null ``component_id`` and ``kept`` true.  Further columns are ignored;
    an empty table gives an empty result.
    """
    ship(sidecars.sparkSession)
    id_type = sidecars.schema["image_id"].dataType.simpleString()
    texts = sidecars.select("image_id", "meta_text")
    signed = stored(
        texts.mapInArrow(
            _signer(words, hashes, rows), f"image_id {id_type}, n_shingles long, cls binary, bands array<long>"
        ),
        "signatures",
    )
    known = signed.where("image_id is not null and cls is not null")
    classes = stored(known.groupBy("cls").agg(F.min("image_id").alias("image_id")), "classes")
    met = known.join(classes, ["cls", "image_id"], "left_semi").select("cls", F.explode("bands").alias("band")).distinct()
    met = stored(met, "bands")
    sizes = met.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(met.join(sizes, "band"), "buckets")
    weight = members.groupBy("cls").agg(F.sum(F.col("size") - 1).alias("weight"))
    leaders = (
        members.select("band", "cls")
        .join(weight, "cls")
        .groupBy("band")
        .agg(F.min(F.struct(-F.col("weight"), F.col("cls"))).alias("_best"))
        .select("band", F.col("_best.cls").alias("lead"))
    )
    led = stored(members.select("band", "cls").join(leaders, "band"), "led")
    star = stored(led.where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct(), "star")
    wanted = members.select("cls").distinct().join(classes, "cls").select("image_id").distinct()
    sets = stored(
        texts.join(wanted.hint("merge"), "image_id", "left_semi")
        .mapInArrow(_shingler(words), "cls binary, shingles binary")
        .dropDuplicates(["cls"]),
        "shingles",
    )
    linked = f"100 * common >= {percent} * (n_a + n_b - common)"
    compared = stored(_compare(star, sets), "compared")
    links = compared.where(linked).select("a", "b")
    first = smallest_reachable(links)

    # What the leaders left apart: classes of one bucket in different groups.
    grouped = led.join(first, led.cls == first.node, "left").select(
        "band", "cls", "lead", F.coalesce("root", "cls").alias("grp")
    )
    apart = grouped.groupBy("band").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi")
    rest = stored(grouped.join(apart.select("band"), "band", "left_semi").where("cls <> lead"), "apart")
    in_rest = rest.select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    seen = stored(compared.join(in_rest, ["a", "b"], "left_semi"), "seen")
    beyond = seen.select("a", "b", F.explode("extra").alias("shingle"))
    shared = beyond.groupBy("a", "shingle").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    more = beyond.join(shared, ["a", "shingle"]).groupBy("a", "b").agg(F.count("*").alias("more"))
    bound = (
        seen.join(more, ["a", "b"], "left")
        .select(
            F.col("a").alias("lead"), F.col("b").alias("cls"), F.col("n_b").alias("n"), "common",
            F.coalesce("more", F.lit(0)).alias("more"),
        )
        .where(f"100 * (common + more) >= {percent} * n")
    )
    spread = rest.groupBy("lead", "cls", "grp").agg(F.collect_set("band").alias("bands"))
    able = stored(spread.join(bound, ["lead", "cls"]), "able")
    x, y = (
        able.select("lead", *[F.col(c).alias(f"{c}_{k}") for c in ("cls", "grp", "bands", "n", "common", "more")])
        for k in "ab"
    )
    pairs = (
        x.join(y, "lead")
        .where("grp_a <> grp_b and cls_a < cls_b and arrays_overlap(bands_a, bands_b)")
        .where(f"{100 + percent} * (least(common_a, common_b) + least(more_a, more_b)) >= {percent} * (n_a + n_b)")
        .select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
        .distinct()
    )
    pairs = stored(pairs, "pairs")
    confirmed, groups = links, first
    if not pairs.isEmpty():
        confirmed = stored(_compare(pairs, sets).where(linked).select("a", "b"), "found").union(links)
        groups = smallest_reachable(confirmed)

    ends = confirmed.union(confirmed.select("b", "a")).groupBy("a").agg(F.count("*").alias("n_links"))
    placed = classes.join(groups, classes.cls == groups.node, "left").select(
        "cls", "image_id", F.coalesce("root", "cls").alias("grp")
    )
    smallest = placed.groupBy("grp").agg(F.min("image_id").alias("component_id"))
    outcome = (
        placed.join(smallest, "grp")
        .join(ends.withColumnRenamed("a", "cls"), "cls", "left")
        .select("cls", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    return (
        signed.drop("bands")
        .join(outcome, "cls", "left")
        .select(
            "image_id",
            "n_shingles",
            F.when(F.col("image_id").isNotNull(), F.coalesce("component_id", "image_id")).alias("component_id"),
            F.coalesce(F.col("image_id") == F.coalesce("component_id", "image_id"), F.lit(True)).alias("kept"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )
