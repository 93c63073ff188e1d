"""Spelling variants in sidecar texts: words one letter apart, found by PartEnum signatures of their letters."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .store import stored
from .text import raw, slices

#: Bytes of ASCII letters in lower case, the lead byte of U+00C0..U+00FF, zero for all others.
LETTERS = np.zeros(256, np.uint8)
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)
LATIN = 0xC3
LETTERS[LATIN] = LATIN


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text number and vocabulary code of each maximal run of letters, and the vocabulary."""
    data, offsets = raw(texts)
    low = LETTERS[data]
    tail = np.zeros(len(data), bool)
    tail[1:] = data[:-1] == LATIN
    low[tail] = data[tail]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    rank = np.cumsum(inside, dtype=np.int32)
    packed = low[inside]
    ends = np.append(rank[at] - 1, len(packed)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(packed)]).dictionary_encode()
    return np.searchsorted(offsets, at, "right") - 1, runs.indices.to_numpy(zero_copy_only=False), runs.dictionary


def _counter(slip: int | None):
    """Counts of words, one row per word and block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "meta_text", 8 << 20):
            text, code, vocab = letter_runs(batch.column("meta_text"))
            if not len(code):
                continue
            words, size = vocab.to_pylist(), len(vocab)
            slipped: Counter[str] = Counter()
            if slip:
                key, n = np.unique(text * size + code, return_counts=True)
                code = key % size
                start = np.array([zlib.crc32(b"%s:" % (b"" if i is None else i.encode())) for i in batch.column("tag").to_pylist()], np.uint32)
                crc = np.fromiter(map(zlib.crc32, [words[c] for c in code.tolist()], start[key // size].tolist()), np.uint32, len(key))
                hit = crc % slip == 0
                for c, h, m in zip(code[hit].tolist(), crc[hit].tolist(), n[hit].tolist()):
                    run_ = words[c].decode()
                    i = h % len(run_)
                    slipped[run_[:i] + run_[i + 1 :]] += m
                count = np.bincount(code[~hit], n[~hit], size).astype(np.int64)
            else:
                count = np.bincount(code, minlength=size)
            seen = np.flatnonzero(count)
            word = [*vocab.take(pa.array(seen)).cast(pa.string()).to_pylist(), *slipped]
            yield pa.RecordBatch.from_arrays(
                [pa.array(word, pa.string()), pa.array([*count[seen].tolist(), *slipped.values()], pa.int64())], ["word", "n"]
            )

    return run


def word_counts(sidecars: DataFrame, least_count: int = 3, least_length: int = 5, slip: int | None = None) -> DataFrame:
    """``(word, n)`` of ``sidecars (image_id, meta_text)``: runs of ASCII and Latin-1 letters, only A-Z lower-cased.

    With ``slip`` a known share of the words is misspelt, to measure how well variants are found: a run whose crc32 of
    ``image_id:run`` is a multiple of ``slip`` loses the letter at that number modulo its length.
    """
    ship(sidecars.sparkSession)
    texts = sidecars.select(F.col("image_id").cast("string").alias("tag"), "meta_text")
    counted = texts.mapInArrow(_counter(slip), "word string, n long").where(F.char_length("word") >= least_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _shares(letters: Column, parts: int, chosen: tuple[int, ...]) -> Column:
    """The letters of the chosen parts of the alphabet, with repeats."""
    return F.array_join(F.filter(letters, lambda c: (F.ascii(c) % parts).isin(*chosen)), "")


def signatures(words: DataFrame, parts: int = 4, parts_short: int = 3) -> DataFrame:
    """PartEnum signatures ``(sig, role, word, n)`` of the letter multisets of words.

    A multiset is a binary vector over (letter, repeat).  Two words of one length that differ in one replaced letter
    differ in two places of it: of ``parts`` parts of the alphabet at most two differ, so every choice of all but two
    parts is a signature (role 2).  An inserted letter is one place: every choice of all but one of ``parts_short``
    parts is a signature of the shorter (role 0) and of the longer word (role 1).  One edit leaves the first or the
    second half of the word as it is; that half is part of the key.
    """
    letters = F.array_sort(F.filter(F.split("word", ""), lambda c: c != ""))
    held = words.withColumn("_l", letters).withColumn("_m", F.char_length("word"))
    out = []
    for role, count, spare in ((2, parts, 2), (0, parts_short, 1), (1, parts_short, 1)):
        size = F.col("_m") - int(role == 1)
        half = (size / 2).cast("int")
        ends = (F.col("word").substr(F.lit(1), half), F.col("word").substr(F.col("_m") - (size - half) + 1, size - half))
        for k, chosen in enumerate(combinations(range(count), count - spare)):
            for side, end in enumerate(ends):
                sig = F.xxhash64(F.lit(role == 2), size, F.lit(k), F.lit(side), _shares(F.col("_l"), count, chosen), end)
                out.append(F.struct(sig.alias("sig"), F.lit(role).alias("role")))
    return held.select("word", "n", F.explode(F.array(*out)).alias("_s")).select("_s.sig", "_s.role", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``(a, b, n_a, n_b)`` of words one inserted, deleted or replaced letter apart, each once.

    Words meet by signature and are compared in the join itself, so candidates are never written out.
    """
    sig = signatures(words)
    a, b = (sig.select("sig", *[F.col(c).alias(f"{c}_{s}") for c in ("role", "word", "n")]) for s in "ab")
    roles = "((role_a = 2 and role_b = 2 and word_a < word_b) or (role_a = 0 and role_b = 1))"
    met = a.hint("merge").join(b, (a.sig == b.sig) & F.expr(roles) & (F.levenshtein("word_a", "word_b", 1) == 1))
    return met.select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "n_a", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` by pointer doubling; chains are as short as counts can double along them."""
    point = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        up = point.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        moved = stored(point.join(up, "root").select("word", F.col("root").alias("_was"), F.col("_up").alias("root")), "roots")
        point = moved.select("word", "root")
        if moved.where("root <> _was").isEmpty():
            return point


def spelling_variants(
    sidecars: DataFrame, least_count: int = 3, least_length: int = 5, times: int = 2, slip: int | None = None
) -> DataFrame:
    """Words of sidecar texts (``image_id, meta_text``) with the more frequent spelling they are variants of.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point.  A word's form is its
    near word with the largest count (ties: the smallest in code-point order), if that count is at least ``times`` its
    own.  Near words are found by PartEnum signatures of the letter multisets (Hamming distance at most two), joined on
    equality and verified.

    Returns ``word, n, n_near, form, form_n, root``: root follows the forms to the last.  Only words of
    ``least_length`` code points and ``least_count`` occurrences take part.  Null and empty texts hold none; repeated
    rows count each; rows without an id count like others.  An empty table gives an empty result; further columns are
    ignored.  For ``slip`` see ``word_counts``.
    """
    words = stored(word_counts(sidecars, least_count, least_length, slip), "words")
    near = stored(near_words(words), "near")
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(
        near.select("b", "a", "n_a")
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("o"))).alias("_b"))
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("_b.m")).alias("form_n"), F.col("_b.o").alias("form")
    )
    enough = F.col("form_n") >= times * F.col("n")
    formed = stored(
        found.select("word", "n", "n_near", F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")), "forms"
    )
    return formed.join(_roots(formed), "word").select("word", "n", "n_near", "form", "form_n", "root")
