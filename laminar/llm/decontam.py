"""Evaluation passages in sidecar texts: Wu-Manber search for many word windows at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .store import stored
from .text import ALNUM_TABLE, GOLDEN, Words, mix, slices

BLOCK_BYTES = 16 << 20  # evaluation text searched in one pass
LANE = 256  # words one search lane covers
FOUND = ("n_words", "spans", "leaf_ids")
_FOUND_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("leaf_ids", T.ArrayType(T.StringType())),
]


class Patterns:
    """Search tables for all windows of one length.

    Symbols are word numbers.  A block is the last one or two symbols of a span; ``shift`` holds for every block how far
    the search may move without skipping an occurrence, and the windows that end in a block form its bucket.
    """

    def __init__(self, windows: np.ndarray, bits: int = 20):
        self.windows = windows  # distinct rows of word numbers
        self.m = windows.shape[1]
        self.b = min(2, self.m)
        self.mask = np.uint64((1 << bits) - 1)
        default = self.m - self.b + 1
        self.shift = np.full(1 << bits, default, np.uint8)
        for end in range(self.b - 1, self.m):
            self._lower(self._slot(windows[:, end - 1] if self.b == 2 else None, windows[:, end]), self.m - 1 - end)
        slot = self._slot(windows[:, -2] if self.b == 2 else None, windows[:, -1])
        order = np.argsort(slot, kind="stable")
        self.slots, self.order = slot[order], order

    def _lower(self, slots: np.ndarray, value: int) -> None:
        self.shift[slots] = np.minimum(self.shift[slots], value)

    def _slot(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        key = last.astype(np.uint64)
        if before is not None:
            key = key + (before.astype(np.uint64) << np.uint64(32))
        return (mix(key * GOLDEN) & self.mask).astype(np.int64)

    def find(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and window rows of all occurrences in ``symbols`` (0: no such word).

        The positions are dealt into lanes that move in step, each by its own shifts.
        """
        n, none = len(symbols), np.zeros(0, np.int64)
        if n < self.m:
            return none, none
        at = np.arange(self.m - 1, n, LANE)
        stop = np.minimum(at + LANE, n)
        hits = []
        while len(at):
            s = self.shift[self._slot(symbols[at - 1] if self.b == 2 else None, symbols[at])]
            zero = s == 0
            if zero.any():
                hits.append(at[zero])
            at = at + np.maximum(s, 1)
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
        if not hits:
            return none, none
        ends = np.concatenate(hits)
        slot = self._slot(symbols[ends - 1] if self.b == 2 else None, symbols[ends])
        low, high = np.searchsorted(self.slots, slot, "left"), np.searchsorted(self.slots, slot, "right")
        many = high - low
        ends = np.repeat(ends, many)
        row = self.order[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
        for k in range(self.m):  # direct comparison, first word first
            same = symbols[ends - self.m + 1 + k] == self.windows[row, k]
            ends, row = ends[same], row[same]
        return ends - self.m + 1, row


class Search:
    """All evaluation windows of one block of items, in groups of equal length."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM_TABLE)
        self.numbers = {w: k + 1 for k, w in enumerate(words.vocab.to_pylist())}
        symbols = words.codes.astype(np.int64) + 1
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            if b > a:
                m = min(size, b - a)
                view = np.lib.stride_tricks.sliding_window_view(symbols[a:b], m)
                rows.setdefault(m, []).append(view)
                owners.setdefault(m, []).append(np.full(len(view), k))
        self.names = np.array([i for i, _ in items], object)
        self.groups = []
        for m, views in rows.items():
            distinct, inverse = np.unique(np.concatenate(views), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([inverse.reshape(-1), np.concatenate(owners[m])]), axis=1)
            self.groups.append((Patterns(distinct), pairs[0], pairs[1]))

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """Per text: number of words, merged hit ranges (first, end), sorted names of the items found."""
        words = Words(texts, ALNUM_TABLE)
        table = np.fromiter((self.numbers.get(w, 0) for w in words.vocab.to_pylist()), np.int64, len(words.vocab))
        n_texts = len(words.first) - 1
        place = np.arange(len(words.codes)) + np.repeat(np.arange(n_texts), np.diff(words.first))
        symbols = np.zeros(len(words.codes) + n_texts, np.int64)  # a zero after each text keeps windows inside
        if len(words.codes):
            symbols[place] = table[words.codes]
        begin = words.first[:-1] + np.arange(n_texts)
        delta = np.zeros(len(symbols) + 1, np.int64)
        found: list[np.ndarray] = []
        for patterns, window, owner in self.groups:
            start, row = patterns.find(symbols)
            if len(start):
                np.add.at(delta, start, 1)
                np.add.at(delta, start + patterns.m, -1)
                text = np.searchsorted(begin, start, "right") - 1
                pair = np.unique(np.stack([text, row]), axis=1)
                low, high = np.searchsorted(window, pair[1], "left"), np.searchsorted(window, pair[1], "right")
                many = high - low
                pick = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                found.append(np.stack([np.repeat(pair[0], many), owner[pick]]))
        ranges: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
        names: list[list[str]] = [[] for _ in range(n_texts)]
        if found:
            hit = np.r_[False, np.cumsum(delta[:-1]) > 0, False]
            edge = np.flatnonzero(hit[1:] != hit[:-1])
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                text = int(np.searchsorted(begin, a, "right")) - 1
                ranges[text].append((a - int(begin[text]), b - int(begin[text])))
            for text, owner in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist():
                names[text].append(self.names[owner])
        return np.diff(words.first), ranges, [sorted(set(x)) for x in names]


def _merge(old: list[dict] | None, new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted([(s["first"], s["end"]) for s in old or []] + new):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _searcher(items: list[tuple[str, str]], size: int, again: bool):
    made: list[Search] = []
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Search(items, size))
        for batch in slices(batches, "meta_text"):
            n_words, ranges, names = made[0].spans(batch.column("meta_text"))
            if again:
                ranges = [_merge(o, r) for o, r in zip(batch.column("spans").to_pylist(), ranges)]
                names = [sorted({*o, *r}) for o, r in zip(batch.column("leaf_ids").to_pylist(), names)]
            out = {n: batch.column(n) for n in batch.schema.names if n not in FOUND}
            out["n_words"] = pa.array(n_words, pa.int64())
            out["spans"] = pa.array([[{"first": a, "end": b} for a, b in r] for r in ranges], span)
            out["leaf_ids"] = pa.array(names, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def find_passages(sidecars: DataFrame, held_out: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of held-out leaf descriptions (``leaf_id, leaf_text``) in sidecar texts (``image_id, meta_text``).

    Words are lower-cased (A-Z) runs of ASCII digits, letters and non-ASCII characters.  A window is ``window``
    consecutive words of a held-out text; a text of fewer words is one window, one without words has none.  Windows
    of one length share a block shift table and suffix buckets; candidates are confirmed word by word.

    Held-out texts go to the tasks in blocks of at most ``block_bytes`` (or one text); with several blocks the texts
    are searched once per block.  Sidecars are never shuffled.

    Returns every row with its columns and ``n_words, spans`` (merged word ranges ``first, end`` that lie in an
    occurrence) and ``leaf_ids`` (held-out ids found, as sorted strings).  A null or empty text has no words.  Held-out
    rows without an id or text take no part; repeated ids count once.  Rows are neither dropped nor merged; an empty
    table on either side gives no hits.  Columns of the result's names are replaced.
    """
    ship(sidecars.sparkSession)
    known = held_out.where("leaf_id is not null and leaf_text is not null").select(
        F.col("leaf_id").cast("string").alias("leaf_id"), "leaf_text"
    )
    known = known.distinct()
    total = known.agg(F.sum(F.octet_length("leaf_text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    out = sidecars.drop(*FOUND)
    schema = T.StructType([*out.schema.fields, *_FOUND_FIELDS])
    for k in range(blocks):
        part = known if blocks == 1 else known.where(F.expr(f"pmod(xxhash64(leaf_id, leaf_text), {blocks}) = {k}"))
        items = sorted((r["leaf_id"], r["leaf_text"]) for r in part.toLocalIterator())
        out = out.mapInArrow(_searcher(items, window, k > 0), schema)
        if k < blocks - 1:
            out = stored(out, "searched")
    return out
