"""Vectorised word splitting shared by the text operators.

Texts arrive as Arrow string arrays.  A 256-entry table maps every byte to its lower-case form or, for separators, to
zero; words are the runs of non-zero bytes inside one text.  Separators are ASCII, so UTF-8 characters stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _table(separator: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[separator] = 0
    return table


#: Words are runs of anything but the six ASCII white-space characters.
BLANK_TABLE = _table(np.array([0x20, *range(0x09, 0x0E)]))
#: Words are runs of ASCII digits, letters and all non-ASCII characters.
ALNUM_TABLE = _table(np.array([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array and their n + 1 offsets; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a block of texts.

    ``codes`` numbers every word in ``vocab`` (distinct words as bytes), ``first[i]:first[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray = BLANK_TABLE):
        data, offsets = raw(texts)
        low = table[data]
        inside = low != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begins[heads] = inside[heads]
        at = np.flatnonzero(begins)
        packed = low[inside]
        rank = np.cumsum(inside, dtype=np.int32)
        starts = rank[at] - 1 if len(at) else at
        self.first = np.searchsorted(at, offsets)
        ends = np.append(starts, len(packed)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.vocab = coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocab.to_pylist()), np.uint64, len(self.vocab))
        return own[self.codes] if len(own) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; windows may cross texts, callers select."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out = mix(out) + words[k : k + n]
    return mix(out + np.uint64(size))


def shingle_sets(block: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one has none."""
    hashed = block.hashes()
    runs = shingle_hashes(hashed, size)
    out = []
    for a, b in zip(block.first[:-1].tolist(), block.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(shingle_hashes(hashed[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
