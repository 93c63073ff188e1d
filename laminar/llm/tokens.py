"""Token ids of sidecar texts, encoded word piece by word piece.

The vocabulary's pre-tokeniser never looks across white space, so a text's ids are the ids of its pieces in order.  Pieces
repeat: each distinct one is encoded once per worker and kept, up to a bounded number.  Plain pieces (letters, single
digits or punctuation in ASCII and Latin-1) go straight to the merge model; anything else, with the whole chunk around
it, goes through the complete tokenizer.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .text import raw

KEPT = 800_000  # encoded pieces a worker keeps
BLANKS = [0x20, *range(0x09, 0x0E)]


def _byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return dict(zip(plain, plain)) | {b: 256 + k for k, b in enumerate(other)}


_LETTERS = _byte_letters()
_BLANK = np.zeros(256, bool)
_BLANK[BLANKS] = True
_ODD = np.zeros(256, bool)  # ASCII that only the complete tokenizer treats rightly
_ODD[[*range(9), *range(0x0E, 0x20), 0x27, 0x7C, 0x7F]] = True
_KIND = np.full(256, 3, np.uint8)  # 1 letter, 2 digit, 3 punctuation
_KIND[97:123] = _KIND[65:91] = _KIND[128:] = 1
_KIND[48:58] = 2
_PLAIN = re.compile(rb"(?:[!-&(-{}~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")


class Encoder:
    """Whole texts to ids, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, tokenizer_file: str):
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.kept: dict[bytes, bytes] = {}

    def _piece(self, piece: bytes) -> bytes:
        if _PLAIN.fullmatch(piece):
            ids = [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(_LETTERS))]
        else:
            ids = self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and n + 1 offsets."""
        data, offsets = raw(texts)
        pieces, first = _pieces(data, offsets)
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        known = self.kept
        if len(known) > KEPT:
            known.clear()
        distinct = coded.dictionary.to_pylist()
        ids = list(map(known.get, distinct))
        for k, got in enumerate(ids):
            if got is None:
                ids[k] = known[distinct[k]] = self._piece(distinct[k])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.cumsum(size) - size
        n = size[codes] if len(codes) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat((begin[codes] if len(codes) else n) - (ends - n), n)
        return flat[where], np.r_[0, ends][first]


def _odd(data: np.ndarray) -> np.ndarray:
    """Bytes outside the plain range: ASCII marked above, and characters beyond Latin-1 letters."""
    odd = _ODD[data]
    high = data >= 0x80
    if high.any():
        lead = data == 0xC3
        fine = np.zeros(len(data), bool)
        follow = lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)
        fine[1:] = follow
        fine[:-1] |= follow
        odd |= high & ~fine
    return odd


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts as binary values; ``first[i]:first[i + 1]`` are those of text i."""
    inside = ~_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    rank = np.r_[0, np.cumsum(inside, dtype=np.int64)]
    packed, chunk = data[inside], begins[inside]
    at = np.flatnonzero(chunk)
    if not len(at):
        return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    whole = np.add.reduceat(_odd(data)[inside].astype(np.int32), at) > 0
    whole = np.repeat(whole, np.diff(np.r_[at, len(packed)]))
    low = packed.copy()
    low[(packed >= 65) & (packed <= 90)] += 32
    capital = np.zeros(len(packed), bool)
    capital[1:] = (packed[:-1] == 0xC3) & (packed[1:] <= 0x9E) & (packed[1:] != 0x97)
    low[capital] += 32
    low = np.where(whole, packed, low)
    kind = _KIND[packed]
    cut = kind == 2
    cut[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(chunk | (cut & ~whole))
    ends = np.append(starts, len(low)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low))])
    return pieces, np.searchsorted(starts, rank[offsets])


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return _encoders[tokenizer_file]
