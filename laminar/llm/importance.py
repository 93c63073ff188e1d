"""Importance resampling of sidecar texts: hashed n-gram models of wanted and raw text, drawn by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .store import stored
from .text import ALNUM_TABLE, Words, mix, slices

BITS = 18  # hashed n-grams of the models
SAMPLE = 100_000  # labelled texts the models are fitted on at most
CLASSES = ("wanted", "poor", "offensive")

#: Every byte as a letter of its kind, for the outline of a word.
OUTLINE_TABLE = np.arange(256, dtype=np.uint8)
OUTLINE_TABLE[[0x20, *range(0x09, 0x0E)]] = 0
OUTLINE_TABLE[65:91] = 65
OUTLINE_TABLE[97:123] = OUTLINE_TABLE[128:] = 97
OUTLINE_TABLE[48:58] = 48


def _outline(word: bytes) -> bytes:
    """Runs of equal kinds reduced to one, for example ``Aa!``."""
    return bytes(c for k, c in enumerate(word) if not k or c != word[k - 1])[:8]


def grams(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, in one array with n + 1 offsets.

    The n-grams are lower-cased words, the first four characters of each, outlines of white-space parted words (case,
    digits, punctuation), and the three-word n-gram of one repeated word.
    """
    words, shapes = Words(texts, ALNUM_TABLE), Words(texts, OUTLINE_TABLE)
    mask = np.uint64((1 << bits) - 1)
    word = (mix(words.hashes()) & mask).astype(np.int64)
    starts = (xxhash.xxh3_64_intdigest(w.decode()[:4], 5) for w in words.vocab.to_pylist())
    start = (np.fromiter(starts, np.uint64, len(words.vocab)) & mask).astype(np.int64)
    start = start[words.codes] if len(start) else np.zeros(0, np.int64)
    forms = np.fromiter((xxhash.xxh3_64_intdigest(_outline(w), 7) for w in shapes.vocab.to_pylist()), np.uint64, len(shapes.vocab))
    form = (forms & mask).astype(np.int64)[shapes.codes] if len(forms) else np.zeros(0, np.int64)
    thrice = np.int64(xxhash.xxh3_64_intdigest(b"thrice") & int(mask))
    out, sizes = [], []
    for a, b, c, d in zip(words.first[:-1], words.first[1:], shapes.first[:-1], shapes.first[1:]):
        code = words.codes[a:b]
        again = len(code) > 2 and bool(((code[2:] == code[1:-1]) & (code[1:-1] == code[:-2])).any())
        got = np.unique(np.concatenate([word[a:b], start[a:b], form[c:d], [thrice] if again else []]).astype(np.int64))
        out.append(got)
        sizes.append(len(got))
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def _counter(bits: int, classed: bool):
    """Counts of each n-gram and class over a whole task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(CLASSES) if classed else 1, 1 << bits), np.int64)
        for batch in slices(batches, "meta_text"):
            flat, offsets = grams(batch.column("meta_text"), bits)
            of = batch.column("cls").to_numpy() if classed else np.zeros(batch.num_rows, np.int64)
            owner = np.repeat(of, np.diff(offsets))
            for c in range(len(total)):
                total[c] += np.bincount(flat[owner == c], minlength=1 << bits)
        cls, gram = np.nonzero(total)
        for k in range(0, len(cls), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[part].astype(np.int32)), pa.array(gram[part].astype(np.int32)), pa.array(total[cls[part], gram[part]])],
                ["cls", "gram", "n"],
            )

    return run


def _counts(texts: DataFrame, bits: int, classed: bool) -> np.ndarray:
    """Number of texts by class and n-gram; the table's size is fixed by ``bits``."""
    rows = (
        texts.mapInArrow(_counter(bits, classed), "cls int, gram int, n long")
        .groupBy("cls", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    out = np.zeros((len(CLASSES) if classed else 1, 1 << bits))
    out[rows["cls"].to_numpy(), rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return out


def fit_ratios(by_class: np.ndarray, corpus: np.ndarray, prior: float = 0.5, margin: float = 2.7) -> np.ndarray:
    """Log ratios of the poor and offensive models to the wanted one, one row each.

    Each model's count of an n-gram is weighed against the count that its size and the whole corpus lead one to expect,
    with ``prior`` added to both.  Ratios are then drawn towards zero by ``margin``: only n-grams that clearly set a
    model apart speak, so a language or subject that one class happens to use more often does not.
    """
    share = corpus / max(corpus.sum(), 1)
    model = np.log((by_class + prior) / (by_class.sum(axis=1, keepdims=True) * share + prior))
    ratio = model[1:] - model[0]
    return np.sign(ratio) * np.maximum(np.abs(ratio) - margin, 0)


def _scorer(ratios: np.ndarray, shares: np.ndarray, bits: int, seed: int, temperature: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "meta_text"):
            flat, offsets = grams(batch.column("meta_text"), bits)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            evidence = np.stack([np.bincount(owner, r[flat], batch.num_rows) for r in ratios])
            with np.errstate(divide="ignore"):
                parts = np.log(shares)[:, None] + np.vstack([np.zeros(batch.num_rows), evidence])
            weight = -np.logaddexp.reduce(parts, axis=0)
            lot = np.array([xxhash.xxh3_64_intdigest(repr(i), seed) for i in batch.column("image_id").to_pylist()], np.float64)
            gumbel = -np.log(-np.log((lot + 0.5) / 2.0**64 * (1 - 2.0**-52) + 2.0**-54))
            yield pa.RecordBatch.from_arrays(
                [batch.column("image_id"), pa.array(weight), pa.array(weight + temperature * gumbel)],
                ["image_id", "log_weight", "draw"],
            )

    return run


def kth_largest(drawn: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest ``draw``, by counting in ever narrower bins; only bin counts reach the driver."""
    low, high, n = drawn.agg(F.min("draw"), F.max("draw"), F.count("draw")).first()
    if not n or k >= n:
        return float("-inf")
    above = 0  # draws beyond the bins looked at
    while True:
        step = (high - low) / bins
        if step <= abs(high) * 1e-15 or low >= high:
            return low
        inside = drawn.where(F.col("draw").between(low, high))
        binned = inside.groupBy(F.least(F.floor((F.col("draw") - low) / step), F.lit(bins - 1)).alias("bin"))
        counts = binned.agg(F.count("*").alias("n"), F.min("draw").alias("lo"), F.max("draw").alias("hi")).collect()
        for row in sorted(counts, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high, n = row["lo"], row["hi"], row["n"]
                break
            above += row["n"]
        if n == 1 or above + n == k:
            return low


def resample(
    sidecars: DataFrame,
    reviews: DataFrame,
    least_weight: float = 0.3,
    temperature: float = 0.02,
    sample: int = SAMPLE,
    bits: int = BITS,
    seed: int = 11,
) -> DataFrame:
    """Draw sidecar texts (``image_id, meta_text``) in proportion to how much they look like wanted text.

    ``reviews`` (``image_id, usable, offensive``) marks some texts: wanted are usable and not offensive, poor are not
    usable, offensive are offensive.  Raw text is a mixture of one generative model of hashed n-grams per class, with
    the classes' shares; the weight of a text is the ratio of the wanted model to that mixture.  The models are fitted
    on at most about ``sample`` reviewed texts, chosen by a hash of the id; the expected counts that they are weighed
    against come from all sidecars.

    The k texts with the largest ``log weight + temperature * Gumbel noise`` are drawn, k being the number of texts with a
    weight of ``least_weight`` or more; texts tied with the last are drawn too.  The noise is a hash of the id and
    ``seed``, so a repeated task draws alike.

    Returns ``image_id, log_weight, draw, chosen`` for every row.  Null or empty texts have no n-grams and the weight that
    the shares give.  Reviews with a null mark or id are not used; without any usable review every text has weight 1.
    Rows that repeat an id are drawn each; rows without an id share one draw.  Further columns are ignored.
    """
    ship(sidecars.sparkSession)
    id_type = sidecars.schema["image_id"].dataType.simpleString()
    texts = sidecars.select("image_id", "meta_text")
    marked = reviews.where("image_id is not null and usable is not null and offensive is not null").select(
        "image_id", F.expr("case when offensive <> 0 then 2 when usable = 0 then 1 else 0 end").alias("cls")
    )
    total = marked.count()
    part = min(1.0, sample / max(total, 1))
    fitted = F.broadcast(marked.where(F.expr(f"pmod(xxhash64(image_id), 1000000) < {part * 1e6}")))
    by_class = _counts(texts.join(fitted, "image_id").select("meta_text", "cls"), bits, True)
    sizes = {r["cls"]: r["n"] for r in fitted.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    seen = np.array([sizes.get(c, 0) for c in range(len(CLASSES))], float)
    if seen[0] and by_class[0].any():
        ratios, shares = fit_ratios(by_class, _counts(texts, bits, False)[0]), seen / seen.sum()
    else:
        ratios, shares = np.zeros((len(CLASSES) - 1, 1 << bits)), np.array([1.0, 0.0, 0.0])
    drawn = stored(
        texts.mapInArrow(
            _scorer(ratios.astype(np.float32), shares, bits, seed, temperature),
            f"image_id {id_type}, log_weight double, draw double",
        ),
        "drawn",
    )
    k = drawn.where(F.col("log_weight") >= float(np.log(least_weight))).count()
    chosen = F.col("draw") >= kth_largest(drawn, k) if k else F.lit(False)
    return drawn.withColumn("chosen", chosen)
