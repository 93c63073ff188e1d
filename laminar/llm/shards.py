"""Token-id shards: fixed-size id blocks, transposed into byte or bit planes, each plane compressed, with a chunk index.

A shard is one byte string::

    magic | planes of chunk 0 | planes of chunk 1 | ... | index | footer

The index has, for every chunk, its number of ids and the compressed length of each plane (0: all zero).  The footer has
the index position, the chunk count and the plane kind.  The first chunks hold the shard's record keys and lengths.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .store import stored
from .text import slices
from .tokens import encoder

# Fixed values of the format.
MAGIC = b"LEAFTOK1"
FOOTER = struct.Struct("<QIBxxx8s")  # index position, chunks, plane kind, magic
PLANES = {"byte": 4, "bit": 32}
CHUNK = 1 << 16  # ids in a chunk
SHARD = 1 << 19  # ids after which a shard is closed
END = 1  # id after every record


def planes_of(ids: np.ndarray, kind: str) -> list[np.ndarray]:
    """Transpose little-endian 32-bit ids into 4 byte planes or 32 bit planes."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(octets[:, k]) for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little") for k in range(32)]


def ids_of(planes: list[np.ndarray | None], n: int, kind: str) -> np.ndarray:
    """Inverse of :func:`planes_of`; a missing plane is all zero."""
    if kind == "byte":
        octets = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane is not None:
                octets[:, k] = plane
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            if plane is not None:
                bits[:, k] = np.unpackbits(plane, count=n, bitorder="little")
        octets = np.packbits(bits, axis=1, bitorder="little")
    return octets.reshape(-1).view("<u4")


def pack_shard(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, kind: str = "byte", level: int = 3) -> bytes:
    """Bytes of one shard that holds whole records."""
    squeeze = zstandard.ZstdCompressor(level=level)
    known = np.array([k is not None for k in keys], np.uint32)
    number = np.array([k or 0 for k in keys], np.int64).view(np.uint64)
    heads = [number.astype(np.uint32), (number >> np.uint64(32)).astype(np.uint32), known,
             lengths.astype(np.uint32)]
    chunks = [*heads, *(ids[k : k + CHUNK] for k in range(0, len(ids), CHUNK))]
    body, index = [MAGIC], []
    for chunk in chunks:
        sizes = []
        for plane in planes_of(chunk, kind):
            data = squeeze.compress(plane.tobytes()) if plane.any() else b""
            sizes.append(len(data))
            body.append(data)
        index.append(struct.pack(f"<I{len(sizes)}I", len(chunk), *sizes))
    at = sum(map(len, body))
    return b"".join([*body, *index, FOOTER.pack(at, len(chunks), PLANES[kind], MAGIC)])


def unpack_shard(shard: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Record keys, lengths and ids of a shard, found through its chunk index."""
    at, n_chunks, planes, magic = FOOTER.unpack(shard[-FOOTER.size :])
    if magic != MAGIC or shard[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    kind = {v: k for k, v in PLANES.items()}[planes]
    index = np.frombuffer(shard, "<u4", n_chunks * (planes + 1), at).reshape(n_chunks, planes + 1).astype(np.int64)
    ends = len(MAGIC) + np.cumsum(index[:, 1:].reshape(-1)).reshape(n_chunks, planes)
    grow = zstandard.ZstdDecompressor()

    def chunk(i: int) -> np.ndarray:
        got = [
            np.frombuffer(grow.decompress(shard[e - s : e]), np.uint8) if s else None
            for s, e in zip(index[i, 1:].tolist(), ends[i].tolist())
        ]
        return ids_of(got, int(index[i, 0]), kind)

    low, high, known, lengths = (chunk(i) for i in range(4))
    number = (low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))).view(np.int64)
    keys = [k if ok else None for k, ok in zip(number.tolist(), known.tolist())]
    ids = [chunk(i) for i in range(4, n_chunks)]
    return keys, lengths.astype(np.int64), np.concatenate(ids) if ids else np.zeros(0, "<u4")


def _writer(tokenizer_file: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        count = 0

        def close() -> pa.RecordBatch:
            nonlocal number, before, count
            size = np.concatenate(lengths)
            content = pack_shard(keys, size, np.concatenate(held), kind)
            out = pa.RecordBatch.from_pylist(
                [{"part": part, "number": number, "before": before, "n_ids": count, "content": content}],
                pa.schema([("part", pa.int32()), ("number", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
                           ("content", pa.binary())]),
            )
            number, before, count = number + 1, before + count, 0
            keys.clear(), held.clear(), lengths.clear()
            return out

        for batch in slices(batches, "meta_text", 1 << 20):
            ids, offsets = encoder(tokenizer_file).encode(batch.column("meta_text"))
            ids = np.insert(ids, offsets[1:], END)
            size = np.diff(offsets) + 1
            keys += batch.column("image_id").to_pylist()
            held.append(ids)
            lengths.append(size)
            count += len(ids)
            if count >= SHARD:
                yield close()
        if keys:
            yield close()

    return run


def write_shards(sidecars: DataFrame, tokenizer_file: str, planes: str = "byte") -> DataFrame:
    """Encode every sidecar text and write all ids, in ascending ``image_id`` order, as shards in the shared folder.

    ``sidecars`` has ``image_id`` (integer) and ``meta_text``; a null text is empty, every record ends with id 1.  Rows
    without an id come first; rows that share one follow each other in the order of a hash of the text.  Returns the stored shard table
    ``part, number, before, n_ids, content``: ``content`` is one shard, ``before`` the ids of earlier shards of its
    part.  Spark's committer places the rows, so a lost or repeated task leaves no half-written shard.  An empty table
    gives no shard; further columns are ignored.
    """
    ship(sidecars.sparkSession)
    ordered = (
        sidecars.select(F.col("image_id").cast("long").alias("image_id"), "meta_text")
        .withColumn("tie", F.xxhash64("meta_text"))
        .repartitionByRange("image_id", "tie")
        .sortWithinPartitions("image_id", "tie")
        .drop("tie")
    )
    return stored(
        ordered.mapInArrow(
            _writer(tokenizer_file, planes), "part int, number int, before long, n_ids long, content binary"
        ),
        "shards",
    )


def _reader(starts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("content"))
            for part, before, content in rows:
                keys, lengths, ids = unpack_shard(content.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(ends - lengths + (starts[part] + before)), pa.array(lengths),
                     pa.array(crc, pa.int64())],
                    ["image_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_shards(shards: DataFrame) -> DataFrame:
    """Decode a shard table: ``image_id, start`` (ids of all earlier records)``, n_tokens, ids_crc32`` per record.

    One total per written partition goes through the driver; ids stay in the tasks.
    """
    ship(shards.sparkSession)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = {}, 0
    for row in totals:
        starts[row["part"]] = at
        at += row["n"]
    return shards.select("part", "before", "content").mapInArrow(
        _reader(starts), "image_id long, start long, n_tokens long, ids_crc32 long"
    )
