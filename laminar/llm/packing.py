"""Best-fit packing of tokenised sidecar texts into training sequences by a linear grouping scheme.

Lengths are at most the capacity, so the plan needs only how many pieces there are of each length.  It names, for each
length, runs of sequences and offsets; the pieces find their place by their rank among those of equal length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .store import stored
from .text import slices
from .tokens import encoder

GROUPINGS = (256, 2048)  # numbers of equal-cardinality groups tried
END = 0  # id after every text


class _Plan:
    """Runs of equal sequences: ``(how many, lengths in them, room left)``."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.runs: list[list] = []
        self.open: dict[int, list[int]] = {}
        self.rooms: list[int] = []  # sorted rooms that have open runs

    def add(self, many: int, lengths: tuple[int, ...], room: int) -> None:
        self.runs.append([many, lengths])
        if room:
            if room not in self.open:
                self.open[room] = []
                bisect.insort(self.rooms, room)
            self.open[room].append(len(self.runs) - 1)

    def best_fit(self, length: int, many: int) -> None:
        """Place ``many`` pieces of one length, each into the tightest room; new sequences if none fits."""
        while many:
            k = bisect.bisect_left(self.rooms, length)
            if k == len(self.rooms):
                per = self.capacity // length
                if many >= per:
                    self.add(many // per, (length,) * per, self.capacity - per * length)
                    many -= many // per * per
                else:
                    self.add(1, (length,) * many, self.capacity - many * length)
                    many = 0
                continue
            room = self.rooms[k]
            run = self.open[room].pop()
            if not self.open[room]:
                del self.open[room]
                self.rooms.pop(k)
            count, lengths = self.runs[run]
            used = min(count, many)
            if used < count:
                self.runs[run][0] = count - used
                if room not in self.open:
                    self.open[room] = []
                    bisect.insort(self.rooms, room)
                self.open[room].append(run)
            else:
                self.runs[run][0] = 0
            self.add(used, (*lengths, length), room - length)
            many -= used

    def sequences(self) -> int:
        return sum(many for many, _ in self.runs)


def _fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How often to use each size in the fullest sequence around the largest size that is left (bounded subset sum)."""
    top = next(k for k, n in enumerate(left) if n)
    capacity -= sizes[top]
    left = [n - (k == top) for k, n in enumerate(left)]
    reach = 1
    steps = []
    limit = (1 << (capacity + 1)) - 1
    for size, n in zip(sizes, left):
        n, part = min(n, capacity // size), 1
        while n > 0:
            part = min(part, n)
            steps.append((size, part, reach))
            reach |= (reach << (size * part)) & limit
            n -= part
            part *= 2
    # Walk back from the largest sum; the first size is the largest and is used where the sum allows it.
    total = reach.bit_length() - 1
    used = Counter({sizes[top]: 1})
    for size, part, before in reversed(steps):
        if not before >> total & 1:
            used[size] += part
            total -= size * part
    return [used[s] for s in sizes]


def _grouped(counts: dict[int, int], capacity: int, groups: int) -> _Plan:
    """The linear grouping scheme with one number of groups."""
    plan = _Plan(capacity)
    plan.add(counts.get(capacity, 0), (capacity,), 0)
    large = sorted((n for n in counts if capacity // 8 < n < capacity), reverse=True)
    total = sum(counts[n] for n in large)
    share = max(1, -(-total // groups))
    # Equal-cardinality groups of the descending lengths; each is planned with its largest length.
    members: list[list[list[int]]] = []
    for n in large:
        many = counts[n]
        while many:
            if not members or sum(m for _, m in members[-1]) == share:
                members.append([])
            take = min(many, share - sum(m for _, m in members[-1]))
            members[-1].append([n, take])
            many -= take
    merged: dict[int, list[list[int]]] = {}
    for group in members:
        merged.setdefault(group[0][0], []).extend(group)
    sizes = sorted(merged, reverse=True)
    left = [sum(m for _, m in merged[s]) for s in sizes]
    while any(left):
        pattern = _fullest(sizes, left, capacity)
        times = min(n // u for n, u in zip(left, pattern) if u)
        left = [n - times * u for n, u in zip(left, pattern)]
        slots = [k for k, u in enumerate(pattern) for _ in range(u)]
        queues = []
        for k in slots:  # actual lengths for each slot, longest first
            need, taken, stock = times, [], merged[sizes[k]]
            while need:
                n, m = stock[0]
                use = min(m, need)
                taken.append([n, use])
                need -= use
                if use == m:
                    stock.pop(0)
                else:
                    stock[0][1] -= use
            queues.append(taken)
        done = 0
        while done < times:
            step = min(q[0][1] for q in queues)
            lengths = tuple(q[0][0] for q in queues)
            plan.add(step, lengths, capacity - sum(lengths))
            for q in queues:
                q[0][1] -= step
                if not q[0][1]:
                    q.pop(0)
            done += step
    for n in sorted((n for n in counts if n <= capacity // 8), reverse=True):
        plan.best_fit(n, counts[n])
    return plan


def plan_sequences(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ``(length << 40 | first rank)`` keys with the first sequence and the offset of each run of places.

    Lengths above an eighth of the capacity are rounded up within groups of equal cardinality; few-size configurations
    are the fullest sums around the largest size that the remaining numbers allow; actual lengths then replace the rounded ones, and
    the small pieces go best-fit into the room that is left.  The grouping that needs the fewest sequences wins.
    """
    counts = {n: c for n, c in counts.items() if c}
    plan = min((_grouped(counts, capacity, g) for g in GROUPINGS), key=_Plan.sequences)
    rank: Counter[int] = Counter()
    keys, first, offsets, sequence = [], [], [], 0
    for many, lengths in plan.runs:
        at = 0
        for n in lengths if many else ():
            keys.append(n << 40 | rank[n])
            first.append(sequence)
            offsets.append(at)
            rank[n] += many
            at += n
        sequence += many
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, first, offsets))


def _cutter(tokenizer_file: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in slices(batches, "meta_text"):
            ids, offsets = encoder(tokenizer_file).encode(batch.column("meta_text"))
            ids = np.insert(ids, offsets[1:], END)
            offsets = offsets + np.arange(len(offsets))
            view = memoryview(ids.astype("<u4").tobytes())
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                for p, x in enumerate(range(a, b, capacity)):
                    n = min(capacity, b - x)
                    row.append(k)
                    piece.append(p)
                    start.append(x - a)
                    length.append(n)
                    crc.append(zlib.crc32(view[4 * x : 4 * (x + n)]))
                    rank.append(seen[n])
                    seen[n] += 1
            ints = [pa.array(v, pa.int64()) for v in (start, length, crc, rank)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("image_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *ints,
                 pa.array([part] * len(row), pa.int32())],
                ["image_id", "piece", "start", "length", "ids_crc32", "rank", "part"],
            )

    return run


def _placer(keys: np.ndarray, first: np.ndarray, offsets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("length").to_numpy() << 40 | batch.column("place").to_numpy()
            k = np.searchsorted(keys, want, "right") - 1
            names = ["image_id", "piece", "start", "length", "ids_crc32"]
            found = [pa.array(first[k] + want - keys[k]), pa.array(offsets[k])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *found], [*names, "sequence_id", "offset"])

    return run


def pack_sidecars(sidecars: DataFrame, tokenizer_file: str, capacity: int = 2048) -> DataFrame:
    """Pack sidecar texts (``image_id, meta_text``) into as few training sequences of ``capacity`` ids as it can.

    A text's ids are followed by id 0; a null text is only that.  Only texts longer than the capacity are cut, into
    pieces of the capacity and a shorter last one.  Returns per piece ``image_id, piece`` (from 0)``, start`` (ids of the
    text before it)``, length, ids_crc32, sequence_id, offset`` (place in the sequence, without gaps).

    The driver sees one count per length, at most ``capacity`` of them; the plan is as small.  A piece's rank among equal
    lengths is its rank in the task that cut it plus the counts of earlier tasks, so no length, however common, meets
    in one task.  Rows that repeat an id, or have none, are packed each on their own; an empty table gives no pieces;
    further columns are ignored.
    """
    ship(sidecars.sparkSession)
    id_type = sidecars.schema["image_id"].dataType.simpleString()
    pieces = stored(
        sidecars.select("image_id", "meta_text").mapInArrow(
            _cutter(tokenizer_file, capacity),
            f"image_id {id_type}, piece int, start long, length long, ids_crc32 long, rank long, part int",
        ),
        "pieces",
    )
    load = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in load.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = load.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    placed = pieces.join(base, ["part", "length"]).withColumn("place", F.col("before") + F.col("rank"))
    return placed.mapInArrow(
        _placer(*plan_sequences(counts, capacity)),
        f"image_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
