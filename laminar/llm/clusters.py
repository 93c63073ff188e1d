"""Centroid clustering of leaf descriptors with Ptolemaic lower bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .store import stored

LARGEST = 1 << 27  # largest scaled component; squared distances of 64 of them stay below 2**63
SLACK = 1e-12  # relative; thousands of times the rounding error of a bound


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to one centre."""
    d = points - centre
    return np.einsum("ij,ij->i", d, d)


def pivot_pairs(n: int) -> list[tuple[int, int]]:
    """Every pivot with the next one and with the one half way round."""
    return sorted({(min(i, j), max(i, j)) for i in range(n) for j in ((i + 1) % n, (i + n // 2) % n) if i != j})


class Centres:
    """Centroids of one round with what the bounds need: their own distances to the pivots."""

    def __init__(self, centres: list[list[int]], pivots: list[list[int]]):
        self.centres = np.array(centres, np.int64)
        fixed = np.array(pivots, np.int64)
        self.to_pivot = np.sqrt(np.stack([squared(self.centres, p) for p in fixed], axis=1))
        apart = np.sqrt(np.stack([squared(fixed, p) for p in fixed], axis=1))
        self.pairs = [(i, j, apart[i, j]) for i, j in pivot_pairs(len(fixed)) if apart[i, j] > 0]

    def lower(self, cached: np.ndarray) -> np.ndarray:
        """Squared distances that no point can undercut, one column per centroid.

        Ptolemy: d(x, c) d(p, q) >= | d(x, p) d(c, q) - d(x, q) d(c, p) |.  The slack makes every bound smaller than
        rounding could have made it larger.
        """
        best = np.zeros((len(cached), len(self.centres)))
        for i, j, apart in self.pairs:
            a = cached[:, i, None] * self.to_pivot[None, :, j]
            b = cached[:, j, None] * self.to_pivot[None, :, i]
            np.maximum(best, (np.abs(a - b) - SLACK * (a + b)) / apart, out=best)
        return best * best * (1 - SLACK)

    def assign(self, points: np.ndarray, cached: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (the smaller number on ties) and exact squared distance of each point."""
        lower = self.lower(cached)
        label = lower.argmin(axis=1)
        best = ((points - self.centres[label]) ** 2).sum(axis=1)
        first = label.copy()
        for c, centre in enumerate(self.centres):
            rows = np.flatnonzero((first != c) & (lower[:, c] <= best * (1 + SLACK)))
            if len(rows):
                d = squared(points[rows], centre)
                closer = (d < best[rows]) | ((d == best[rows]) & (c < label[rows]))
                label[rows[closer]], best[rows[closer]] = c, d[closer]
        return label, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _cache(pivots: list[list[int]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = np.array(pivots, np.int64)
        for batch in batches:
            points = _matrix(batch.column("point"), width)
            far = np.sqrt(np.stack([squared(points, p) for p in fixed], axis=1))
            ends = pa.array(np.arange(len(points) + 1, dtype=np.int32) * len(fixed))
            held = pa.ListArray.from_arrays(ends, pa.array(far.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, held], [*batch.schema.names, "pivot"])

    return run


def _sums(centres: list[list[int]], pivots: list[list[int]]):
    """One row per centroid and task: how many points it drew and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centres(centres, pivots)
        k, width = now.centres.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            points = _matrix(batch.column("point"), width)
            label, _ = now.assign(points, _matrix(batch.column("pivot"), len(pivots)))
            count += np.bincount(label, minlength=k)
            np.add.at(total, label, points)
        drew = np.flatnonzero(count)
        ends = pa.array(np.arange(len(drew) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(drew.astype(np.int32)), pa.array(count[drew]), pa.ListArray.from_arrays(ends, pa.array(total[drew].reshape(-1)))],
            ["cluster", "n", "total"],
        )

    return run


def _labels(centres: list[list[int]], pivots: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Centres(centres, pivots)
        for batch in batches:
            points = _matrix(batch.column("point"), now.centres.shape[1])
            label, best = now.assign(points, _matrix(batch.column("pivot"), len(pivots)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("leaf_id"), pa.array(label.astype(np.int32)), pa.array(best)], ["leaf_id", "cluster", "distance"]
            )

    return run


def cluster_descriptors(
    leaves: DataFrame, clusters: int = 8, rounds: int = 10, components: int = 64, scale: int = 1024, seed: int = 3
) -> DataFrame:
    """Group leaf descriptors (``leaf_id, curvature``) around centroids, in exact integer arithmetic.

    Each component x of ``curvature`` becomes ``floor(scale * x)``.  The first centroids are the ``clusters``
    descriptors with the smallest sha256 of ``seed:leaf_id``; each round assigns every descriptor to the nearest
    centroid and moves a centroid that drew any to the floor of their mean.  A last assignment follows.

    The first centroids also serve as pivots.  A descriptor's distances to them are computed once and kept beside it;
    in every round Ptolemy's inequality over fixed pivot pairs bounds its distance to each centroid from below, and
    only centroids that the bound cannot rule out are compared exactly.  Per round only sums per task and centroid
    leave the executors; the driver holds ``clusters`` centroids.

    Returns ``leaf_id, cluster`` (from 0), ``distance`` (squared, scaled), ``cluster_inertia, inertia`` (its sum over
    the cluster and over all) and ``centroid`` (array).  Descriptors that are null, of another length or hold a null or
    non-finite component are left out.  Repeated rows count each; equal hashes are ordered by descriptor, rows without
    an id come last among the possible first centroids.  With fewer descriptors than ``clusters`` each starts one; an
    empty table gives an empty result.  A scaled component beyond 2**27 raises an error.  Further columns are ignored.
    """
    spark = leaves.sparkSession
    ship(spark)
    finite = F.forall("curvature", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("curvature", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = (
        leaves.select("leaf_id", F.col("curvature").cast("array<double>").alias("curvature"))
        .where((F.size("curvature") == components) & finite)
        .select("leaf_id", scaled.alias("point"))
    )
    wide = F.exists("point", lambda x: F.abs(x) > LARGEST)
    kept = kept.withColumn(
        "point", F.when(wide, F.raise_error(F.lit(f"a scaled component exceeds {LARGEST}"))).otherwise(F.col("point"))
    )
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("leaf_id").cast("string")), 256)
    starts = [list(r.point) for r in kept.orderBy(rank.asc_nulls_last(), "point").limit(clusters).collect()]
    id_type = leaves.schema["leaf_id"].dataType.simpleString()
    if not starts:
        return spark.createDataFrame(
            [], f"leaf_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
        )
    points = stored(
        kept.mapInArrow(_cache(starts, components), f"leaf_id {id_type}, point array<long>, pivot array<double>"), "descriptors"
    )
    centres = [list(c) for c in starts]
    for _ in range(rounds):
        drawn = points.mapInArrow(_sums(centres, starts), "cluster int, n long, total array<long>")
        means = (
            drawn.select("cluster", "n", F.posexplode("total").alias("at", "part"))
            .groupBy("cluster", "at")
            .agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        )
        for r in means.collect():  # one number per centroid and component
            centres[r.cluster][r["at"]] = int(r.total) // r.n
    assigned = stored(points.mapInArrow(_labels(centres, starts), f"leaf_id {id_type}, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, sums[c], sum(sums.values()), centres[c]) for c in sorted(sums)]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(per), "cluster").select(  # at most `clusters` rows
        "leaf_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
