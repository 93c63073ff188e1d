"""Nearest leaf descriptors by inner product: vantage-point trees per shard with relaxed triangle-inequality pruning.

Vectors get one more component, the root of M² - |x|² with M the largest length, and queries a zero there.  The squared
distance is then |q|² + M² - 2 q·x, so the nearest point is the one with the largest inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .store import stored

SAMPLE = 8192  # vectors that the shard boundaries are fitted on, about
LEAF = 48  # points in a tree leaf
SHARD_ROWS = 4096  # points in a shard, about
QUERY_ROWS = 8192  # queries that meet a shard in one task, about


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Points with the component that turns inner products into distances."""
    rest = np.sqrt(np.maximum(largest**2 - np.einsum("ij,ij->i", x, x), 0))
    return np.hstack([x, rest[:, None]])


class Tree:
    """A vantage-point tree; inner nodes are ``(point, radius, near, far)``, leaves index arrays."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.leaf = leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        points = self.points[at]
        # The vantage point lies far from the middle, where distances spread most.
        vantage = points[int(np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1)))]
        d = np.sqrt(((points - vantage) ** 2).sum(axis=1))
        radius = float(np.median(d))
        near = d <= radius
        if near.all() or not near.any():
            return at
        return vantage, radius, self._build(at[near]), self._build(at[~near])

    def visit(self, queries: np.ndarray, reach: np.ndarray, factor: float, scan) -> None:
        """Call ``scan(rows, points)`` for the leaves that each query has to see; ``reach`` may shrink meanwhile.

        A side is skipped once ``factor`` times its least possible distance exceeds the reach.  Each query sees its own
        side first.
        """

        def go(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                scan(rows, node)
                return
            vantage, radius, near, far = node
            d = np.sqrt(((queries[rows] - vantage) ** 2).sum(axis=1))
            inside = d <= radius
            go(near, rows[inside])
            go(far, rows[~inside])
            gap = factor * np.abs(d - radius) <= reach[rows]
            go(far, rows[inside & gap])
            go(near, rows[~inside & gap])

        go(self.root, np.arange(len(queries)))

    def cells(self) -> list[np.ndarray]:
        out: list[np.ndarray] = []

        def go(node) -> None:
            if isinstance(node, np.ndarray):
                out.append(node)
            else:
                go(node[2])
                go(node[3])

        go(self.root)
        return out


class Cells(Tree):
    """The tree of a bounded sample whose leaves are the shards."""

    def __init__(self, sample: np.ndarray, shards: int):
        super().__init__(sample, max(8, -(-len(sample) // shards)))
        self.number = {id(leaf): k for k, leaf in enumerate(self.cells())}

    def own(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)

        def go(node, rows: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                out[rows] = self.number[id(node)]
            elif len(rows):
                d = np.sqrt(((points[rows] - node[0]) ** 2).sum(axis=1))
                go(node[2], rows[d <= node[1]])
                go(node[3], rows[d > node[1]])

        go(self.root, np.arange(len(points)))
        return out


class _Best:
    """The k best scores of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        s = np.hstack([self.score[rows], score])
        i = np.hstack([self.id[rows], ids])
        order = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(s, order, axis=1)
        self.id[rows] = np.take_along_axis(i, order, axis=1)


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column]).reshape(len(column), -1)


def _search(points: pd.DataFrame, queries: pd.DataFrame, k: int, factor: float, largest: float) -> pd.DataFrame:
    """The k nearest of one shard's points for each query sent to it."""
    x, q = _matrix(points["curvature"]), _matrix(queries["curvature"])
    ids = np.full((len(x), k + 1), np.iinfo(np.int64).max)  # smallest ids of each distinct vector
    for r, got in enumerate(points["leaf_ids"]):
        ids[r, : len(got)] = got
    own = queries["query_id"].to_numpy()
    reach = queries["reach"].to_numpy(np.float64).copy()
    best = _Best(len(q), k)
    limit = np.einsum("ij,ij->i", q, q) + largest**2

    def scan(rows: np.ndarray, at: np.ndarray) -> None:
        for b in range(0, len(rows), 512):
            some = rows[b : b + 512]
            close = q[some] @ x[at].T
            floor = best.score[some, -1]
            hit_row, hit = np.nonzero(close >= floor[:, None] - 1e-9)
            if not len(hit):
                continue
            score = np.einsum("ij,ij->i", q[some[hit_row]], x[at[hit]])  # equal vectors get equal scores
            # One row per query: pad to the longest list of hits.
            count = np.bincount(hit_row, minlength=len(some))
            place = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
            grid = np.full((len(some), int(count.max())), -1)
            grid[hit_row, place] = np.arange(len(hit))
            s = np.where(grid >= 0, score[grid], -np.inf)
            keep = np.argsort(-s, axis=1, kind="stable")[:, : 2 * k + 2]
            s, grid = np.take_along_axis(s, keep, axis=1), np.take_along_axis(grid, keep, axis=1)
            names = np.where(grid[:, :, None] >= 0, ids[at[hit[grid]]], np.iinfo(np.int64).max)
            s = np.repeat(s[:, :, None], k + 1, axis=2)
            s = np.where((names == own[some][:, None, None]) | (names == np.iinfo(np.int64).max), -np.inf, s)
            best.offer(some, s.reshape(len(some), -1), names.reshape(len(some), -1))
            kth = best.score[some, -1]
            found = np.isfinite(kth)
            reach[some[found]] = np.minimum(
                reach[some[found]], np.sqrt(np.maximum(limit[some[found]] - 2 * kth[found], 0)) * (1 + 1e-9) + 1e-9
            )

    Tree(lifted(x, largest)).visit(np.hstack([q, np.zeros((len(q), 1))]), reach, factor, scan)
    row, col = np.nonzero(np.isfinite(best.score))
    return pd.DataFrame({"query_id": own[row], "leaf_id": best.id[row, col], "score": best.score[row, col]})


def nearest_leaves(leaves: DataFrame, queries: DataFrame, k: int = 20, factor: float = 6.0) -> DataFrame:
    """The ``k`` leaves whose curvature descriptors have the largest inner product with each query's.

    ``leaves`` and ``queries`` have ``leaf_id`` (integer) and ``curvature`` (array of numbers).  Descriptors that are null,
    zero or hold null or non-finite numbers take no part, nor do those of another length than most.  A query is never
    its own neighbour.

    Equal descriptors collapse first, keeping the k + 1 smallest ids, which are the only ones that can be returned.  The
    top of a vantage-point tree, fitted on a sample of about ``SAMPLE`` vectors, deals all others into shards; large
    shards are split by a hash.  The sample also gives each query a first reach.  A query goes to the shards that its
    reach, divided by ``factor``, touches; there a tree of all points prunes by the same rule.  Factor 1 gives exact
    search.

    Returns ``query_id, rank`` (from 1)``, leaf_id, score``, ties to the smaller id.  Rows that repeat an id count once
    if the descriptor is the same; a query id with several descriptors asks with the smallest.  Empty tables give an empty
    result; further columns are ignored.
    """
    ship(leaves.sparkSession)

    def sound(df: DataFrame) -> DataFrame:
        wide = df.where("leaf_id is not null and curvature is not null").select(
            F.col("leaf_id").cast("long").alias("leaf_id"), F.expr("transform(curvature, c -> cast(c as double))").alias("curvature")
        )
        return wide.where(
            "forall(curvature, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))"
            " and exists(curvature, c -> c <> 0)"
        )

    rows = sound(leaves)
    usual = rows.groupBy(F.size("curvature").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    schema = "query_id long, leaf_id long, score double"
    if usual is None:
        return leaves.sparkSession.createDataFrame([], "query_id long, rank int, leaf_id long, score double")
    same = F.size("curvature") == usual["n"]
    rows = rows.where(same).dropDuplicates(["leaf_id", "curvature"])
    # Equal vectors: first within salted parts, then together, so a common vector never meets in one task.
    salted = Window.partitionBy("curvature", "part").orderBy("leaf_id")
    together = Window.partitionBy("curvature").orderBy("leaf_id")
    few = (
        rows.withColumn("part", F.expr("pmod(xxhash64(leaf_id), 64)"))
        .withColumn("n", F.row_number().over(salted))
        .where(f"n <= {k + 1}")
        .withColumn("n", F.row_number().over(together))
        .where(f"n <= {k + 1}")
    )
    points = stored(few.groupBy("curvature").agg(F.sort_array(F.collect_list("leaf_id")).alias("leaf_ids")), "points")
    longest, total = points.agg(
        F.max(F.expr("aggregate(curvature, double(0), (a, c) -> a + c * c)")), F.count("*")
    ).first()
    largest = float(np.sqrt(longest)) * (1 + 1e-12)
    part = min(1.0, SAMPLE / total)
    drawn = points.where(F.expr(f"pmod(xxhash64(curvature), 1000000) < {part * 1e6}")).toPandas()
    if drawn.empty:
        drawn = points.limit(1).toPandas()
    sample = _matrix(drawn["curvature"])
    alone: dict[int, list[int]] = {}
    for c, ids in enumerate(drawn["leaf_ids"]):
        if len(ids) == 1:
            alone.setdefault(int(ids[0]), []).append(c)
    cells = Cells(lifted(sample, largest), max(1, -(-total // SHARD_ROWS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells.number = {id(leaf): n for n, leaf in enumerate(cells.cells())}
        for batch in batches:
            if batch.num_rows:
                own = cells.own(lifted(_matrix(batch.column("curvature").to_pylist()), largest))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), batch.column("leaf_ids"), batch.column("curvature")], ["cell", "leaf_ids", "curvature"]
                )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {id(leaf): n for n, leaf in enumerate(cells.cells())}
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("curvature").to_pylist())
            own = batch.column("leaf_id").to_numpy()
            score = q @ sample.T
            for r, name in enumerate(own.tolist()):  # a sampled vector held only by the query itself is no candidate
                score[r, alone.get(name, [])] = -np.inf
            reach = np.full(len(q), np.inf)
            if score.shape[1] > k:
                kth = np.partition(score, -k, axis=1)[:, -k]
                square = np.einsum("ij,ij->i", q, q) + largest**2 - 2 * kth
                reach = np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-9
            went: list[tuple[np.ndarray, int]] = []
            cells.visit(np.hstack([q, np.zeros((len(q), 1))]), reach, factor, lambda rows, leaf: went.append((rows, number[id(leaf)])))
            row = np.concatenate([r for r, _ in went])
            cell = np.concatenate([np.full(len(r), c, np.int32) for r, c in went])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(own[row]), batch.column("curvature").take(pa.array(row)), pa.array(reach[row])],
                ["cell", "query_id", "curvature", "reach"],
            )

    placed = points.select("leaf_ids", "curvature").mapInArrow(place, "cell int, leaf_ids array<long>, curvature array<double>")
    placed = stored(placed, "placed")
    asked = sound(queries).where(same).groupBy("leaf_id").agg(F.min("curvature").alias("curvature"))
    sent = stored(
        asked.mapInArrow(route, "cell int, query_id long, curvature array<double>, reach double"), "routed"
    )
    size = placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * SHARD_ROWS)).cast("int").alias("parts"))
    blocks = sent.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    layout = size.join(blocks, "cell")
    left = (
        placed.join(layout, "cell")
        .withColumn("part", F.expr("cast(pmod(xxhash64(curvature), parts) as int)"))
        .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("cell", "part", "block", "leaf_ids", "curvature")
    )
    right = (
        sent.join(layout, "cell")
        .withColumn("block", F.expr("cast(pmod(xxhash64(query_id), blocks) as int)"))
        .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        .select("cell", "part", "block", "query_id", "curvature", "reach")
    )

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if points.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "leaf_id": [], "score": []}).astype({"query_id": "int64", "leaf_id": "int64"})
        return _search(points, queries, k, factor, largest)

    key = ["cell", "part", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "leaf_id"))
    return found.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "leaf_id", "score")
