"""Exact top-k inner products by dual-tree search on cover trees.

Candidates are dealt into shards of bounded size around pivots; each task
builds a cover tree on its shard and one on its queries.  The two are descended
together: a pair of nodes with centres ``p``, ``r`` and covering radii ``a``,
``b`` cannot hold an inner product above ``p.r + |p| b + |r| a + a b``, and is
dropped if that is below the worst k-th score of the node's queries.  Points that lie too evenly for a cover
of half the radius (about as many centres as points) stay together as a leaf: leaves are compared as products of matrices, of which only scores
that beat a query's k-th are looked at.  The
search goes first to each query's own shard; the k-th scores found there are
the floor for the search over all shards.

A shard is one row, and so is a block of queries; both tables are written once, and meet as a product: a task takes a
block of queries through some of the shards with the k best so far, so a query leaves k rows per such task and not per shard.

Components are integers (``floor(scale * x)``), so scores are exact.

Defined results: vectors that are null, empty, or hold nulls or non-finite
numbers, and rows without an id, take no part; vectors of different lengths
are not compared; equal scores rank by smaller id; rows with the query's id
are not its candidates; query rows of one id and equal components are one
query, answered once, and those of one id and different components are queries
of their own, each with its ranks; repeated candidates are rows of their own;
fewer candidates than k give them all; an empty table gives no rows; other
columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix, product

SHARD_ROWS = 4096
QUERY_ROWS = 8192
PIVOTS = 64
LEAF = 48
QUERY_LEAF = 8
POINTS = 2048               # of a leaf compared at a time
SHARD = ["shard", "size", "ids", "data"]
ASKED = ["block", "size", "ids", "data", "floors", "rows"]


class CoverTree:
    """Nodes with a centre (a point), a covering radius, and children or, in leaves, points.

    Children of a node have half its scale: centres are more than the scale
    apart, and each point belongs to the first centre within the scale.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.square = (x * x).sum(1)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.points: list[np.ndarray | None] = []
        everything = np.arange(len(x))
        far = self._distance(0, everything)
        todo = [(self._node(0, far.max()), everything, far)]
        while todo:
            node, points, far = todo.pop()
            scale = self.radius[node] / 2
            if len(points) <= leaf or scale <= 0:
                self.points[node] = points
                continue
            left, far_left, at, parts = points, far, self.centre[node], []
            while len(left):
                near = far_left <= scale
                parts.append((at, left[near], far_left[near]))
                left = left[~near]
                if len(parts) >= 32 and len(points) - len(left) < 4 * len(parts):
                    break                                    # nothing is near anything
                if len(left):
                    at = int(left[0])
                    far_left = self._distance(at, left)
            if len(left):
                self.points[node] = points
                continue
            for at, mine, far_mine in parts:
                child = self._node(at, far_mine.max())
                self.children[node].append(child)
                todo.append((child, mine, far_mine))
        self.c = x[self.centre]
        self.norm = np.sqrt(self.square[self.centre])
        self.r = np.array(self.radius)

    def _node(self, centre: int, radius: float) -> int:
        self.centre.append(int(centre))
        self.radius.append(float(radius))
        self.children.append([])
        self.points.append(None)
        return len(self.centre) - 1

    def _distance(self, i: int, points: np.ndarray) -> np.ndarray:
        # whole numbers below 2**53: the squares are exact
        return np.sqrt(np.maximum(self.square[points] + self.square[i] - 2 * (self.x[points] @ self.x[i]), 0))


class DualSearch:
    """The k best of ``ids`` (vectors ``x``) for each query, no score below the query's ``floor``; ``add`` goes on with more candidates."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, k: int):
        self.Q, self.q_ids, self.k, self.floor = CoverTree(q, QUERY_LEAF), q_ids, k, floor
        self.largest = float(np.sqrt(self.Q.square.max()))
        self.score = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.compared = 0
        self.add(x, ids)

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        if not len(x):
            return
        by = np.argsort(ids, kind="stable")                  # of equal scores the smaller ids come first
        self.R, self.ids = CoverTree(x[by]), ids[by]
        # whole numbers: products and their sums are exact in single precision as long as |q| |x| is below 2**24
        kind = np.float32 if self.largest * np.sqrt(self.R.square.max()) < 1 << 24 else np.float64
        self.q, self.x = self.Q.x.astype(kind, copy=False), self.R.x.astype(kind, copy=False)
        self._descend(0, np.array([0]))

    def _least(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[queries, -1], self.floor[queries])

    def _worst(self, queries: np.ndarray) -> float:
        return float(self._least(queries).min())

    def _bounds(self, q: int, nodes: np.ndarray) -> np.ndarray:
        Q, R = self.Q, self.R
        return R.c[nodes] @ Q.c[q] + Q.norm[q] * R.r[nodes] + (R.norm[nodes] + R.r[nodes]) * Q.r[q] + 1e-6

    def _queries(self, q: int) -> np.ndarray:
        if (points := self.Q.points[q]) is None:
            points = np.concatenate([self._queries(c) for c in self.Q.children[q]])
        return points

    def _descend(self, q: int, nodes: np.ndarray) -> None:
        """Queries of node ``q`` against candidate nodes; wide candidate nodes are opened on the way down."""
        own = self._queries(q)
        nodes = nodes[self._bounds(q, nodes) >= self._worst(own)]
        if self.Q.points[q] is None:
            wide = [n for n in nodes if self.R.points[n] is None and self.R.r[n] > self.Q.r[q]]
            opened = [c for n in wide for c in self.R.children[n]]
            nodes = np.array([*(set(nodes.tolist()) - set(wide)), *opened], np.int64)
            for child in self.Q.children[q]:
                if len(nodes):
                    self._descend(child, nodes)
            return
        todo = nodes
        while len(todo):                                     # the best leaves first, opened nodes' children with the rest
            bounds = self._bounds(q, todo)
            todo = todo[np.argsort(-bounds, kind="stable")]
            if bounds.max() < self._worst(own):
                return
            n = int(todo[0])
            if self.R.points[n] is None:
                todo = np.concatenate([np.array(self.R.children[n], np.int64), todo[1:]])
            else:
                some = 1                                     # small leaves next in line are compared together
                size = len(self.R.points[n])
                while some < len(todo) and (more := self.R.points[todo[some]]) is not None and size + len(more) <= LEAF:
                    some, size = some + 1, size + len(more)
                points = self.R.points[n] if some == 1 else np.sort(np.concatenate([self.R.points[m] for m in todo[:some]]))
                for i in range(0, len(points), POINTS):
                    self._compare(own, points[i:i + POINTS])
                todo = todo[some:]

    def _compare(self, queries: np.ndarray, points: np.ndarray) -> None:
        for i in range(0, len(queries), POINTS):
            some = queries[i:i + POINTS]
            s = self.q[some] @ self.x[points].T
            self.compared += s.size
            least = self._least(some)
            # a score equal to the k-th counts if the id is smaller; whole numbers, so "at least" is exact in both precisions
            r, c = np.nonzero(s >= np.where(np.isfinite(least), least, -np.finfo(s.dtype).max).astype(s.dtype)[:, None])
            if not len(r):
                continue
            score, ids, at = s[r, c].astype(np.float64), self.ids[points[c]], some[r]
            keep = (ids != self.q_ids[at]) & ((score > self.score[at, -1]) | (ids < self.found[at, -1]))
            at, score, ids = at[keep], score[keep], ids[keep]
            if not len(at):
                continue
            rows = np.unique(at)
            held = np.isfinite(self.score[rows])
            all_at = np.concatenate([np.repeat(rows, held.sum(1)), at])
            all_score, all_ids = np.concatenate([self.score[rows][held], score]), np.concatenate([self.found[rows][held], ids])
            order = np.lexsort((all_ids, -all_score, all_at))
            all_at, all_score, all_ids = all_at[order], all_score[order], all_ids[order]
            place = np.arange(len(all_at)) - np.searchsorted(all_at, all_at)
            best = place < self.k
            self.score[all_at[best], place[best]], self.found[all_at[best], place[best]] = all_score[best], all_ids[best]


def top_k(df: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0,
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query``, the k other rows of highest inner product.  Ids are whole numbers."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    row = "id long, q boolean, data binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            usable, rows = matrix(b.column(2))
            at = np.flatnonzero(usable & np.array(b.column(0).is_valid()))
            data = [np.floor(scale * rows[i]).tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(data, pa.binary())], ["id", "q", "data"])

    rows = written(df.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vector)).mapInArrow(whole, row), "whole")
    pivots = [np.frombuffer(r[0], "<f8") for r in rows.orderBy(F.xxhash64("id"), "id").select("data").limit(PIVOTS).collect()]
    width = max((len(x) for x in pivots), key=[len(x) for x in pivots].count, default=0)
    centres = np.array([x for x in pivots if len(x) == width])
    half = (centres * centres).sum(1) / 2 if len(centres) else None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.frombuffer(v.as_buffer(), "<f8") for v in b.column(2)]
            cell = np.array([-len(x) for x in data], np.int64)                 # another length has cells of its own
            at = np.array([i for i, x in enumerate(data) if len(x) == width], np.int64)
            if len(at):
                cell[at] = np.argmax(np.array([data[i] for i in at]) @ centres.T - half, axis=1)      # nearest pivot
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["id", "q", "data", "cell"])

    dealt = rows.mapInArrow(deal, row + ", cell long")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("salts"))
    placed = dealt.join(F.broadcast(sizes) if width and sizes.count() <= 4 * PIVOTS else sizes, "cell")
    placed = placed.select("id", "q", "data", (F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id"), "salts")).alias("shard"))

    def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
        """Runs of rows with the same last ``keys`` columns."""
        now, held = None, []
        for b in batches:
            last = [c.to_numpy() for c in b.columns[-keys:]]
            cut = np.flatnonzero(np.append(True, np.any([np.diff(c) != 0 for c in last], axis=0))) if len(b) else []
            for s, e in zip(cut, [*cut[1:], len(b)]):
                if (here := tuple(int(c[s]) for c in last)) != now:
                    if held:
                        yield now, pa.Table.from_batches(held)
                    now, held = here, []
                held.append(b.slice(s, e - s))
        if held:
            yield now, pa.Table.from_batches(held)

    def stacked(column: pa.ChunkedArray) -> np.ndarray:
        return np.array([np.frombuffer(v.as_buffer(), "<f8") for v in column])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per shard; the places of its queries (of equal rows one) stand with it."""
        for (shard,), t in runs(batches, 1):
            ids, data = t.column(0).to_numpy(), t.column(2).to_pylist()
            first = {(i, x): n for n, (i, x, q) in reversed(list(enumerate(zip(ids.tolist(), data, t.column(1).to_pylist())))) if q}
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(data[0])], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                                              pa.array([b"".join(data)], pa.binary()), pa.array([np.array(sorted(first.values()), "<i8").tobytes()], pa.binary())], [*SHARD, "asked"])

    kinds = "shard long, size int, ids binary, data binary"
    shards = placed.repartition(parts, "shard").sortWithinPartitions("shard", "id").select("id", "q", "data", "shard")
    shards = written(shards.mapInArrow(pack, kinds + ", asked binary"), "shards")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of each shard with the k-th score that they find in it."""
        for b in batches:
            for shard, size, ids, data, asked in zip(*(c.to_pylist() for c in b.columns)):
                at = np.frombuffer(asked, "<i8")
                if len(at):
                    ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(data, "<f8").reshape(-1, size // 8)
                    floor = DualSearch(x, ids, x[at], ids[at], np.full(len(at), -np.inf), k).score[:, -1]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([v.tobytes() for v in x[at]], pa.binary()), pa.array(floor)], ["id", "data", "floor"])

    # A query is a distinct (id, components); ``row`` is its number.
    asked = written(shards.mapInArrow(own, "id long, data binary, floor double").withColumn("row", F.monotonically_increasing_id()), "queries")
    many = asked.groupBy(F.length("data").alias("size")).agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("blocks"))
    asked = asked.withColumn("size", F.length("data")).join(many, "size")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (size, block), t in runs(batches, 2):
            row = [block, size, t.column(0).to_numpy().tobytes(), b"".join(t.column(1).to_pylist()), t.column(2).to_numpy().tobytes(), t.column(3).to_numpy().tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, [pa.int64(), pa.int32(), *[pa.binary()] * 4])], ASKED)

    asked = asked.select("id", "data", "floor", "row", "size", F.pmod(F.xxhash64("row"), "blocks").alias("block"))
    asked = asked.repartition(parts, "size", "block").sortWithinPartitions("size", "block")
    asked = written(asked.mapInArrow(blocked, "block long, size int, ids binary, data binary, floors binary, rows binary"), "asked")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block of queries through the shards that come with it."""
        now, s, numbers = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if s is not None:
                at, place = np.nonzero(np.isfinite(s.score))
                for i in range(0, len(at), 1 << 16):
                    a, p = at[i:i + (1 << 16)], place[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(s.q_ids[a]), pa.array(s.found[a, p]), pa.array(s.score[a, p].astype(np.int64)), pa.array(numbers[a])],
                                                     ["query_id", "vec_id", "score", "row"])

        for b in batches:
            for i in range(len(b)):
                block, size = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                x, ids = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in ((9, "<f8"), (8, "<i8")))
                if (block, size) == now:
                    s.add(x.reshape(-1, size // 8), ids)
                    continue
                yield from done()
                now = block, size
                q_ids, q, floor, numbers = (np.frombuffer(b.column(c)[i].as_buffer(), t).copy() for c, t in ((2, "<i8"), (3, "<f8"), (4, "<f8"), (5, "<i8")))
                s = DualSearch(x.reshape(-1, size // 8), ids, q.reshape(-1, size // 8), q_ids, floor, k)
        yield from done()

    # The stated queries against all rows: a block of queries meets every shard of its vector length.
    one, other = (t.select(*[F.col(c).alias(f"{c}_{side}") for c in names]) for t, names, side in ((asked, ASKED, "q"), (shards, SHARD, "r")))
    met = product(one, other, F.col("size_q") == F.col("size_r"))
    found = written(met.mapInArrow(search, "query_id long, vec_id long, score long, row long"), "found")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
