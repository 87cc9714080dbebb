"""Embedding near-dedup: spherical k-means cells, blocked cosines within cells, one representative per group.

Equal vectors are one node with a number of copies.  Cells are fitted by
spherical k-means on at most ``sample_rows`` vectors; every vector gets its
nearest centre's cell as home.  A vector has partners only in cells that it
reaches: if ``a`` lives in cell ``c`` and the angle between ``a`` and ``b`` (home
``h``) is at most ``t``, then ``b`` lies at most ``sin t`` behind the plane between
``h`` and ``c``.  So no link is lost, whatever the centres; a poor fit only makes
more comparisons.

Each vector is written once, in a block of its home cell (small cells share a block).  Blocks meet in pairs,
each pair once, as a product of the table of blocks with itself: tasks read both sides from that table, so no copy is
dealt out or kept on disk.  Of two blocks, the vectors of one cell that reach another meet those that reach back: first
by an upper bound of the cosine (a few components of both after a rotation, and the lengths of what is left of
them), then, where that leaves a chance, by all components.  Links are counted per vector, and of each pair of
blocks the links kept are a spanning forest, so a large group of near copies costs
comparisons but not a row per pair.

Defined results: vectors that are null, empty, zero, or hold nulls or
non-finite numbers have no links and are components of their own; vectors of
different lengths do not link; huge and tiny finite components are compared as any (all of a
vector are scaled by one power of two first); repeated rows are copies that link; null ids
name a component only if it has no other; other columns are passed by; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components, roots
from .vectors import matrix, product

SAMPLE_ROWS = 20_000
MAX_CELLS = 2048
CELL_ROWS = 2000
BLOCK_ROWS = 8192
BLOCK = ["grp", "salt", "size", "half", "cells", "names", "copies", "data", "reach"]


def fit_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors: centres of unit length."""
    if not len(x):
        return x
    k = min(k, len(x))
    chosen, best = [0], x @ x[0]
    for _ in range(k - 1):                                   # the next centre is the vector least like all so far
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        home = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        length = np.linalg.norm(sums, axis=1)
        full = length > 1e-12
        centres[full] = sums[full] / length[full, None]
    return np.unique(centres, axis=0)


def forest(rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between rows and columns, pairs (node, root) that connect the same; columns count from ``n_rows`` on."""
    label = roots(rows, columns + n_rows, n_rows + n_columns)
    node = np.flatnonzero(label != np.arange(len(label)))
    return node, label[node]


def rotation(x: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """For unit vectors ``x``: the directions they spread along most first, and how many of these the upper bound of cosines takes."""
    width = x.shape[1] if x.size else 0
    if not width:
        return np.zeros((0, 0)), 0
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    some = x[:: max(1, len(x) // 1500)] @ turn
    cost = {}
    for d in sorted({min(width, n) for n in (8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, width)}):
        part = some[:, :d]
        left = np.sqrt(np.maximum(1 - (part * part).sum(1), 0))
        cost[d] = 20 + d + 30 * width * ((part @ part.T + left[:, None] * left) >= least).mean()      # steps a pair: product, choice, pairs compared in full
    return turn, min(cost, key=cost.get)


class Block:
    """Vectors of one width, in the order of their cells, with what comparing them takes."""

    def __init__(self, row: tuple, turn: np.ndarray, parts: int, width: int):
        self.grp, self.salt, size, half, cells, names, copies, data = row
        self.x = np.frombuffer(data, "<f4" if half else "<f8").reshape(-1, size).astype("f8")
        self.cells, self.names, self.copies = np.frombuffer(cells, "<i4"), np.frombuffer(names, "S32"), np.frombuffer(copies, "<i8")
        self.norm = np.linalg.norm(self.x, axis=1)
        self.u = self.x / self.norm[:, None]
        part = self.u @ turn[:, :parts] if size == width else self.u
        self.bound = np.concatenate([part, np.sqrt(np.maximum(1 - (part * part).sum(1), 0))[:, None]], 1).astype("f4")
        cut = np.flatnonzero(np.diff(self.cells)) + 1
        self.runs = list(zip(self.cells[[0, *cut]].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(self.cells)]))


def _true(x: np.ndarray) -> np.ndarray:
    """The places of few true values in an array, read eight at once."""
    flat = np.ascontiguousarray(x).reshape(-1)
    n = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:n].view(np.uint64))
    at = (eights[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([at[flat[at]], n + np.flatnonzero(flat[n:])])


def linked(a: Block, b: Block, least: float, reaches) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) in batches; ``reaches(block, cell, start, stop)``: the rows of one cell that may have partners in another."""
    bound = least - 1e-6 * (a.bound.shape[1] + 10)           # single precision
    for h, s, e in a.runs:
        for c, t, z in b.runs:
            i, j = reaches(a, c, s, e), reaches(b, h, t, z)
            p, q = a.bound[i], b.bound[j]
            for m in range(0, len(i), 512):
                for k in range(0, len(j), 2048):
                    high = p[m:m + 512] @ q[k:k + 2048].T >= bound
                    at = _true(high)
                    r, o = i[m + at // high.shape[1]], j[k + at % high.shape[1]]
                    if len(at) * 50 > high.size:
                        rows, others = i[m:m + 512], j[k:k + 2048]
                        x, y = np.nonzero((a.x[rows] @ b.x[others].T) / (a.norm[rows, None] * b.norm[others]) >= least)
                        yield rows[x], others[y]
                    elif len(at):
                        found = np.einsum("ij,ij->i", a.x[r], b.x[o]) / (a.norm[r] * b.norm[o]) >= least
                        yield r[found], o[found]


def link(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, sample_rows: int = SAMPLE_ROWS,
         cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``key, n_links, component_id, kept`` of each row: links are cosines of at least ``least``."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = df.schema[key].dataType.simpleString()
    df = df.select(F.col(key).alias("k"), F.col(vector).alias("v"))          # no name of the input meets one of ours

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            usable, rows = matrix(b.column(1))
            # a power of two on all components changes no cosine, and keeps norms of huge and tiny ones in range
            rows = [np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) if x is not None and x.any() else None for x in rows]
            data = [x.astype("<f8").tobytes() if x is not None else None for x in rows]
            node = [hashlib.blake2b(x, digest_size=16).hexdigest() if x else None for x in data]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.string()), pa.array(data, pa.binary())], ["k", "node", "data"])

    data = df.mapInArrow(digests, f"k {kind}, node string, data binary")
    rows = written(data.select("k", "node"), "vectors")
    nodes = written(data.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("data").alias("data")), "nodes")
    n = nodes.count()
    sampled = [np.frombuffer(r[0], "<f8") for r in nodes.orderBy("node").select("data").limit(sample_rows).collect()]  # bounded: sample_rows vectors
    width = max((len(x) for x in sampled), key=[len(x) for x in sampled].count, default=0)
    x = np.array([v / np.linalg.norm(v) for v in sampled if len(v) == width])
    centres = fit_centres(x, max(1, min(MAX_CELLS, n // cell_rows)))
    turn, parts_taken = rotation(x, least)
    back = float(np.sqrt(max(1 - least * least, 0))) + 1e-9
    gaps = np.array([[np.linalg.norm(c - d) for d in centres] for c in centres]) if len(centres) <= 64 else \
        np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.frombuffer(v.as_buffer(), "<f8") for v in b.column(2)]
            cell = np.array([-len(v) for v in data], np.int64)               # another length: a cell for each
            at = np.array([i for i, v in enumerate(data) if len(v) == width], np.int64)
            if len(at):
                cell[at] = np.argmax(np.array([data[i] / np.linalg.norm(data[i]) for i in at]) @ centres.T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["node", "copies", "data", "cell"])

    homes = nodes.mapInArrow(deal, "node string, copies long, data binary, cell long")
    # Blocks: (grp, salt).  Small cells next to each other share a grp; a cell beyond block_rows is dealt out over salts.
    counted = {r.cell: r.n for r in homes.where("cell >= 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}      # at most MAX_CELLS rows
    group, sizes = np.zeros(max(len(centres), 1), np.int64), []
    for c in range(len(centres)):
        if not sizes or sizes[-1] + counted.get(c, 0) > block_rows:
            sizes.append(0)
        sizes[-1] += counted.get(c, 0)
        group[c] = len(sizes) - 1
    group_of = F.array(*[F.lit(int(g)) for g in group]).cast("array<long>")
    salts_of = F.array(*[F.lit(max(1, -(-m // block_rows))) for m in sizes or [0]]).cast("array<long>")
    placed = homes.where("cell >= 0").withColumn("grp", F.get(group_of, F.col("cell").cast("int"))).withColumn("salts", F.get(salts_of, F.col("grp").cast("int")))
    odd = homes.where("cell < 0")
    odd = odd.join(odd.groupBy(F.col("cell").alias("grp")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("salts")), F.col("cell") == F.col("grp"))
    placed = placed.unionByName(odd).select("grp", F.pmod(F.xxhash64("node"), "salts").alias("salt"), "cell", "node", "copies", "data")

    def near_by(u: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each vector reaches each cell."""
        near = u @ centres.T
        own = near[np.arange(len(u)), cells]
        behind = own[:, None] - near <= back * gaps[cells]
        behind[np.arange(len(u)), cells] = True
        return behind

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per block; ``reach``: the groups with cells that a vector of it reaches."""
        now, held = None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                cells = t.column(2).to_numpy()
                x = np.array([np.frombuffer(v.as_buffer(), "<f8") for v in t.column(5)])
                reach = np.unique(group[near_by(x / np.linalg.norm(x, axis=1)[:, None], cells).any(0)]) if now[0] >= 0 else np.array(now[:1])
                with np.errstate(over="ignore", under="ignore"):
                    half = bool((x.astype("<f4").astype("f8") == x).all())
                row = [*now, x.shape[1], half, cells.astype("<i4").tobytes(), "".join(t.column(3).to_pylist()).encode(), t.column(4).to_numpy().astype("<i8").tobytes(),
                       x.astype("<f4" if half else "<f8").tobytes(), reach.tolist()]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], BLOCK)

        for b in batches:
            grps, salts = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.flatnonzero(np.append(True, (np.diff(grps) != 0) | (np.diff(salts) != 0))) if len(b) else []
            for s, e in zip(cut, [*cut[1:], len(b)]):
                if (int(grps[s]), int(salts[s])) != now:
                    yield from finish()
                    now, held = (int(grps[s]), int(salts[s])), []
                held.append(b.slice(s, e - s))
        yield from finish()

    blocks = placed.repartition(parts, "grp", "salt").sortWithinPartitions("grp", "salt", "cell")
    blocks = written(blocks.mapInArrow(pack, "grp long, salt long, size int, half boolean, cells binary, names binary, copies binary, data binary, reach array<long>"), "blocks")

    def reaches(block: Block, cell: int, start: int, stop: int) -> np.ndarray:
        own = block.cells[start]
        if own == cell:
            return np.arange(start, stop)
        return start + np.flatnonzero(block.u[start:stop] @ (centres[own] - centres[cell]) <= back * gaps[own, cell])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``a, n`` (rows that vector a links with) and ``a, b`` (links that connect)."""
        left, counts = None, None

        def counted(names: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(names[at].astype("U32"), pa.string()), pa.nulls(len(at), pa.string()), pa.array(n[at])], ["a", "b", "n"])

        for batch in batches:
            for k in range(len(batch)):
                key = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if left is None or key != (left.grp, left.salt):
                    if left is not None:
                        yield counted(left.names, counts)
                    left = Block(tuple(c[k].as_py() for c in batch.columns[:8]), turn, parts_taken, width)
                    counts = np.zeros(len(left.names), np.int64)
                right = Block(tuple(c[k].as_py() for c in batch.columns[8:]), turn, parts_taken, width)
                same = key == (right.grp, right.salt)
                both, others = np.concatenate([left.names, right.names]), np.zeros(len(right.names), np.int64)
                held, size = [], 0
                for r, c in linked(left, right, least, reaches):
                    np.add.at(counts, r, right.copies[c])
                    if not same:
                        np.add.at(others, c, left.copies[r])
                    held.append((r, c + len(left.names)))
                    size += len(r)
                    if size > 1 << 20:
                        node, root = forest(*(np.concatenate(v) for v in zip(*held)), 0, len(both))
                        held, size = [(node, root)], 0
                if held:
                    a, z = (np.concatenate(v) for v in zip(*held))
                    node, root = forest(a, z, 0, len(both))
                    keep = both[node] != both[root]
                    if keep.any():
                        yield pa.RecordBatch.from_arrays([pa.array(both[node[keep]].astype("U32"), pa.string()), pa.array(both[root[keep]].astype("U32"), pa.string()),
                                                          pa.nulls(int(keep.sum()), pa.int64())], ["a", "b", "n"])
                if not same and others.any():
                    yield counted(right.names, others)
        if left is not None:
            yield counted(left.names, counts)

    # Each pair of blocks once, of those that reach each other.
    one, other = (blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in BLOCK]) for side in "ab")
    meet = ((F.col("grp_a") < F.col("grp_b")) | ((F.col("grp_a") == F.col("grp_b")) & (F.col("salt_a") <= F.col("salt_b")))) & (F.col("size_a") == F.col("size_b")) \
        & F.array_contains("reach_a", F.col("grp_b")) & F.array_contains("reach_b", F.col("grp_a"))
    met = product(one, other, meet).select(*[f"{c}_{side}" for side in "ab" for c in BLOCK[:-1]])
    found = written(met.mapInArrow(compare, "a string, b string, n long"), "links")
    label = components(found.where("b is not null").select("a", "b").distinct()).toDF("node", "component")
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg((F.sum("n") - 1).alias("n_links"))
    out = rows.select("k", "node").join(counts, "node", "left").join(label, "node", "left")
    out = out.withColumn("component", F.coalesce("component", "node"))
    names = out.where("component is not null").groupBy("component").agg(F.min("k").alias("name"))
    out = out.join(names, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("k")).otherwise(F.col("name")))
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))
