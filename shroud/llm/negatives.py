"""Hard-negative mining by threshold joins over an inverted index (after L2AP).

Rows stand in shards.  A shard is searched with a group of anchors and a least score
for each anchor: every row gets a number of leading dimensions whose norm, times
the greatest norm of the group, stays below the least score of all; these are left
out of the index, the rest stands in one list (rows, weights) per dimension.  The lists
are read from the last dimension to the first and add up partial scores; a row
is dropped once, for each anchor, its partial score and the product of both remaining norms
stay below the anchor's least score.  What is left is verified with whole vectors.

An anchor first searches its own shard, from a high least score downwards, until its
windows are full there or nothing is left to find; the worst score kept is then
its least score in all other shards, so that these are searched once.  This is done
first for the positives (the ``positives`` rows of the same label with the highest scores),
then for the windows of negatives that each positive opens.  Shards send at most
as many rows as a window takes; Spark ranks them.  Anchors go to all shards; a shard
holds a bounded number of rows and reads anchors in bounded groups.

Components are whole numbers (``floor(scale * x)``) and scores exact 64-bit integers.

Defined results: a row takes no part if its label or vector is null, its vector is empty or holds
a null or non-finite component, or its whole numbers have a norm of 2**31 or more
(scores then still fit 64 bits); vectors of different lengths are compared as if the shorter one went
on with zeros; rows equal in key, label and vector are one row; rows under the anchor's own key are never its positives or
negatives; ties go to the smaller key, null keys last; an anchor without
positives and a positive without negatives give no rows, nor does an empty table; other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import matrix

SHARD_ROWS = 4096
GROUP_ROWS = 256
STEP = 8
FIRST, LOWER, LAST = 0.9, 0.8, 0.05


def padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


class Shard:
    """Rows in key order, with the norms of their leading dimensions."""

    def __init__(self, whole: np.ndarray):
        self.whole, self.x = whole, whole.astype(float)
        self.norms = np.hstack([np.zeros((len(whole), 1)), np.sqrt(np.cumsum(self.x ** 2, axis=1))])   # [:, p]: first p dimensions

    def index(self, bound: float) -> np.ndarray:
        """How many leading dimensions of each row the index leaves out: their norm is below ``bound``."""
        return np.maximum((self.norms < bound).sum(axis=1) - 1, 0) if bound > 0 else np.zeros(len(self.x), np.int64)

    def reach(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs whose score is at least the anchor's ``least``."""
        q = anchors.astype(float)
        norms = np.hstack([np.zeros((len(q), 1)), np.sqrt(np.cumsum(q ** 2, axis=1))])
        n, d = self.x.shape
        greatest = norms[:, -1].max(initial=0)
        low = least.min(initial=np.inf)
        left_out = self.index(low / greatest * (1 - 1e-9)) if greatest and np.isfinite(low) else np.zeros(n, np.int64)
        slack = 1e-9 * greatest * self.norms[:, -1] + 1e-6
        alive, partial = np.arange(n), np.zeros((n, len(q)))
        for at in range(d - 1, -1, -1):
            rows = np.flatnonzero(left_out[alive] <= at)      # the list of this dimension
            if len(rows) == len(alive):
                partial += self.x[alive, at][:, None] * q[:, at]
            elif len(rows):
                partial[rows] += self.x[alive[rows], at][:, None] * q[:, at]
            if at % STEP == 0:
                rest = np.maximum(left_out[alive], at)
                keep = (partial + self.norms[alive, rest][:, None] * norms[:, rest].T + slack[alive, None] >= least).any(axis=1)
                if not keep.all():
                    alive, partial = alive[keep], partial[keep]
        rest = left_out[alive]
        r, a = np.nonzero(partial + self.norms[alive, rest][:, None] * norms[:, rest].T + slack[alive, None] >= least)
        r = alive[r]
        score = np.concatenate([np.einsum("ij,ij->i", anchors[a[i:i + 65536]], self.whole[r[i:i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])
        found = score >= least[a]
        a, r, score = a[found], r[found], score[found]
        order = np.lexsort((r, -score, a))
        return a[order], r[order], score[order]


def firsts(group: np.ndarray, take: int) -> np.ndarray:
    """Which of the rows are among the first ``take`` of their group (groups ascend)."""
    start = np.searchsorted(group, group, "left")
    return np.arange(len(group)) - start < take


def search(shard: Shard, anchors: np.ndarray, allowed, windows: list[tuple[np.ndarray, np.ndarray]], floors: np.ndarray, take: int,
           own: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per window the first ``take`` (anchor, row, score) with low <= score <= high that ``allowed(anchor, row)`` holds for.

    ``windows[w]`` gives each anchor's low and high (low > high: none), ``floors[w]`` a score below which nothing is asked for.
    In the anchors' own shard least scores start high and are lowered until the windows are full.
    """
    scale = np.linalg.norm(anchors.astype(float), axis=1) * shard.norms[:, -1].max(initial=0)
    bottom = np.array([np.maximum(low, f) for (low, _), f in zip(windows, floors)])
    asked = np.array([low <= high for low, high in windows])
    out = [([], [], []) for _ in windows]
    step = FIRST if own else None
    while asked.any():
        open_ = np.flatnonzero(asked.any(axis=0))
        needed = np.where(asked, bottom, np.inf).min(axis=0)[open_]
        least = needed if step is None or step < LAST else np.maximum(needed, step * np.minimum(scale, np.where(asked, [h for _, h in windows], -np.inf).max(axis=0))[open_])
        a, r, score = shard.reach(anchors[open_], least)
        ok = allowed(open_[a], r)
        a, r, score = a[ok], r[ok], score[ok]
        for w, (low, high) in enumerate(windows):
            mine = asked[w, open_[a]] & (score <= high[open_[a]]) & (score >= bottom[w, open_[a]])
            wa, wr, ws = open_[a[mine]], r[mine], score[mine]
            kept = firsts(wa, take)
            full = np.bincount(wa[kept], minlength=len(anchors)) >= take
            least_of = np.full(len(anchors), np.inf)
            least_of[open_] = least
            done = asked[w] & (full | (least_of <= bottom[w]))
            use = kept & done[wa]
            for held, new in zip(out[w], (wa[use], wr[use], ws[use])):
                held.append(new)
            asked[w] &= ~done
        step = None if step is None else step * LOWER
    return [tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in held) for held in out]


def mine(df: DataFrame, anchors: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, positives: int = 5,
         negatives: int = 10, low: int = 30, high: int = 90, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor row and each of its first ``positives``
    rows of the same label the first ``negatives`` rows of another label with ``low`` <= 100 * score / positive score <= ``high``."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = df.schema[key].dataType.simpleString()
    df = df.select(F.col(key).alias("k"), F.col(label).cast("string").alias("l"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).alias("v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            use, data = matrix(b.column(3))
            keep, sent = [], []
            for i in np.flatnonzero(use):
                x = np.floor(np.maximum(np.minimum(data[i] * scale, 1e300), -1e300))
                if np.sqrt(np.sum(np.minimum(np.abs(x), 2.0 ** 40) ** 2)) < 2.0 ** 31:
                    keep.append(i), sent.append(x.astype("<i8").tobytes())
            part = b.take(pa.array(keep, pa.int64()))
            name = [hashlib.blake2b(repr((k, l)).encode() + x, digest_size=16).hexdigest() for k, l, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), sent)]
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), *part.columns[:3], pa.array(sent, pa.binary())], ["id", "k", "l", "anchor", "data"])

    rows = df.where("l is not null").mapInArrow(whole, f"id string, k {kind}, l string, anchor boolean, data binary").dropDuplicates(["id"])
    rows = written(rows, "vectors")
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard")
    none = F.array().cast("array<bigint>")
    held = rows.select(shard, F.lit(0).alias("role"), "id", "k", "l", "data", none.alias("scores"), none.alias("floors"))
    asking = rows.where("anchor").select(shard.alias("own"), "id", "k", "l", "data")

    def joined(scored: DataFrame, same: bool, own: bool, take: int) -> DataFrame:
        """``id, window, n, score`` found in the anchors' own shards, or in all others; ``scored`` has own, id, k, l, data, scores, floors."""
        where = F.array("own") if own else F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")), lambda s: s != F.col("own")) if shards > 1 else F.array().cast("array<bigint>")
        sent = scored.select(F.explode(where).alias("shard"), F.lit(1).alias("role"), "id", "k", "l", "data", "scores", "floors")
        met = held.unionByName(sent).repartition(parts, "shard").sortWithinPartitions("shard", "role", F.asc_nulls_last("k"), "id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, block, queue, keys, labels, data = None, None, [], [], [], []

            def answered() -> Iterator[pa.RecordBatch]:
                nonlocal block
                if not queue or not data and block is None:
                    queue.clear()
                    return
                width = max(len(r[3]) for r in queue)
                if block is None or block[0].whole.shape[1] < width:
                    source = data if block is None else list(block[0].whole)
                    block = (Shard(padded(source, max(width, max(len(x) for x in source)))), np.array(labels, object), np.array(keys, object))
                s, own_labels, own_keys = block
                a_keys, a_labels = np.array([r[1] for r in queue], object), np.array([r[2] for r in queue], object)

                def allowed(a: np.ndarray, r: np.ndarray) -> np.ndarray:
                    return ((a_labels[a] == own_labels[r]) == same) & (a_keys[a] != own_keys[r])

                top, floor = np.iinfo(np.int64).max, np.iinfo(np.int64).min
                if same:
                    windows = [(np.full(len(queue), floor), np.full(len(queue), top))]
                else:
                    windows = []
                    for w in range(positives):
                        p = [int(r[4][w]) if w < len(r[4]) else -1 for r in queue]
                        windows.append((np.array([-(-low * x // 100) if x >= 0 else 1 for x in p]), np.array([high * x // 100 if x >= 0 else 0 for x in p])))
                floors = np.array([[int(r[5][w]) if w < len(r[5]) and r[5][w] is not None else floor for r in queue] for w in range(len(windows))])
                found = search(s, padded([r[3] for r in queue], s.whole.shape[1]), allowed, windows, floors, take, own)
                for w, (a, r, score) in enumerate(found):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array([queue[i][0] for i in a], pa.string()), pa.array(np.full(len(a), w, np.int32)),
                                                          pa.array([own_keys[i] for i in r], batch.schema.field("k").type), pa.array(score)], ["id", "window", "n", "score"])
                queue.clear()

            for batch in batches:
                for sh, role, name, k, l, x, scores, floors in zip(*(c.to_pylist() for c in batch.columns)):
                    if sh != now:
                        yield from answered()
                        now, block, keys, labels, data = sh, None, [], [], []
                    x = np.frombuffer(x, "<i8")
                    if role == 0:
                        keys.append(k), labels.append(l), data.append(x)
                    else:
                        queue.append((name, k, l, x, scores, floors))
                        if len(queue) >= group_rows:
                            yield from answered()
            yield from answered()

        return met.mapInArrow(run, f"id string, window int, n {kind}, score long")

    order = [F.desc("score"), F.asc_nulls_last("n")]

    def ranked(found: DataFrame, take: int) -> DataFrame:
        place = Window.partitionBy("id", "window").orderBy(*order)
        return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= take)

    def floored(scored: DataFrame, near: DataFrame, windows: int, take: int) -> DataFrame:
        """Each window's worst score in the own shard, where that fills it."""
        worst = near.groupBy("id", "window").agg(F.when(F.count(F.lit(1)) >= take, F.min("score")).alias("floor"))
        worst = worst.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("found"))
        floors = F.array(*[F.try_element_at("found", F.lit(w)) for w in range(windows)])
        return scored.drop("floors").join(worst, "id", "left").withColumn("floors", F.coalesce(floors, none)).drop("found")

    def both(scored: DataFrame, same: bool, windows: int, take: int, name: str) -> DataFrame:
        near = written(joined(scored, same, True, take), name)
        far = joined(floored(scored, near, windows, take), same, False, take)
        return written(ranked(near.unionByName(far), take), name)

    found = both(asking.withColumn("scores", none).withColumn("floors", none), True, 1, positives, "positives")
    opened = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    found = found.select("id", (F.col("rank") - 1).alias("window"), F.col("n").alias("positive_id"), F.col("score").alias("positive_score"))
    less = both(asking.join(opened, "id").withColumn("floors", none), False, positives, negatives, "negatives")
    out = less.join(found, ["id", "window"]).join(asking.select("id", F.col("k").alias("anchor_id")), "id")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("n").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
