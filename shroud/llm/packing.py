"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing: the longest piece first, each into the open sequence with
the least room that still holds it.  A segment tree over the remaining rooms
0..capacity finds that sequence in logarithmic time.

Lengths are whole numbers up to the capacity, so Spark counts the pieces per
length (at most ``capacity`` rows, whatever the input) and the driver packs
these counts: sequences with the same content are one run of numbers, and a
run of equal pieces is placed at once.  This gives exactly what placing piece
after piece gives, over the whole table, not per partition.  Each piece then
finds its place by its number among the pieces of its length; that numbering
is a window over hash buckets of each length plus the buckets' running counts,
so a length that a third of all pieces share is spread over many tasks.

Defined results: null text is an empty document (only its end token); a
document longer than the capacity is cut, the first piece taking the
remainder; equal documents are packed each; an empty table gives no rows.
:func:`pack` keeps all columns of its input; rows whose length is null, below
1 or above the capacity get null places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import written
from .tokens import token_ids


class RoomTree:
    """Segment tree over rooms 0..capacity: which of them have open sequences."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.leaves
        self.any[i] = is_open
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that is open."""
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Returns runs ``(length, first, each, sequence, offset)``: of the pieces of
    that length, those numbered from ``first`` on fill ``sequence``,
    ``sequence + 1``, ... with ``each`` pieces apiece, the first at ``offset``.
    """
    tree, rooms, runs, sequences = RoomTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if not rooms[room]:
                tree.set(room, True)
            rooms[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, done, each, first, capacity - room))
                put(room - each * length, first, full)
                done, left = done + full * each, left - full * each
            if full < n:
                if left:
                    runs.append((length, done, left, first + full, capacity - room))
                    put(room - left * length, first + full, 1)
                    full, done, left = full + 1, done + left, 0
                if full < n:
                    put(room, first + full, n - full)
    return runs


def pieces(df: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, *, key: str = "doc_id", text: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """Token pieces of each document: ``key, piece, start, length, ids_crc32`` and, with ``keep_ids``, ``ids array<int>``."""
    kind = df.schema[key].dataType.simpleString()
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(path)
        for b in batches:
            row, out, kept = [], [], []
            for r, v in enumerate(b.column(1)):
                ids = np.append(encode(v.as_py() or ""), np.uint32(end_id)).astype("<u4")
                start, stop, n = 0, (len(ids) - 1) % capacity + 1, 0
                while start < len(ids):
                    row.append(r)
                    out.append((n, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    if keep_ids:
                        kept.append(ids[start:stop].astype(np.int32))
                    start, stop, n = stop, stop + capacity, n + 1
            cols = [pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), (), ()), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *cols], [key, *names])

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def pack(df: DataFrame, capacity: int = 1024, *, length: str = "length", order: list[str], rows_per_bucket: int = 20_000) -> DataFrame:
    """Adds (or replaces) ``sequence_id`` and ``offset``.  ``order`` names columns that tell rows apart (they only deal out equal lengths)."""
    names = [c for c in df.columns if c not in ("sequence_id", "offset")]
    piece = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    size = F.col(f"`{length}`")
    rows = written(df.select(piece.alias("piece"), F.when(size.between(1, capacity), size.cast("long")).alias("size"),
                             F.xxhash64(*[F.col(f"`{c}`") for c in order]).alias("deal")), "pieces")
    counts = {int(r[0]): int(r[1]) for r in rows.where("size is not null").groupBy("size").count().collect()}
    runs = sorted(best_fit_runs(counts, capacity))
    first = np.array([(r[0] << 44) + r[1] for r in runs], np.int64)
    each, sequence, offset = (np.array([r[i] for r in runs], np.int64) for i in (2, 3, 4))

    buckets = max(1, sum(counts.values()) // rows_per_bucket)
    dealt = rows.withColumn("bucket", F.pmod("deal", F.lit(buckets)))
    before = dealt.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "size", "bucket", (F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).alias("before"))
    by = [F.col(f"piece.c{names.index(c)}") for c in order]
    numbered = dealt.withColumn("number", F.row_number().over(Window.partitionBy("size", "bucket").orderBy(*by)))
    numbered = numbered.join(before, ["size", "bucket"], "left").select("piece", "size", (F.col("number") - 1 + F.col("before")).alias("number"))
    schema = StructType().add("piece", rows.schema["piece"].dataType).add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())
            if len(first) and len(b):
                none = np.array(b.column(1).is_null())
                n, k = (np.asarray(x.fill_null(0), np.int64) for x in b.columns[1:])
                at = np.searchsorted(first, (n << 44) + k, "right") - 1
                at[none] = 0
                k = k - (first[at] & ((1 << 44) - 1))
                out = pa.array(sequence[at] + k // each[at], mask=none), pa.array(offset[at] + k % each[at] * n, mask=none)
            yield pa.RecordBatch.from_arrays([b.column(0), *out], ["piece", "sequence_id", "offset"])

    placed = numbered.mapInArrow(place, schema)
    return placed.select(*[F.col(f"piece.c{i}").alias(c) for i, c in enumerate(names)], "sequence_id", "offset")
