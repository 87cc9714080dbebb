"""N-gram Jaccard join by vertical partitioning.

A document is its set of distinct word n-grams (64-bit hashes, kept to 48
bits).  The global order of n-grams is cut into fragments; each fragment sees
its part of every document only, counts what it can, and the counts are summed.

1. *Shared n-grams.*  Documents are gathered into blocks of a few megabytes.
   Each block sends every fragment its distinct n-grams of that range, once
   however many of its documents hold them, so a very common n-gram costs an
   entry per block.  Fragments count documents per n-gram and return those
   that occur in two or more.  Summed over the fragments this gives how many
   of a document's n-grams any other document holds; a document in which that
   is under the threshold has no partner and is done.
2. *Candidates.*  Equal sets are one node.  In the order (frequency, hash) two
   sets can only reach the threshold if they meet in their prefixes (the first
   ``n - ceil(0.8 n) + 1`` n-grams).  Candidate pairs go from a set to one hub
   of a prefix n-gram, not from all to all; sets that have become one component
   need no further pair.  Sets that still share a prefix n-gram across
   components after the hub rounds are compared in full, block by block, so no
   link between components is lost.
3. *Overlaps.*  For each candidate pair (or pair of blocks) and fragment the
   overlaps are counted on the parts alone; the sums decide.

The result is the components over all links, not the links themselves.

Defined results: null, empty or blank text has no n-grams and links with
nothing; fewer words than ``words`` make one n-gram of them all; repeated rows
are rows of their own, in one component; null keys are never a component's
name (null if it has no other); an empty table gives no rows; other columns
are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components
from .near import forest
from .wire import groups, in_batches, packed, unpacked
from .wire import rows as _rows
from .words import shingle_sets

BLOCK_BYTES = 8 << 20
BLOCK_ROWS = (1 << 16) - 1
SHIFT = np.uint64(16)           # of 64 hash bits, 48 are kept
BITS = 48
FRAGMENTS = 4                   # of the comparison; the count of shared n-grams has its own
BLOCK_SETS = 512


def shared_ngrams(df: DataFrame, *, key: str, text: str, words: int, percent: int, fragment_bits: int, block_bytes: int) -> DataFrame:
    """Step 1: ``id, key, n, set, shared, frequency`` of every row.

    ``id`` numbers the rows; ``set`` is a digest of the n-gram set (null if
    empty); ``shared`` holds its n-grams that other rows hold too, and
    ``frequency`` in how many rows, where they are enough for a partner.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    arrow_kind = {"k": None}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    low = np.uint64(BITS - fragment_bits)
    mask = np.uint64((1 << (BITS - fragment_bits)) - 1)
    # to: fragment (below 2**fragment_bits) or, for what stays with the block, a number above.
    wire = f"to long, block long, part int, a binary, b binary, c binary, keys array<{kind}>"

    def block_rows(block: int, keys: list, sets: list[np.ndarray]) -> Iterator[dict]:
        n = np.array([len(s) for s in sets], "<u4")
        grams = np.concatenate([s >> SHIFT for s in sets]) if sets else np.zeros(0, np.uint64)
        place = np.repeat(np.arange(len(sets), dtype="<u2"), n)
        order = np.argsort(grams, kind="stable")
        grams, place = grams[order], place[order]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(grams)))
        digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
        several = np.repeat(count > 1, count)
        yield {"to": (1 << fragment_bits) + block, "block": block, "part": -1, "a": n.tobytes() + digests, "b": grams[several].astype("<u8").tobytes(), "c": place[several].tobytes(), "keys": keys}
        grams, place = grams[first], np.where(count > 1, 0, place[first]).astype("<u2")
        cut = np.searchsorted(grams, np.arange(1, 1 << fragment_bits, dtype=np.uint64) << low)
        for f, (g, p, c) in enumerate(zip(np.split(grams, cut), np.split(place, cut), np.split(count, cut))):
            if len(g):
                yield {"to": f, "block": block, "part": f, "a": packed(g & mask), "b": p.tobytes(), "c": c.astype("<u2").tobytes() if c.max() > 1 else b"", "keys": None}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, texts, size = 0, [], [], 0
        task = TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(block_rows((task << 20) + number, keys, shingle_sets(texts, words)))
            for i in range(0, len(rows), 64):
                some = rows[i:i + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in some], t) for c, t in zip(("to", "block", "part", "a", "b", "c", "keys"), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(arrow_kind["k"])))],
                    ["to", "block", "part", "a", "b", "c", "keys"])

        for b in batches:
            arrow_kind["k"] = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                data = (t.as_py() or "").encode("utf-8")
                keys.append(k)
                texts.append(data)
                size += len(data)
                if size >= block_bytes or len(keys) >= BLOCK_ROWS:
                    yield from flush()
                    number, keys, texts, size = number + 1, [], [], 0
        if keys:
            yield from flush()

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block and fragment: n-grams in two or more rows, their place in the block (if in one of its rows) and frequency."""
        def out(rows: list[tuple], keys) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))] + [keys],
                                              ["to", "block", "part", "a", "b", "c", "keys"])

        def split() -> Iterator[tuple]:
            for b in batches:
                fields["keys"] = b.schema.field(6).type
                for i in range(len(b)):
                    if b.column(2)[i].as_py() < 0:
                        ready.append(b.slice(i, 1))
                    else:
                        yield tuple(c[i].as_py() for c in b.columns[:6])

        ready: list[pa.RecordBatch] = []
        fields: dict = {}
        for (to,), held in groups(split(), 1):
            yield from ready
            ready.clear()
            base = np.uint64(to) << low
            lists = [unpacked(r[3]) for r in held]
            counts = [np.frombuffer(r[5], "<u2").astype(np.int64) if r[5] else np.ones(len(g), np.int64) for r, g in zip(held, lists)]
            grams, count = np.concatenate(lists), np.concatenate(counts)
            order = np.argsort(grams, kind="stable")
            first = np.append(True, grams[order][1:] != grams[order][:-1])
            total = np.add.reduceat(count[order], np.flatnonzero(first))
            frequency = np.empty(len(grams), np.int64)
            frequency[order] = total[np.cumsum(first) - 1]
            start, rows = 0, []
            for r, g, c in zip(held, lists, counts):
                f = frequency[start:start + len(g)]
                start += len(g)
                keep = f > 1
                if keep.any():
                    place = np.frombuffer(r[4], "<u2")[keep].astype("<u4")
                    place[c[keep] > 1] = 1 << 31
                    rows.append((r[1], r[1], to, (base + g[keep]).astype("<u8").tobytes(), place.astype("<u4").tobytes(), np.minimum(f[keep], (1 << 32) - 1).astype("<u4").tobytes()))
            if rows:
                yield out(rows, pa.nulls(len(rows), fields["keys"]))
        yield from ready

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict = {}

        def rows() -> Iterator[tuple]:
            for b in batches:
                kinds["k"] = b.schema.field(6).type.value_type
                for i in range(len(b)):
                    yield tuple(c[i].as_py() for c in b.columns[1:])

        for (block,), held in groups(rows(), 1):
            own = next(r for r in held if r[1] < 0)
            m = len(own[5])
            n = np.frombuffer(own[2], "<u4", m)
            digests = own[2][4 * m:]
            none = np.zeros(0, np.uint64)
            grams = np.concatenate([none, *(np.frombuffer(r[2], "<u8") for r in held if r[1] >= 0)])
            place = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r[3], "<u4") for r in held if r[1] >= 0)])
            frequency = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r[4], "<u4") for r in held if r[1] >= 0)])
            # n-grams that several rows of the block hold: their frequency is known by now, their places are the block's own
            inner, inner_place = np.frombuffer(own[3], "<u8"), np.frombuffer(own[4], "<u2").astype(np.uint32)
            several = place == 1 << 31
            table, value = grams[several], frequency[several]
            by = np.argsort(table)
            inner_frequency = value[by][np.searchsorted(table[by], inner)] if len(inner) else np.zeros(0, np.uint32)
            grams, place, frequency = (np.concatenate(x) for x in ((grams[~several], inner), (place[~several], inner_place), (frequency[~several], inner_frequency)))
            enough = np.bincount(place, minlength=m) * 100 >= percent * n.astype(np.int64)
            use = enough[place]
            grams, place, frequency = grams[use], place[use], frequency[use]
            order = np.lexsort((grams, frequency, place))
            grams, place, frequency = grams[order], place[order], frequency[order]
            cut = np.searchsorted(place, np.arange(m + 1))
            for a in range(0, m, 500):
                z = range(a, min(a + 500, m))
                yield pa.RecordBatch.from_arrays([
                    pa.array([(block << 16) + i for i in z], pa.int64()), pa.array([own[5][i] for i in z], kinds["k"]), pa.array(n[a:a + 500].astype(np.int64)),
                    pa.array([digests[16 * i:16 * i + 16] if n[i] else None for i in z], pa.binary()),
                    pa.array([grams[cut[i]:cut[i + 1]].astype("<u8").tobytes() if enough[i] and n[i] else None for i in z], pa.binary()),
                    pa.array([frequency[cut[i]:cut[i + 1]].astype("<u4").tobytes() if enough[i] and n[i] else None for i in z], pa.binary())],
                    ["id", key, "n", "set", "shared", "frequency"])

    return (df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(blocks, wire)
            .repartition(parts, "to").sortWithinPartitions("to").mapInArrow(fragments, wire)
            .repartition(parts, "block").sortWithinPartitions("block", "part").mapInArrow(documents, f"id long, `{key}` {kind}, n long, set binary, shared binary, frequency binary"))


def _cut(sets: DataFrame, fragments: int, *more: str) -> DataFrame:
    """``id, fragment, part`` and the columns ``more``: each set's n-grams by range of the hash."""
    schema = "id long, fragment int, part binary" + "".join(f", {c} long" for c in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = (np.arange(1, fragments, dtype=np.uint64) << np.uint64(BITS)) // np.uint64(fragments)
        for b in batches:
            rows, numbers, parts = [], [], []
            for i, data in enumerate(b.column(1)):
                g = np.sort(np.frombuffer(data.as_buffer(), "<u8"))
                for f, part in enumerate(np.split(g, np.searchsorted(g, bounds))):
                    if len(part):
                        rows.append(i)
                        numbers.append(f)
                        parts.append(packed(part))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(numbers, pa.int32()), pa.array(parts, pa.binary()), *(c.take(take) for c in b.columns[2:])],
                                             ["id", "fragment", "part", *more])

    return sets.select("id", "shared", *more).mapInArrow(run, schema)


def overlaps(pairs: DataFrame, sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """``a, b, overlap``: partial overlaps of each pair counted fragment by fragment and summed."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both, pa.int64())], ["a", "b", "overlap"])

    used = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    parts = _cut(sets.join(used, "id", "left_semi"), fragments)
    left = pairs.select("a", "b").join(parts.select(F.col("id").alias("a"), "fragment", F.col("part").alias("x")), "a")
    matched = left.join(parts.select(F.col("id").alias("b"), "fragment", F.col("part").alias("y")), ["b", "fragment"])
    return matched.select("a", "b", "x", "y").mapInArrow(count, "a long, b long, overlap long").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))


def _partial(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of the first list shares with each of the second."""
    grams, others = np.concatenate(first), np.concatenate(second)
    order = np.argsort(others, kind="stable")
    others, place = others[order], np.repeat(np.arange(len(second)), [len(x) for x in second])[order]
    rows = np.repeat(np.arange(len(first)), [len(x) for x in first])
    out = np.zeros(len(first) * len(second), np.int64)
    for i in range(0, len(grams), 1 << 14):
        g, r = grams[i:i + (1 << 14)], rows[i:i + (1 << 14)]
        a, z = np.searchsorted(others, g, "left"), np.searchsorted(others, g, "right")
        n = z - a
        at = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
        out += np.bincount(np.repeat(r, n) * len(second) + place[at], minlength=len(out))
    return out.reshape(len(first), len(second))


def open_links(postings: DataFrame, nodes: DataFrame, percent: int, fragments: int = FRAGMENTS, block: int = BLOCK_SETS) -> DataFrame:
    """All links between different components among sets that share a prefix n-gram, as a forest.

    ``postings``: ``gram, id, n, component``.  Sets that prefix n-grams connect
    form a neighbourhood.  Its sets stand in blocks, a large component in
    blocks of its own; two blocks meet unless both are of one component.  Each
    fragment counts the partial overlaps of two blocks in a table, the tables
    are summed: no row per pair arises, however large the neighbourhood.
    """
    parts = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    hub = postings.groupBy("gram").agg(F.min("id").alias("b"))
    near = components(postings.join(hub, "gram").where("id != b").select(F.col("id").alias("a"), "b").distinct()).toDF("id", "place")
    sets = written(postings.select("id", "component").distinct().join(near, "id"), "open")
    sizes = sets.groupBy("place", "component").agg(F.count(F.lit(1)).alias("k"))
    small = sizes.where(F.col("k") < block).groupBy("place").agg(F.ceil(F.sum("k") / block).alias("small"))
    blocks = F.when(F.col("k") >= block, F.concat_ws(":", F.lit("own"), "component", F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / block)))).otherwise(
        F.concat_ws(":", F.lit("shared"), F.pmod(F.xxhash64("component"), "small")))
    sets = written(sets.join(sizes, ["place", "component"]).join(small, "place", "left").select("id", "place", "component", blocks.alias("block"), (F.col("k") >= block).alias("own")), "blocks")
    every = sets.select("place", "block", F.when(F.col("own"), F.col("component")).alias("c")).distinct()
    x, y = every.select("place", F.col("block").alias("x"), F.col("c").alias("cx")), every.select("place", F.col("block").alias("y"), F.col("c").alias("cy"))
    shared = x.where("cx is null").join(y, "place").where("cy is not null or x <= y")
    large = every.where("c is not null").select("place", "c").distinct()
    large = large.withColumnRenamed("c", "cx").join(large.withColumnRenamed("c", "cy"), "place").where("cx < cy")
    large = large.join(x, ["place", "cx"]).join(y, ["place", "cy"])
    pairs = shared.select("place", "x", "y").unionByName(large.select("place", "x", "y")).withColumn("pair", F.concat_ws("|", "place", "x", "y"))
    sides = pairs.select("place", F.col("x").alias("block"), "pair", F.lit(0).alias("side")).unionByName(
        pairs.where("x != y").select("place", F.col("y").alias("block"), "pair", F.lit(1).alias("side")))
    cut = _cut(nodes.join(sets.select("id", F.col("component")), "id"), fragments, "n", "component")
    rows = sets.select("id", "place", "block").join(sides, ["place", "block"]).select("id", "pair", "side").join(cut, "id")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per pair of blocks and fragment: the sets of both sides (id, n, component) and the table of their overlaps."""
        def out() -> Iterator[tuple]:
            for (pair, _), held in groups(_rows(batches), 2):
                sides = [[r for r in held if r[2] == k] for k in (0, 1)]
                both = sides[0] and sides[1] or "|shared:" in pair and pair.split("|")[1] == pair.split("|")[2]
                if both:
                    first, second = sides[0], sides[1] or sides[0]
                    table = _partial([unpacked(r[4]) for r in first], [unpacked(r[4]) for r in second])
                    yield (pair, *(np.array([(r[3], r[5], r[6]) for r in z], "<i8").tobytes() for z in (first, second)), table.astype("<u4").tobytes())
        yield from in_batches(out(), ["pair", "x", "y", "counts"], [pa.string(), pa.binary(), pa.binary(), pa.binary()])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for _, held in groups(_rows(batches), 1):
                sides = [[np.frombuffer(r[k], "<i8").reshape(-1, 3) for r in held] for k in (1, 2)]
                names, places = zip(*(np.unique(np.concatenate(z), axis=0, return_inverse=True) for z in sides))
                total = np.zeros((len(names[0]), len(names[1])), np.int64)
                at = [0, 0]
                for r, a, b in zip(held, *sides):
                    i, j = (places[k].ravel()[at[k]:at[k] + len(z)] for k, z in ((0, a), (1, b)))
                    at = [at[0] + len(a), at[1] + len(b)]
                    total[np.ix_(i, j)] += np.frombuffer(r[3], "<u4").reshape(len(a), len(b))
                n = names[0][:, 1][:, None] + names[1][:, 1][None]
                linked = (100 * total >= percent * (n - total)) & (names[0][:, 2][:, None] != names[1][:, 2][None])
                node, root = forest(*np.nonzero(linked), *linked.shape)
                both = np.concatenate([names[0][:, 0], names[1][:, 0]])
                yield from ((int(a), int(b)) for a, b in zip(both[node], both[root]) if a != b)
        yield from in_batches(out(), ["a", "b"], [pa.int64(), pa.int64()])

    counted = (rows.select("pair", "fragment", "side", "id", "part", "n", "component").repartition(parts, "pair", "fragment")
               .sortWithinPartitions("pair", "fragment", "side").mapInArrow(tables, "pair string, x binary, y binary, counts binary"))
    return counted.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(summed, "a long, b long")


def join(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, fragment_bits: int = 8, hub_rounds: int = 1,
         block_bytes: int | None = None) -> DataFrame:
    """``key, n_shingles, component_id`` of each row: components under Jaccard similarity >= percent / 100.

    ``block_bytes``: text that a task holds at a time (``BLOCK_BYTES`` by default); smaller blocks need less memory and shuffle a little more.
    """
    bare = df.select(F.col(key).alias("k"), F.col(text).alias("t"))         # no name of the input meets one of ours
    rows = written(shared_ngrams(bare, key="k", text="t", words=words, percent=percent, fragment_bits=fragment_bits, block_bytes=block_bytes or BLOCK_BYTES), "ngrams")
    equal = rows.where("set is not null").groupBy("set").agg(F.min("id").alias("node"))
    nodes = written(rows.where("shared is not null").join(equal, "set").where("id = node").select("id", "n", "shared", "frequency"), "sets")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, grams = [], [], []
            for i, n, shared in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                g = np.frombuffer(shared.as_buffer(), "<i8")
                length = len(g) - (percent * n + 99) // 100 + 1        # the n-grams that no other row holds come first in the order
                ids.append(np.full(length, i))
                sizes.append(np.full(length, n))
                grams.append(g[:length])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams, ids, sizes)], ["gram", "id", "n"])

    postings = nodes.select("id", "n", "shared").mapInArrow(prefixes, "gram long, id long, n long")
    several = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("gram")
    postings = written(postings.join(several, "gram"), "postings")

    label = None
    for turn in range(hub_rounds + 1):
        if label is not None:
            postings = postings.drop("component").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
            open_grams = postings.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("gram")
            postings = written(postings.join(open_grams, "gram").select("gram", "id", "n", "component"), "postings")
        else:
            postings = postings.withColumn("component", F.col("id"))
        if turn == hub_rounds:
            if postings.count():
                found = written(open_links(postings, nodes, percent), "found")
                # components so far, as stars, and the links between them
                links = found if label is None else label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found)
                label = components(links)
            break
        # Each n-gram's hub is its first member in an order that changes with the round; a set takes one hub only.
        order = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id"), F.col("n").alias("m"), F.col("component").alias("k"))
        hubs = postings.groupBy("gram").agg(F.min(order).alias("hub")).select("gram", "hub.*").withColumnRenamed("id", "b")
        pairs = postings.join(hubs, "gram").where((F.col("component") != F.col("k")) & F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)"))
        pairs = pairs.groupBy("id").agg(F.min(F.struct("h", "b")).alias("x")).select(F.least("id", "x.b").alias("a"), F.greatest("id", "x.b").alias("b")).distinct()
        pairs = written(pairs, "pairs")
        size = nodes.select(F.col("id"), F.col("n"))
        total = overlaps(pairs, nodes).join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
        found = written(total.where(f"100 * overlap >= {percent} * (na + nb - overlap)").select("a", "b"), "found")
        links = found if label is None else label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found)
        label = written(components(links), "labels")
    label = label.toDF("node", "component") if label is not None else equal.select("node", F.col("node").alias("component")).limit(0)
    placed = rows.select("id", "k", "n", "set").join(equal, "set", "left").join(label, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node", "id"))
    names = placed.groupBy("component").agg(F.min("k").alias("component_id"))
    return placed.join(names, "component").select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id")
