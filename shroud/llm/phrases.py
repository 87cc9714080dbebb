"""Phrase collocation mining by dynamic itemset counting.

The corpus is cut into blocks of one language (a block's distinct words and its
text as numbers of these), which are dealt over shards.  Scans go through the shards in a cycle.
In a scan all words and all *active* phrases of the shard are counted: a phrase of n words
becomes active in the scan after both its phrases of n - 1 words have reached the
threshold, with whatever was counted until then, and stays so for one full cycle, so
that it is counted in every shard exactly once.  Lengths are thus counted side by side; scans end
when the last cycle is complete.

What has reached the threshold goes to the tasks as filters of a fixed size
(``filter_bits``): per length, a table that holds at two places given by a phrase's hash the number
of the scan in which it got there.  A phrase that only seems to have got there makes its
extensions be counted too, over a full cycle as any other; so counts are exact whatever the
filters' size, and only the work saved depends on it.  Counts of a hash range meet in one group; the
number of ranges follows the number of words.  Groups whose cycle is complete keep what reached the threshold.

A last pass names the frequent phrases and their parts; scores, the removal of phrases
inside longer ones and the ranking are joins and windows over these.  Words and phrases are
compared as 64-bit hashes; scores are exact (decimals).

Words are runs of bytes other than space and tab within pieces; pieces end at
``.,;:!?`` and at the bytes 0A-0D; only A-Z are lower-cased.  A text longer than a block goes on in the
next block, with its last three words ahead if no piece ends there.

Defined results: a null language is ``und``; null and empty texts have no words; repeated rows
count as often as they stand; ties rank by the phrase in UTF-8 byte order; an empty table, or
one without frequent phrases, gives no rows; other columns are passed by, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written
from .wire import groups, rows
from .words import BASE, LOWER, hashed, mix

SHARDS = 2
FILTER_BITS = 22
NAME_BITS = 23
NAMINGS = 8
BLOCK_BYTES = 2 << 20
HELD_KEYS = 1 << 20
RANGE_WORDS = 2_000_000
LONGEST = 4
WHITE = b" \t"
ENDS = b".,;:!?\n\x0b\x0c\r"
IS_END = np.zeros(256, bool)
IS_END[list(ENDS)] = True
OUTSIDE = IS_END.copy()
OUTSIDE[list(WHITE)] = True


def thin(x: np.ndarray) -> bytes:
    """Whole numbers with as many bytes each as the largest one takes."""
    width = max((int(x.max()).bit_length() + 7) // 8, 1) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def wide(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as thin differences."""
    return thin(np.diff(keys, prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(wide(data), dtype=np.uint64)


def few(counts: np.ndarray) -> bytes:
    """Counts, mostly small: a byte each, and the places and values of those that do not fit."""
    large = np.flatnonzero(counts > 254)
    body = np.minimum(counts, 255).astype(np.uint8)
    return len(large).to_bytes(8, "little") + large.astype("<u8").tobytes() + counts[large].astype("<u8").tobytes() + body.tobytes()


def counts_of(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    large, values = np.frombuffer(data, "<u8", n, 8), np.frombuffer(data, "<u8", n, 8 + 8 * n)
    out = np.frombuffer(data, np.uint8, offset=8 + 16 * n).astype(np.int64)
    out[large.astype(np.int64)] = values.astype(np.int64)
    return out


def segments(data: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about ``size`` bytes, and how many words at the start of a part stand in the one before too."""
    a = lead = cut = 0
    while len(data) - max(a, cut) > size:
        half, end = max(a + size // 2, cut + 1), max(a, cut) + size
        cut = max(data.rfind(bytes([c]), half, end) for c in ENDS)
        if cut < 0:
            cut = max(data.rfind(bytes([c]), half, end) for c in WHITE)
            if cut < 0:                                      # a word without end: up to what ends it
                after = [i for i in (data.find(bytes([c]), end) for c in ENDS + WHITE) if i >= 0]
                if not after:
                    break
                cut = min(after)
        yield data[a:cut], lead
        if data[cut] in ENDS:
            a, lead = cut, 0
            continue
        begin, lead, at = cut, 0, cut
        while lead < LONGEST - 1:                            # the last words of the piece, as context
            while at > a and data[at - 1] in WHITE:
                at -= 1
            stop = max(data.rfind(bytes([c]), a, at) for c in ENDS + WHITE) + 1 or a
            if stop >= at:
                break
            begin, at, lead = stop, stop, lead + 1
        a = begin
    yield data[a:], lead


def block(data: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray, int]:
    """Hashes of the distinct words, these words, the text as numbers from 1 on (0 where a piece ends), and the number of words."""
    text = np.frombuffer(b"\n" + data.translate(LOWER) + b"\n", np.uint8)
    outside = OUTSIDE[text]
    starts = np.flatnonzero(outside[:-1] & ~outside[1:]) + 1
    ends = np.flatnonzero(~outside[:-1] & outside[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), [], np.zeros(0, np.uint32), 0
    kinds, first, number = np.unique(hashed(text, starts, ends), return_index=True, return_inverse=True)
    passed = np.cumsum(IS_END[text])
    broken = np.append(False, passed[starts[1:]] != passed[ends[:-1] - 1])
    out = np.zeros(len(starts) + int(broken.sum()), np.uint32)
    out[np.arange(len(starts)) + np.cumsum(broken)] = number + 1
    return kinds, [text[starts[i]:ends[i]].tobytes() for i in first], out, len(starts)


def blocks(df: DataFrame, key_lang: str, text: str, shards: int, block_bytes: int) -> DataFrame:
    """``lang, shard, lead, n, kinds, words, numbers``: the corpus."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = (TaskContext.get().partitionId() if TaskContext.get() else 0) % shards
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        total = 0

        def made(lang: str, data: bytes, lead: int) -> Iterator[pa.RecordBatch]:
            nonlocal turn
            kinds, words, numbers, n = block(data)
            if n > lead:
                turn = (turn + 1) % shards
                small = numbers.astype("<u2") if len(kinds) < 1 << 16 else numbers.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.string()), pa.array([turn], pa.int32()), pa.array([lead], pa.int32()), pa.array([n - lead]), pa.array([packed(kinds)], pa.binary()),
                     pa.array([b" ".join(words)], pa.binary()), pa.array([bytes([small.dtype.itemsize]) + small.tobytes()], pa.binary())],
                    ["lang", "shard", "lead", "n", "kinds", "words", "numbers"])

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
                if not t.is_valid:
                    continue
                data = t.as_buffer().to_pybytes()
                if len(data) > block_bytes:
                    for part, lead in segments(data, block_bytes):
                        yield from made(lang, part, lead)
                    continue
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data) + 1
                total += len(data) + 1
                if sizes[lang] >= block_bytes:
                    total -= sizes.pop(lang)
                    yield from made(lang, b"\n".join(held.pop(lang)), 0)
                elif total >= 4 * block_bytes:               # many languages: the largest block goes
                    lang = max(sizes, key=sizes.get)
                    total -= sizes.pop(lang)
                    yield from made(lang, b"\n".join(held.pop(lang)), 0)
        for lang, parts in held.items():
            yield from made(lang, b"\n".join(parts), 0)

    lang = F.coalesce(F.col(key_lang).cast("string"), F.lit("und")).alias("lang")
    return df.select(lang, F.col(text).alias("text")).mapInArrow(cut, "lang string, shard int, lead int, n long, kinds binary, words binary, numbers binary")


def places(keys: np.ndarray, lang: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A key's two places in a filter."""
    x = mix(keys ^ np.uint64(zlib.crc32(lang.encode()) * 0x9E3779B1))
    return (x >> np.uint64(64 - bits)).astype(np.int64), (x & np.uint64((1 << bits) - 1)).astype(np.int64)


def levels(kinds: np.ndarray, numbers: np.ndarray, lead: int, lang: str, filters: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1, 2, ...: n, where phrases of n words stand whose parts have reached the threshold, their keys, and the scan in which the last part had.

    Phrases that lie wholly in the first ``lead`` words belong to the block before.
    """
    def got_there(keys: np.ndarray, n: int) -> np.ndarray:
        a, b = places(keys, lang, bits)
        a, b = filters[n - 1, a], filters[n - 1, b]
        return np.where((a > 0) & (b > 0), np.maximum(a, b), 0).astype(np.uint8)

    at = np.flatnonzero(numbers)
    words = kinds[numbers[at] - 1]
    keys = words
    yield 1, at, keys, np.zeros(len(at), np.uint8)
    reached = got_there(kinds, 1)[numbers[at] - 1]
    last = reached
    for n in range(2, LONGEST + 1):
        # a phrase and the one a word on, both having got there
        ok = np.flatnonzero(reached[:-1].astype(bool) & reached[1:].astype(bool) & (np.diff(at) == 1))
        since = np.maximum(last[ok], last[ok + 1])
        if n == 2:
            keys, word = keys[ok], words[ok + 1]
        else:
            keys, word = keys[ok], word[ok + 1]
        at = at[ok]
        keys = mix(keys * np.uint64(BASE) + word + np.uint64(n))
        yield n, at, keys, since
        reached = got_there(keys, n)
        last = np.maximum(since, reached)


def scanned(corpus: DataFrame, scan: int, filters, bits: int, shards: int, ranges: int) -> DataFrame:
    """``lang, part, n, since, keys, counts``: words and active phrases of one shard, a row per block, length and range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = filters.value, {}, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            """What the task has counted so far, a row per language, length and range."""
            out = []
            for (lang, n), parts in held.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([c for _, c in parts]).astype(float), len(keys)).astype(np.int64)
                part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
                for a, z in zip(cuts, [*cuts[1:], len(keys)]):
                    out.append((lang, int(part[a]), n, scan, packed(keys[a:z]), few(counts[a:z])))
            held.clear()
            for a in range(0, len(out), 64):
                yield sent(out[a:a + 64], COUNTS)

        for lang, lead, kinds, numbers in rows(batches):
            kinds, numbers = unpacked(kinds), np.frombuffer(numbers, f"<u{numbers[0]}", offset=1)
            for n, at, keys, since in levels(kinds, numbers, lead, lang, table, bits):
                mine = at + n > lead
                mine &= scan <= shards if n == 1 else scan - since.astype(np.int64) - 1 < shards
                if not mine.any():
                    continue
                if n == 1:
                    counts = np.bincount(numbers[at[mine]], minlength=len(kinds) + 1)[1:]
                    keys, counts = kinds[counts > 0], counts[counts > 0]
                else:
                    keys, counts = np.unique(keys[mine], return_counts=True)
                held.setdefault((lang, n), []).append((keys, counts.astype(np.uint32)))
                size += len(keys)
            if size > HELD_KEYS:
                yield from flushed()
                size = 0
        yield from flushed()

    return corpus.where(F.col("shard") == (scan - 1) % shards).select("lang", "lead", "kinds", "numbers").mapInArrow(count, schema(COUNTS))


COUNTS = [("lang", "string"), ("part", "int"), ("n", "int"), ("since", "int"), ("keys", "binary"), ("counts", "binary")]
KIND = [("kind", "int")]
TYPES = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}


def schema(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{a} {b}" for a, b in columns)


def sent(out: list[tuple], columns: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(zip(*out), columns)], [name for name, _ in columns])


STATE, DONE, REACHED = 0, 1, 2


def merged(counts: DataFrame, scan: int, shards: int, least: int, bits: int) -> DataFrame:
    """What was held of earlier scans and the counts of this one: what goes on, what is done (and frequent), and the filter places newly reached."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, part, n), held in groups(rows(batches), 3):
            out = []
            new = [(unpacked(r[4]), counts_of(r[5])) for r in held if r[3] == scan]
            keys, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if new:
                keys, inverse = np.unique(np.concatenate([k for k, _ in new]), return_inverse=True)
                total = np.bincount(inverse, np.concatenate([c for _, c in new]).astype(float), len(keys)).astype(np.int64)
            fresh = np.ones(len(keys), bool)
            lots = [(r[3], unpacked(r[4]), counts_of(r[5])) for r in held if r[3] != scan]
            for since, k, c in [*lots, (scan, None, None)]:
                if k is None:
                    k, before, c = keys[fresh], np.zeros(int(fresh.sum()), np.int64), total[fresh]
                else:
                    at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
                    same = keys[at] == k if len(keys) else np.zeros(len(k), bool)
                    before, c = c, c.copy()
                    c[same] += total[at[same]]
                    fresh[at[same]] = False
                if not len(k):
                    continue
                got = k[(before < least) & (c >= least)]
                if len(got):
                    slots = np.unique(np.concatenate(places(got, lang, bits)))
                    out.append((lang, part, n, since, thin(slots.astype(np.uint64)), b"", REACHED))
                if scan >= (shards if n == 1 else since + shards - 1):
                    if (c >= least).any():
                        out.append((lang, part, n, since, packed(k[c >= least]), few(c[c >= least]), DONE))
                else:
                    out.append((lang, part, n, since, packed(k), few(c), STATE))
            if out:
                yield sent(out, COUNTS + KIND)

    dealt = counts.repartition("lang", "part").sortWithinPartitions("lang", "part", "n", "since")
    return dealt.mapInArrow(merge, schema(COUNTS + KIND))


def counted(corpus: DataFrame, *, least: int, shards: int, bits: int, ranges: int) -> tuple[DataFrame, np.ndarray]:
    """``lang, n, key, f`` of all words and phrases that occur at least ``least`` times, and the filters."""
    spark = corpus.sparkSession
    filters = np.zeros((LONGEST, 1 << bits), np.uint8)
    out, state, scan, last = [], None, 0, 0
    while scan < max(shards, last + shards):
        scan += 1
        shared = spark.sparkContext.broadcast(filters)       # of a fixed size
        counts = scanned(corpus, scan, shared, bits, shards, ranges)
        path = scratch(spark, "phrases")
        merged(counts if state is None else counts.unionByName(state), scan, shards, least, bits).write.partitionBy("kind").parquet(path)
        shared.destroy()
        read = spark.read.schema(schema(COUNTS + KIND)).parquet(path)
        out.append(path)
        state = read.where(F.col("kind") == STATE).drop("kind")

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for n, data in rows(batches):
                s = wide(data)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), n, np.int32)), pa.array(s.astype(np.int32))], ["n", "slot"])

        found = read.where(F.col("kind") == REACHED).select("n", "keys").mapInArrow(slots, "n int, slot int").distinct().toArrow()  # bounded by the filters' size
        n, slot = found.column("n").to_numpy(), found.column("slot").to_numpy()
        new = filters[n - 1, slot] == 0
        filters[n[new] - 1, slot[new]] = scan
        if (n[new] < LONGEST).any():
            last = scan

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, n, keys, counts in rows(batches):
            k, c = unpacked(keys), counts_of(counts)
            k, c = k[c >= least], c[c >= least]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(np.full(len(k), n, np.int32)), pa.array(k.view(np.int64)), pa.array(c)], ["lang", "n", "key", "f"])

    tables = [spark.read.schema(schema(COUNTS + KIND)).parquet(p).where(F.col("kind") == DONE).select("lang", "n", "keys", "counts") for p in out]
    # by the last scan every cycle is complete; what was first seen late in its cycle is still held
    tables.append(state.select("lang", "n", "keys", "counts"))
    return functools.reduce(DataFrame.unionByName, tables).mapInArrow(listed, "lang string, n int, key long, f long"), filters


def classes(found: DataFrame, bits: int) -> np.ndarray:
    """A filter of the phrases in ``found``: at both places of each the class of its count (the number of its binary digits)."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, key, size = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy().view(np.uint64), np.frexp(b.column(2).to_numpy().astype(float))[1].astype(np.int32)
            for name in np.unique(lang):
                own = lang == name
                two = np.concatenate(places(key[own], name, bits))
                yield pa.RecordBatch.from_arrays([pa.array(two.astype(np.int32)), pa.array(np.tile(size[own], 2))], ["slot", "size"])

    got = found.select("lang", "key", "f").mapInArrow(slots, "slot int, size int").groupBy("slot").agg(F.max("size").alias("size")).toArrow()   # bounded by the filter's size
    out = np.zeros(1 << bits, np.uint8)
    out[got.column("slot").to_numpy()] = got.column("size").to_numpy()
    return out


def named(corpus: DataFrame, filters: np.ndarray, bits: int, asked: np.ndarray, blocks_: int) -> DataFrame:
    """``lang, n, key, words, lefts, rights, inner``: phrases that may be among those asked for, with their words' hashes, the keys of
    both parts of each cut, and the keys of the shorter phrases in it.

    A phrase that stands in many blocks is named by some of them, by a hash of phrase and block: about ``NAMINGS`` of as
    many as its count allows, so that the rows grow with the phrases and not with phrases times blocks."""
    shared = corpus.sparkSession.sparkContext.broadcast((filters, asked))
    name_bits = len(asked).bit_length() - 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted = shared.value
        for lang, lead, kinds, numbers in rows(batches):
            seed = np.uint64(zlib.crc32(numbers[:4096]) * 0x9E3779B1 ^ len(numbers))
            kinds, numbers = unpacked(kinds), np.frombuffer(numbers, f"<u{numbers[0]}", offset=1)
            key_at: list[np.ndarray] = []
            for n, at, keys, _ in levels(kinds, numbers, lead, lang, table, bits):
                key_at.append(np.zeros(len(numbers) + LONGEST, np.uint64))
                key_at[-1][at] = keys
                if n == 1:
                    continue
                a, b = places(keys, lang, name_bits)
                size = np.minimum(wanted[a], wanted[b])
                some = np.flatnonzero(size)
                k, first = np.unique(keys[some], return_index=True)
                at = at[some][first]
                most = np.minimum(np.exp2(size[some][first].astype(float)), blocks_)
                mine = (most <= 1) | ((mix(k ^ seed) >> np.uint64(11)).astype(float) / (1 << 53) < NAMINGS / most)
                k, at = k[mine], at[mine]
                if not len(k):
                    continue
                signed = [x.view(np.int64) for x in key_at]

                def listed(parts: list[np.ndarray]) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * len(parts)), pa.array(np.stack(parts, 1).ravel() if parts else np.zeros(0, np.int64)))

                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k), pa.string()), pa.array(np.full(len(k), n, np.int32)), pa.array(k.view(np.int64)), listed([signed[0][at + i] for i in range(n)]),
                     listed([signed[c - 1][at] for c in range(1, n)]), listed([signed[n - c - 1][at + c] for c in range(1, n)]),
                     listed([signed[m - 1][at + i] for m in range(2, n) for i in range(n - m + 1)])],
                    ["lang", "n", "key", "words", "lefts", "rights", "inner"])

    found = corpus.select("lang", "lead", "kinds", "numbers").mapInArrow(
        find, "lang string, n int, key long, words array<long>, lefts array<long>, rights array<long>, inner array<long>")
    return found.groupBy("lang", "n", "key").agg(*[F.first(c).alias(c) for c in ("words", "lefts", "rights", "inner")])


def mine(df: DataFrame, *, lang: str = "lang", text: str = "text", least: int = 30, share: int = 80, top: int | None = 2000, shards: int = SHARDS,
         filter_bits: int = FILTER_BITS, block_bytes: int = BLOCK_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the phrases of 2 to 4 words that occur at least ``least`` times; the first ``top`` of each language (None: all).

    A phrase goes if a longer one around it has at least ``share`` percent of its occurrences.
    """
    corpus = written(blocks(df, lang, text, shards, block_bytes), "corpus")
    total = corpus.groupBy("lang").agg(F.sum("n").alias("n")).withColumnRenamed("n", "total")
    words = corpus.agg(F.sum("n")).first()[0] or 0
    found, filters = counted(corpus, least=least, shards=shards, bits=filter_bits, ranges=max(1, min(1 << 31, words // range_words)))
    found = written(found, "counts")
    frequent = found.where("n > 1").withColumnRenamed("f", "a")
    n_blocks = corpus.count()
    some = named(corpus, filters, filter_bits, classes(found.where("n > 1"), NAME_BITS), n_blocks)
    some = written(frequent.join(some, ["lang", "n", "key"]), "named")
    left = written(frequent.join(some.select("lang", "n", "key"), ["lang", "n", "key"], "left_anti"), "unnamed")    # whatever no block has named
    rest = named(corpus, filters, filter_bits, classes(left.select("lang", "key", F.lit(1).cast("long").alias("f")), NAME_BITS), 1)
    phrases = written(some.unionByName(left.join(rest, ["lang", "n", "key"]).select(*some.columns)), "phrases")

    # the cut with the lowest score
    cuts = phrases.select("lang", "n", "key", "a", F.posexplode(F.arrays_zip("lefts", "rights")).alias("k", "x")).select("lang", "n", "key", "a", "k", F.col("x.lefts").alias("left"), F.col("x.rights").alias("right"))
    count_of = found.select("lang", F.col("n").alias("m"), F.col("key").alias("part"), "f")
    cuts = cuts.join(count_of.select("lang", (F.col("m") - 1).alias("k"), F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "k", "left"])
    cuts = cuts.withColumn("m", F.col("n") - F.col("k") - 1).join(count_of.select("lang", "m", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "m", "right"])
    score = F.expr("CAST(CAST(a AS DECIMAL(19, 0)) * CAST(2000000 AS DECIMAL(7, 0)) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    cuts = cuts.groupBy("lang", "n", "key").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    # the most frequent longer phrase around each
    around = phrases.select("lang", F.explode("inner").alias("key"), F.col("a").alias("b")).groupBy("lang", "key").agg(F.max("b").alias("b"))
    kept = phrases.select("lang", "n", "key", "a", "words").join(around, ["lang", "key"], "left").where(F.col("b").isNull() | (100 * F.col("b").cast("decimal(19,0)") < share * F.col("a").cast("decimal(19,0)")))

    # hashes to words
    shared = df.sparkSession.sparkContext.broadcast(filters[0])

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words that may be frequent."""
        for own, kinds, spellings in rows(batches):
            k, w = unpacked(kinds), spellings.split(b" ")
            a, b = places(k, own, filter_bits)
            some = np.flatnonzero((shared.value[a] > 0) & (shared.value[b] > 0))
            for c in range(0, len(some), 1 << 16):
                at = some[c:c + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(k[at].view(np.int64)), pa.array([w[i].decode("utf-8", "replace") for i in at])], ["word", "spelling"])

    asked = kept.select("lang", "n", "key", F.posexplode("words").alias("i", "word"))
    spelling = corpus.select("lang", "kinds", "words").mapInArrow(spelt, "word long, spelling string").groupBy("word").agg(F.first("spelling").alias("spelling"))
    phrase = asked.join(spelling, "word").groupBy("lang", "n", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "spelling"))), lambda x: x["spelling"]), " ").alias("phrase"))
    out = kept.select("lang", "n", "key", "a").join(cuts, ["lang", "n", "key"]).join(phrase, ["lang", "n", "key"])
    out = out.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if top is not None:                                      # each task ranks its own rows first, and sends as many
        out = out.where(F.col("rank") <= top)
    return out.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
