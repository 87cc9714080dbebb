"""Suffix-array dedup: removes byte strings of ``length`` bytes that occur more than once.

Which suffixes must be sorted together?  Equal strings of ``length`` bytes
have the same least ``GRAM``-byte gram (by hash, the left-most of equals) at
the same place.  So the starts of a document fall into runs that share such an
anchor, and a string can only be repeated if its anchor's gram occurs at
another anchor too.  Spark counts the grams of all anchors (once per block of
documents), and only runs whose gram is repeated go on: what is unique is
never sorted.  The text of each run is dealt out by its gram, equal texts of a
block once with their number, so that copies cost nothing.

Each task then sorts the suffixes of its texts, at most ``sort_bytes`` at a
time (more texts of one gram are divided by the bytes that equal strings must
share), by the difference-cover
algorithm: the positions 1 and 2 modulo 3 are the sample; their triples are
sorted and named; the names form a string that is sorted the same way; the
remaining suffixes are sorted by their first letter and the rank after it, and
merged.  The recursion ends when names cover ``length`` bytes.  Adjacent
suffixes are compared on their first ``length`` bytes; equal ones, counted
with their copies, mark their starts as repeated.  The marks go back to the
blocks, where all covered bytes are removed.

A gram in very many blocks (more than ``hot_blocks``) may have more different
texts than a task holds.  Its strings are dealt out one by one, by their own
content, and counted there; nothing else changes.

Defined results: null text is empty; strings do not cross documents; texts
shorter than ``length`` stay; matches are judged on the input; repeated rows
are repetitions; an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from .common import written
from .wire import groups, in_batches, packed, rows, unpacked
from .words import mix

LENGTH = 200
GRAM = 32
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 16
SEGMENT = 1 << 18
SORT_BYTES = 1 << 18
FRAGMENT_BITS = 8
FRAGMENT_BLOCKS = 4            # a fragment (of the gram hash) for that many blocks, but 2**FRAGMENT_BITS at least
HOT_BLOCKS = 2000
WIRE = "to long, block long, part int, a binary, b binary, c binary"
NAMES = ["to", "block", "part", "a", "b", "c"]
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
OWN = 1 << 40                  # "to" of rows that stay with their block


# --- difference-cover suffix sorting -----------------------------------------------------------------------------

def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for k in range(8):
        part = out[k::8]
        part[:] = np.frombuffer(padded[k:k + 8 * len(part)].tobytes(), ">u8")
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def _triple(a: np.ndarray, b: np.ndarray, c: np.ndarray, small: bool) -> np.ndarray:
    """Numbers in the order of the triples."""
    if small:
        return a.astype(np.uint64) << np.uint64(42) | b.astype(np.uint64) << np.uint64(21) | c.astype(np.uint64)
    return _pair(np.unique(_pair(a, b), return_inverse=True)[1], c)


def _named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Names 1, 2, ... of the keys in their order."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    names = np.empty(len(keys), np.int32)
    names[order] = np.cumsum(np.append(True, sorted_keys[1:] != sorted_keys[:-1]), dtype=np.int32)
    return names, int(names[order[-1]])


def suffix_ranks(letters: np.ndarray, cover: int, step: int, depth: int, wide: np.ndarray | None = None) -> np.ndarray:
    """Ranks of all suffixes of ``letters`` (numbers from 1 on), right at least to ``depth`` bytes.

    A letter stands for ``cover`` bytes and the next letter starts ``step``
    bytes later.  ``wide``, if given, holds finer keys for triples.  Suffixes
    that agree in ``depth`` bytes have neighbouring, perhaps equal ranks.
    """
    n = len(letters)
    if n < 3:
        return np.array([sorted(range(n), key=lambda i: tuple(letters[i:])).index(i) for i in range(n)], np.int64)
    s = np.concatenate([letters, np.zeros(3, letters.dtype)])
    small = n < 1 << 21 and int(letters.max()) < 1 << 21
    # Sample: positions 1 and 2 modulo 3; one more position ends the first part with an empty triple.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    if wide is not None:
        keys = np.append(wide, np.zeros(2, wide.dtype))[sample]
        reach = 8
    else:
        keys, reach = _triple(s[sample], s[sample + 1], s[sample + 2], small), cover + 2 * step
    names, last = _named(keys)
    del keys
    if last < len(sample) and reach < depth:
        names = suffix_ranks(names, reach, 3 * step, depth) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    rank[n:] = 0
    # The other suffixes by first letter and the rank after it, merged with either part of the sample.
    zero = np.arange(0, n, 3)
    one = one[one < n]
    zero_one, one_zero = _pair(s[zero], rank[zero + 1]), _pair(s[one], rank[one + 1])
    both = _triple(np.concatenate([s[zero], s[two]]), np.concatenate([s[zero + 1], s[two + 1]]), np.concatenate([rank[zero + 2], rank[two + 2]]), small)
    zero_two, two_zero = both[:len(zero)], both[len(zero):]
    # Searches run in the searched order: neighbouring searches end near by.
    by_zero, by_one, by_two = np.argsort(zero_one), np.argsort(rank[one]), np.argsort(rank[two])
    ranks = np.empty(n, np.int64)
    first = np.append(True, np.diff(zero_one[by_zero]) != 0) if len(zero) else np.zeros(0, bool)
    ranks[zero[by_zero]] = (np.maximum.accumulate(np.where(first, np.arange(len(zero)), 0))
                            + np.searchsorted(np.sort(one_zero), zero_one[by_zero]) + np.searchsorted(np.sort(two_zero), zero_two[by_zero]))
    count = np.bincount(rank[np.concatenate([one, two])])
    less = np.cumsum(count) - count
    ranks[one[by_one]] = less[rank[one[by_one]]] + np.searchsorted(zero_one[by_zero], one_zero[by_one])
    ranks[two[by_two]] = less[rank[two[by_two]]] + np.searchsorted(np.sort(zero_two), two_zero[by_two])
    return ranks


def repeated_starts(data: np.ndarray, starts: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of ``length`` bytes at ``starts`` occur more than once, each counted ``weight`` times."""
    if not len(starts):
        return np.zeros(0, bool)
    wide = eights(data)
    ranks = suffix_ranks(data.astype(np.int32) + 1, 1, 1, length, wide)
    order = np.argsort(ranks[starts], kind="stable")
    at = starts[order]
    tail = np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(8 * (-length % 8))
    same = np.ones(len(at) - 1, bool)
    wide = np.concatenate([wide, np.zeros(8, np.uint64)])
    for k in range(0, length, 8):
        differ = wide[at[1:] + k] ^ wide[at[:-1] + k]
        same &= (differ if k + 8 <= length else differ & tail) == 0
    first = np.flatnonzero(np.append(True, ~same))
    total = np.add.reduceat(weight[order], first)
    out = np.empty(len(starts), bool)
    out[order] = np.repeat(total > 1, np.diff(np.append(first, len(at))))
    return out


# --- anchors -----------------------------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on (wrong near the end, where no string reaches)."""
    e = np.concatenate([eights(data), np.zeros(GRAM, np.uint64)])
    n = len(data)
    h = e[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, m in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(29)
        h += e[k:n + k]
        h *= np.uint64(m)
    return mix(h)


def least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from block-wise running minima."""
    n = len(x) - width + 1
    full = -(-len(x) // width) * width
    table = np.concatenate([x, np.full(full - len(x), np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts that share an anchor: anchor position, first and last start, gram (48 bits).

    Equal strings have equal anchors; runs do not cross documents (given by ``sizes``).
    """
    ends = np.cumsum(sizes)
    begins = ends - sizes
    long = sizes >= length
    change = np.zeros(len(data) + 1, np.int8)
    np.add.at(change, begins[long], 1)
    np.add.at(change, ends[long] - length + 1, -1)
    valid = np.cumsum(change[:-1], dtype=np.int8).view(bool)     # 0 or 1: documents do not overlap
    opens = np.zeros(len(data) + 1, bool)
    opens[begins[long]] = True
    out = []
    low = np.uint64((1 << 21) - 1)
    for a in range(0, max(len(data) - length + 1, 0), SEGMENT):
        part = data[a:a + SEGMENT + length - 1]
        n = len(part) - length + 1
        if not valid[a:a + n].any():
            continue
        h = gram_hashes(part)
        keyed = (h & ~low) | np.arange(len(part), dtype=np.uint64)
        at = (least_in_window(keyed[:len(part) - GRAM + 1], length - GRAM + 1) & low).astype(np.int64)
        starts = np.flatnonzero(valid[a:a + n])
        new = np.append(True, (at[starts[1:]] != at[starts[:-1]]) | opens[a + starts[1:]] | (np.diff(starts) > 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        anchor = at[starts[first]]
        # mixed once more: the least of many hashes is small, so its upper bits would put half of all anchors into one fragment
        out.append((a + anchor, a + starts[first], a + starts[last], mix(h[anchor] ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _block(row: tuple) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.frombuffer(row[3], "<i8")
    return np.frombuffer(zstandard.decompress(row[4], max_output_size=int(sizes.sum()) + 1), np.uint8), sizes


def marked(packed_bits: bytes, size: int) -> np.ndarray:
    """Whether a repeated string starts at each byte of a block, from a bit for each."""
    bits = np.unpackbits(np.frombuffer(zstandard.decompress(packed_bits), "u1"), count=size)
    return bits.view(bool)


# --- the distributed job -----------------------------------------------------------------------------------------

def _blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of documents: their keys, sizes and bytes."""
    schema = StructType.fromDDL(WIRE).add("keys", ArrayType(df.schema[key].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        keys, texts, size = [], [], 0
        press, field = zstandard.ZstdCompressor(level=3), None

        def out() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], "<i8")
            return pa.RecordBatch.from_arrays([
                pa.array([OWN]), pa.array([(task << 24) + number]), pa.array([-1], pa.int32()), pa.array([sizes.tobytes()]),
                pa.array([press.compress(b"".join(texts))]), pa.array([None], pa.binary()), pa.array([keys], pa.list_(field))], [*NAMES, "keys"])

        for b in batches:
            field = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                data = (t.as_py() or "").encode("utf-8")
                keys.append(k)
                texts.append(data)
                size += len(data)
                if size >= BLOCK_BYTES or len(keys) >= BLOCK_ROWS:
                    yield out()
                    number, keys, texts, size = number + 1, [], [], 0
        if keys:
            yield out()

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def bits_for(n_blocks: int, least: int) -> int:
    """A task holds one fragment at a time: their number follows the input, so that what it holds does not."""
    return max(least, min((n_blocks // FRAGMENT_BLOCKS).bit_length(), 16))


def repeated(df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, fragment_bits: int = FRAGMENT_BITS,
             hot_blocks: int = HOT_BLOCKS, sort_bytes: int = SORT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Blocks of documents, and for each block the starts (in its bytes; see :func:`marked`) of strings that occur elsewhere too."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = written(_blocks(df, key, text), "blocks")
    fragment_bits = bits_for(blocks.count(), fragment_bits)
    low = np.uint64(48 - fragment_bits)
    bounds = np.arange(1, 1 << fragment_bits, dtype=np.uint64) << low

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[tuple]:
            for r in rows(batches):
                gram, count = np.unique(anchors(*_block(r), length)[3], return_counts=True)
                cut = np.searchsorted(gram, bounds)
                for f, (g, c) in enumerate(zip(np.split(gram, cut), np.split(count, cut))):
                    if len(g):
                        yield f, r[1], f, packed(g), np.minimum(c, 2).astype("u1").tobytes(), None
        yield from in_batches(sent(), NAMES, TYPES)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Back to each block: its grams that occur twice, and those in very many blocks."""
        def sent() -> Iterator[tuple]:
            for (f,), held in groups(rows(batches), 1):
                lists = [unpacked(r[3]) for r in held]
                gram, inverse, n_blocks = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
                count = np.bincount(inverse, np.frombuffer(b"".join(r[4] for r in held), "u1"))
                twice, hot = gram[count > 1], gram[n_blocks > hot_blocks]
                for r, g in zip(held, lists):
                    mine = g[np.isin(g, twice, assume_unique=True)]
                    if len(mine):
                        yield OWN, r[1], f, packed(mine), packed(mine[np.isin(mine, hot, assume_unique=True)]), None
        yield from in_batches(sent(), NAMES, TYPES)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of the runs whose gram is repeated, to the task of their gram; where they stand, to the block itself."""
        def sent() -> Iterator[tuple]:
            for (_, _), held in groups(((r[1], 0, r) for r in rows(batches)), 2):
                held = [h[2] for h in held]
                own, told = held[0], held[1:]
                if own[2] >= 0 or not told:
                    continue
                data, sizes = _block(own)
                at, first, last, gram = anchors(data, sizes, length)
                twice = np.concatenate([unpacked(r[3]) for r in told])
                hot = np.concatenate([unpacked(r[4]) for r in told])
                found = np.searchsorted(twice, gram)
                found[found == len(twice)] = 0
                use = np.flatnonzero(twice[found] == gram)
                raw = data.tobytes()
                yield from cut(own[1], raw, at[use], first[use], last[use], gram[use], np.isin(gram[use], hot))
        yield from in_batches(sent(), NAMES, TYPES)

    def cut(block: int, raw: bytes, at: np.ndarray, first: np.ndarray, last: np.ndarray, gram: np.ndarray, hot: np.ndarray) -> Iterator[tuple]:
        fragment = (gram >> low).astype(np.int64)
        order = np.argsort(fragment, kind="stable")
        lists: dict[tuple, dict[bytes, list[int]]] = {}
        anchors_of: dict[tuple, list[tuple[int, int]]] = {}      # of each new text: its gram and where it stands
        for f, o, a, z, g, h in zip(*(x[order].tolist() for x in (fragment, at, first, last, gram, hot))):
            if not h:
                mine = lists.setdefault((f, 0), {}).setdefault(raw[a:z + length], [])
                if not mine:
                    anchors_of.setdefault((f, 0), []).append((g, o - a))
                mine.append(a)
                continue
            for i in range(a, z + 1):
                name = hashlib.blake2b(raw[i:i + length], digest_size=16).digest()
                lists.setdefault((int.from_bytes(name[:4], "big") >> 32 - fragment_bits, 1), {}).setdefault(name, []).append(i)
        for (f, is_hot), found in lists.items():
            n = np.array([len(x) for x in found.values()], "<u4")
            sizes = np.array([len(x) for x in found], "<u4")
            # part: 2 * fragment for texts, one more for single strings; below zero for what the block keeps
            yield (f, block, 2 * f + is_hot, sizes.tobytes() + np.minimum(n, 2).astype("<u4").tobytes(), b"".join(found),
                   np.array(anchors_of.get((f, is_hot), ()), "<u8").tobytes())
            yield OWN + block, block, -2 - (2 * f + is_hot), n.tobytes(), np.array([x for v in found.values() for x in v], "<u4").tobytes(), sizes.tobytes()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Back to each block, in the order in which it sent them: the marks of its texts' starts."""
        def sent() -> Iterator[tuple]:
            for (to, part), held in groups(((r[0], r[2] if r[2] >= 0 else 0, r) for r in rows(batches)), 2):
                held = [h[2] for h in held]
                if to >= OWN:
                    yield from held
                    continue
                number: dict[bytes, int] = {}
                weight: list[int] = []
                anchor: list[tuple[int, int]] = []
                sent_by = []
                for r in held:
                    sizes, n = np.frombuffer(r[3], "<u4").reshape(2, -1).tolist()
                    mine, place = [], 0
                    grams = np.frombuffer(r[5], "<u8").reshape(-1, 2).tolist() if r[5] else [(0, 0)] * len(n)
                    for size, times, where in zip(sizes, n, grams):
                        i = number.setdefault(r[4][place:place + size], len(number))
                        place += size
                        if i == len(weight):
                            weight.append(0)
                            anchor.append(where)
                        weight[i] += times
                        mine.append(i)
                    sent_by.append(mine)
                marks = [bytes([w > 1]) for w in weight] if part % 2 else sorted_marks(list(number), weight, anchor)
                for r, mine in zip(held, sent_by):
                    yield OWN + r[1], r[1], part, None, None, b"".join([marks[i] for i in mine])
        yield from in_batches(sent(), NAMES, TYPES)

    def sorted_marks(found: list[bytes], weight: list[int], where: list[tuple[int, int]]) -> list[bytes]:
        """A byte per start of each text."""
        marks = [bytearray(len(x) - length + 1) for x in found]
        by_gram: dict[int, list[int]] = {}
        anchor = [o for _, o in where]
        for k, (gram, _) in enumerate(where):
            by_gram.setdefault(gram, []).append(k)
        batch: list[tuple[int, int, int]] = []
        size = 0

        def sort_batch(pieces: list[tuple[int, int, int]]) -> None:
            """Pieces: text, first and last start.  One suffix array over all of them."""
            texts = [found[k][a:z + length] for k, a, z in pieces]
            sizes = np.array([len(x) for x in texts])
            n = sizes - length + 1
            begins = np.cumsum(sizes) - sizes
            starts = np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
            copies = np.repeat(np.array([weight[k] for k, _, _ in pieces]), n)
            mark, at = repeated_starts(np.frombuffer(b"".join(texts), np.uint8), starts, copies, length).astype("u1").tobytes(), 0
            for (k, a, z), m in zip(pieces, n.tolist()):
                before = marks[k][a:z + 1]
                marks[k][a:z + 1] = bytes(map(max, before, mark[at:at + m])) if any(before) else mark[at:at + m]
                at += m

        def by_core(pieces: list[tuple[int, int, int]], low: int, high: int) -> Iterator[list[tuple[int, int, int]]]:
            """The parts of pieces whose starts lie ``low`` to ``high`` bytes before the anchor, by the bytes that all these strings share."""
            cores: dict[bytes, list[tuple[int, int, int]]] = {}
            for k, a, z in pieces:
                o = anchor[k]
                a, z = max(a, o - high), min(z, o - low)
                if a <= z:
                    cores.setdefault(found[k][o - low:o - high + length], []).append((k, a, z))
            return iter(cores.values())

        def settle(pieces: list[tuple[int, int, int]], low: int, high: int) -> None:
            """Pieces of one gram and core whose starts lie ``low`` to ``high`` bytes before the anchor.

            Equal strings have the same distance, so all that is common to a
            range of distances must be equal: too many pieces are divided by it.
            """
            nonlocal batch, size
            total = sum(z - a + length for _, a, z in pieces)
            if all(weight[k] > 1 for k, _, _ in pieces):             # copies of every text settle it
                for k, a, z in pieces:
                    marks[k][a:z + 1] = b"\1" * (z + 1 - a)
            elif len(pieces) == 1:                                   # alone with its core, a text is unique
                return
            elif total <= sort_bytes:
                if size + total > sort_bytes:
                    sort_batch(batch)
                    batch, size = [], 0
                batch += pieces
                size += total
            elif low == high:                                        # the core is the string itself
                for k, a, _ in pieces:
                    marks[k][a] = 1
            else:
                # Equal pieces are copies of each other: one of them goes on, for the others to meet.
                equal: dict[bytes, list[tuple[int, int, int]]] = {}
                for k, a, z in pieces:
                    equal.setdefault(found[k][a:z + length], []).append((k, a, z))
                for some in equal.values():
                    if len(some) > 1:
                        for k, a, z in some:
                            marks[k][a:z + 1] = b"\1" * (z + 1 - a)
                left = [some[0] for some in equal.values()]
                del equal
                if len(left) < len(pieces):
                    if len(left) > 1:
                        settle(left, low, high)
                else:
                    divide(left, low, high)

        def divide(pieces: list[tuple[int, int, int]], low: int, high: int) -> None:
            for c, d in ((low, (low + high) // 2), ((low + high) // 2 + 1, high)):
                for some in by_core(pieces, c, d):
                    settle(some, c, d)

        for some in by_gram.values():
            divide([(k, 0, len(found[k]) - length) for k in some], 0, length - GRAM)
        if batch:
            sort_batch(batch)
        return [bytes(m) for m in marks]

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Starts of repeated strings of each block, from the marks and from where its texts stand."""
        press = zstandard.ZstdCompressor(level=1)

        def sent() -> Iterator[tuple]:
            for (block,), held in groups(((r[1], r) for r in rows(batches)), 1):
                held = [h[1] for h in held]
                back = {r[2]: np.frombuffer(r[5], bool) for r in held if r[2] >= 0}
                starts = np.zeros(0, bool)
                for r in held:
                    if r[2] < 0:
                        part = -2 - r[2]
                        n, at, sizes = (np.frombuffer(r[k], "<u4").astype(np.int64) for k in (3, 4, 5))
                        width = np.ones(len(n), np.int64) if part % 2 else sizes - length + 1
                        # every occurrence of a text has the text's marks
                        text = np.repeat(np.arange(len(n)), n)
                        begin = np.cumsum(width) - width
                        w = width[text]
                        inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                        hit = back[part][np.repeat(begin[text], w) + inner]
                        found = (np.repeat(at, w) + inner)[hit]
                        if len(found) and found.max() >= len(starts):
                            starts = np.append(starts, np.zeros(max(int(found.max()) + 1, 2 * len(starts)) - len(starts), bool))
                        starts[found] = True
                if starts.any():
                    yield OWN, block, 0, press.compress(np.packbits(starts).tobytes()), None, None
        yield from in_batches(sent(), NAMES, TYPES)

    bare = blocks.drop("keys")
    told = bare.mapInArrow(grams, WIRE).repartition(parts, "to").sortWithinPartitions("to").mapInArrow(count_grams, WIRE)
    dealt = bare.unionByName(told).repartition(parts, "block").sortWithinPartitions("block", "part").mapInArrow(texts, WIRE)
    found = dealt.repartition(parts, "to").sortWithinPartitions("to", "part").mapInArrow(sort, WIRE)
    return blocks, found.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(marks, WIRE)


def dedup(df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, fragment_bits: int = FRAGMENT_BITS,
          hot_blocks: int = HOT_BLOCKS, sort_bytes: int = SORT_BYTES, keep_bytes: bool = True) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep_bytes``, ``kept binary`` of each row."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = StructType().add(key, df.schema[key].dataType)
    for name, kind in (("n_bytes", LongType()), ("n_removed", LongType()), ("n_spans", LongType()), ("kept_sha256", StringType()), ("kept", BinaryType())):
        schema = schema.add(name, kind) if name != "kept" or keep_bytes else schema
    blocks, marks = repeated(df, key=key, text=text, length=length, fragment_bits=fragment_bits, hot_blocks=hot_blocks, sort_bytes=sort_bytes)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one() -> Iterator[tuple]:
            for b in batches:
                field.append(b.schema.field(6).type.value_type)
                for i in range(len(b)):
                    yield b.column(1)[i].as_py(), tuple(c[i].as_py() for c in b.columns)

        field: list = []
        for _, held in groups(one(), 1):
            own = next(h[1] for h in held if h[1][2] < 0)
            data, sizes = _block(own)
            starts = np.zeros(len(data), bool)
            for h in held:
                if h[1][2] >= 0:
                    starts |= marked(h[1][3], len(data))
            so_far = np.cumsum(starts, dtype=np.int32)
            gone = so_far > 0
            gone[length:] = so_far[length:] > so_far[:-length]
            del so_far
            ends = np.cumsum(sizes)
            out = []
            for k, a, z in zip(own[6], (ends - sizes).tolist(), ends.tolist()):
                g = gone[a:z]
                kept = data[a:z][~g].tobytes()
                spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if z > a else 0
                out.append((k, z - a, int(np.count_nonzero(g)), spans, hashlib.sha256(kept).hexdigest(), *[kept] * keep_bytes))
            types = [field[0], pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * keep_bytes
            yield from in_batches(iter(out), [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes, types)

    nothing = F.lit(None).cast(blocks.schema["keys"].dataType)
    joined = blocks.unionByName(marks.withColumn("keys", nothing)).repartition(parts, "block").sortWithinPartitions("block", "part")
    return joined.mapInArrow(remove, schema)


def without_repeats(df: DataFrame, *, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with repeated byte strings cut out of ``text``; characters of which only a part is left are cut too.

    Null texts stay null; all other columns travel along, whatever their names.
    """
    rest = [c for c in df.columns if c != text]
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text}`").isNull().alias("none"))
    out = dedup(df.select(whole.alias("row"), F.col(f"`{text}`").cast("string").alias("text")), key="row", text="text", length=length)
    kept = F.when(~F.col("row.none"), whole_characters(F.col("kept")))
    return out.select(*[(kept if c == text else F.col(f"row.c{rest.index(c)}")).alias(c) for c in df.columns])


def whole_characters(data: Column) -> Column:
    """UTF-8 bytes as text, without bytes that are part of no whole character."""
    @F.pandas_udf("string")
    def decoded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else bytes(v).decode("utf-8", "ignore"))

    return decoded(data)
