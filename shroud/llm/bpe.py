"""Byte-level BPE: backtracking encoder and offset-table decoder.

A vocabulary is read from a ``tokenizers`` JSON file (its path is a
parameter).  Text is cut by the file's byte-level word pattern; each distinct
word is encoded once per Python worker:

* one Aho-Corasick pass over the word gives every vocabulary entry that starts
  at each byte;
* the encoder takes the longest entry at the current byte whose pair with the
  entry before it is *compatible*, and steps back when none is.  Two entries
  are compatible when merging the bytes of both, by the ranks, gives back just
  these two; the answers are kept in a pair table.  A sequence whose
  neighbours are all compatible is the merge result itself, and each prefix of
  a word has one such sequence, so a byte offset that failed once is never
  tried again: the work is linear in the word.

Decoding gathers the bytes of all entries from one blob by an offset table.

Defined results: null text counts as empty (no ids, empty decoded text); a
text of any length is encoded whole; the strings of added tokens (such as
``<|endoftext|>``) in a text become their own id, as the library does by
default; repeated rows give repeated results; an empty table gives none.
Columns other than the two named ones are passed by.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the word pattern of byte-level BPE files, with Unicode white space spelt out.
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# The same for texts that are all ASCII, where the standard library's engine is faster.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Distinct words whose ids a worker keeps; the table is emptied when it is full (ids never depend on it).
CACHED_WORDS = 300_000
NEVER = (1 << 62, -1)


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte: printable Latin-1 stands for itself, the rest for U+0100 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """word -> (ids joined by commas, ids as little-endian uint32 bytes)."""

    def __init__(self, bpe: "Bpe"):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[str, bytes]:
        ids = self.bpe.encode_word(word.encode("utf-8"))
        value = self[word] = (",".join(map(str, ids)), struct.pack(f"<{len(ids)}I", *ids))
        return value


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.vocab = {bytes(alphabet[c] for c in k): v for k, v in spec["model"]["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(alphabet[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[self.vocab[a], self.vocab[b]] = (n, self.vocab[a + b])
        size = max([*self.vocab.values(), *self.added.values()]) + 1
        by_id = [b""] * size
        for k, v in self.vocab.items():
            by_id[v] = k
        for k, v in self.added.items():
            by_id[v] = k.encode("utf-8")
        self.by_id = by_id
        self.sizes = [len(x) for x in by_id]
        self.lengths = np.array(self.sizes, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.single = [self.vocab.get(bytes([x]), -1) for x in range(256)]
        self.automaton = ahocorasick.Automaton()
        for k, v in self.vocab.items():
            self.automaton.add_word(k.decode("latin-1"), v)
        self.automaton.make_automaton()
        self.whole: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.find, self.find_ascii = regex.compile(WORD_PATTERN).findall, re.compile(ASCII_PATTERN).findall

    def merged(self, data: bytes) -> list[int]:
        """Ids by the definition: join the neighbours of lowest rank, the left-most first, until none can be joined."""
        ids, rank = [self.single[x] for x in data], self.rank
        while True:
            best, at = NEVER, -1
            for i in range(len(ids) - 1):
                if (found := rank.get((ids[i], ids[i + 1]))) is not None and found < best:
                    best, at = found, i
            if at < 0:
                return ids
            ids[at:at + 2] = [best[1]]

    def is_whole(self, t: int) -> bool:
        """Whether the bytes of an entry merge to that entry."""
        if (known := self.whole.get(t)) is None:
            known = self.whole[t] = self.merged(self.by_id[t]) == [t]
        return known

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 4 * CACHED_WORDS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.by_id[a] + self.by_id[b]) == [a, b]
        return known

    def encode_word(self, data: bytes) -> list[int]:
        n, size, pairs = len(data), self.sizes, self.pairs
        at: list[list[int]] = [[] for _ in range(n)]
        for end, t in self.automaton.iter(data.decode("latin-1")):
            at[end + 1 - size[t]].append(t)                  # ends ascend, so the longest comes last
        dead = bytearray(n + 1)
        out: list[int] = []
        left: list[int] = []                                 # per chosen id: how many shorter ones remain there
        pos, last = 0, -1
        k = len(at[0]) - 1 if n else 0
        while pos < n:
            here = at[pos]
            while k >= 0:
                t = here[k]
                end = pos + size[t]
                if not dead[end]:
                    if last < 0:
                        fits = self.is_whole(t)
                    elif (fits := pairs.get((last, t))) is None:
                        fits = self.compatible(last, t)      # implies that t is whole
                    if fits:
                        break
                k -= 1
            if k >= 0:
                out.append(t)
                left.append(k)
                pos, last = end, t
                k = len(at[pos]) - 1 if pos < n else 0
            else:
                dead[pos] = 1
                pos -= size[out.pop()]
                last = out[-1] if out else -1
                k = left.pop() - 1
        return out

    def pieces(self, text: str) -> list[str]:
        return self.find_ascii(text) if text.isascii() else self.find(text)

    def encode(self, text: str) -> tuple[str, bytes]:
        """Ids of a text, once as decimals joined by commas and once as little-endian uint32 bytes."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if self.split_added is not None and any(x in text for x in self.added):
            strs, raws, last = [], [], 0
            for m in self.split_added.finditer(text):
                parts = [*map(self.words.__getitem__, self.pieces(text[last:m.start()]))]
                i = self.added[m.group()]
                strs += [p[0] for p in parts] + [str(i)]
                raws += [p[1] for p in parts] + [np.array([i], "<u4").tobytes()]
                last = m.end()
            parts = [*map(self.words.__getitem__, self.pieces(text[last:]))]
            return ",".join(strs + [p[0] for p in parts]), b"".join(raws + [p[1] for p in parts])
        if not text:
            return "", b""
        parts = [*map(self.words.__getitem__, self.pieces(text))]
        return ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text)[1], "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        index = np.repeat(self.offsets[ids] - ends + lengths, lengths)
        index += np.arange(ends[-1])
        return self.blob[index].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary of a file, read once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]




def encode(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and decode each row's whole text.

    Returns ``key, n_tokens, ids_sha256, decoded_sha256`` and, with
    ``keep_ids``, ``ids array<int>``.  The decoded text is what the ids stand
    for, not a copy of the input.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, sha, back, kept = [], [], [], []
            for v in b.column(1):
                joined, raw = bpe.encode(v.as_py() or "")
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                sha.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, [key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
