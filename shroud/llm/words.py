"""Words and word shingles of whole texts as 64-bit hashes, a block of documents at a time.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z;
both are ASCII, so cutting UTF-8 bytes cuts the text itself.
"""

from __future__ import annotations

import hashlib

import numpy as np

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
IN_WORD = np.array([b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) for b in range(256)])
SEGMENT = 1 << 20
LONG_WORD = 1 << 16
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if not _powers:
        size = SEGMENT + LONG_WORD + 8
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit hash over all bits (one to one)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, starts and ends of their words, and each text's first word (with a last entry)."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]).translate(LOWER), np.uint8)
    inside = IN_WORD[data]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return data, starts, ends, np.searchsorted(starts, begins, "left")


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of ``data`` (spans ascend)."""
    power, inverse = _power_tables()
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    for i in np.flatnonzero(lengths > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(lengths <= LONG_WORD)
    first = 0
    while first < len(short):
        origin = starts[short[first]]
        last = np.searchsorted(starts[short], origin + SEGMENT, "left") if len(short) else 0
        part = short[first:last]
        s, e = starts[part] - origin, ends[part] - origin
        total = np.zeros(e[-1] + 1, np.uint64)
        np.cumsum((data[origin:origin + e[-1]].astype(np.uint64) + np.uint64(1)) * power[:e[-1]], out=total[1:])
        out[part] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        first = last
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's first word."""
    data, starts, ends, first = spans(texts)
    return hashed(data, starts, ends), first


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words has its whole sequence as one."""
    h, first = word_hashes(texts)
    n = len(h)
    rolled = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * np.uint64(BASE) + h[k:n - words + 1 + k] if len(rolled) else rolled
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            s = np.sort(rolled[a:b - words + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            total = b - a
            for x in h[a:b].tolist():
                total = (total * BASE + x) % (1 << 64)
            out.append(mix(np.array([total], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
