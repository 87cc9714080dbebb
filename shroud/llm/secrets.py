"""Secret scans by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over the
trigrams that every match must hold: letters in a row give an AND of their
trigrams, alternatives an OR, anything else no condition.  Each block of
documents gets an inverted index (trigram -> documents) of the trigrams the
rules ask for, over lower-cased bytes; a rule's postings are intersected and
united, and only the documents left are searched with the expression.  A rule
without mandatory trigrams is searched in every document.  The index is cut by
documents, so nothing is shuffled and a hot trigram only makes more candidates.

Defined results: null text is empty and has no spans; whole texts are
searched; equal documents are scanned each; columns other than the two named
are passed by; an empty table gives no rows.  Offsets count code points, ends
are exclusive.
"""

from __future__ import annotations

import re
import re._parser as sre
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = ("all",)


@dataclass(frozen=True)
class Rule:
    """``group`` must be at least ``least`` characters long; ASCII letters match in either case with ``any_case``."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The three base kinds, then further well-known key formats.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20),
    Rule("hex", r"[0-9a-f]+", False, 0, 24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
SPANS = "array<struct<kind:string,start:int,end:int>>"


def _both(parts: list[tuple]) -> tuple:
    parts = [p for p in dict.fromkeys(parts) if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list[tuple]) -> tuple:
    return ALL if ALL in parts or not parts else parts[0] if len(set(parts)) == 1 else ("or", *dict.fromkeys(parts))


def trigram_query(pattern: str) -> tuple:
    """``ALL``, ``("has", trigram)``, ``("and", ...)`` or ``("or", ...)``; trigrams are lower-case bytes."""

    def letters(run: str) -> list[tuple]:
        data = run.encode("utf-8").lower()
        return [("has", data[i:i + 3]) for i in range(len(data) - 2)]

    def walk(items) -> tuple:
        parts, run = [], ""
        for op, arg in items:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            if op is sre.MAX_REPEAT and arg[0] == arg[1] and len(arg[2]) == 1 and arg[2][0][0] is sre.LITERAL:
                run += chr(arg[2][0][1]) * arg[0]
                continue
            parts += letters(run)
            run = ""
            if op is sre.SUBPATTERN:
                parts.append(walk(arg[3]))
            elif op is sre.BRANCH:
                parts.append(_any([walk(x) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                parts.append(walk(arg[2]))
        return _both(parts + letters(run))

    return walk(sre.parse(pattern))


def _trigrams(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "has" else set().union(*map(_trigrams, query[1:])) if query != ALL else set()


class Index:
    """Inverted index of a block of documents, for a fixed set of trigrams."""

    LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

    def __init__(self, trigrams: set[bytes]):
        self.trigrams = sorted(trigrams)
        self.number = np.zeros(1 << 24, np.uint16)
        for n, t in enumerate(self.trigrams, 1):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = n

    def build(self, texts: Sequence[bytes]) -> None:
        self.documents = np.arange(len(texts))
        ends = np.cumsum([len(t) + 2 for t in texts])
        data = np.frombuffer(b"\0\0".join([*texts, b""]).translate(self.LOWER), np.uint8).astype(np.uint32)
        found = self.number[data[:-2] << 16 | data[1:-1] << 8 | data[2:]] if len(data) > 2 else np.zeros(0, np.uint16)
        at = np.flatnonzero(found)
        kind, document = found[at], np.searchsorted(ends, at, "right")
        self.postings = {t: np.unique(document[kind == n]) for n, t in enumerate(self.trigrams, 1)}

    def find(self, query: tuple) -> np.ndarray:
        if query == ALL:
            return self.documents
        if query[0] == "has":
            return self.postings[query[1]]
        sets = [self.find(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(sets))
        sets.sort(key=len)
        for s in sets[1:]:
            sets[0] = np.intersect1d(sets[0], s, assume_unique=True)
        return sets[0]


def scan(df: DataFrame, rules: Sequence[Rule] = BASE + MORE, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans``, ordered by start and then by the order of the rules."""
    kind = df.schema[key].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(n, r, r.compiled(), trigram_query(r.pattern)) for n, r in enumerate(rules)]
        index = Index(set().union(*(_trigrams(q) for *_, q in known)))
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            index.build([t.encode("utf-8") for t in texts])
            found: list[list[tuple]] = [[] for _ in texts]
            for n, rule, pattern, query in known:
                for d in index.find(query):
                    found[d] += [(m.start(), n, m.end()) for m in pattern.finditer(texts[d]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            out = [[{"kind": rules[n].kind, "start": s, "end": e} for s, n, e in sorted(x)] for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, spans)], [key, "spans"])

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"`{key}` {kind}, spans {SPANS}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans that :func:`scan` found."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))

    def count(rule: Rule) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == rule.kind)).cast("long").alias(f"n_{rule.kind}")

    return spans.select(key, *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(df: DataFrame, rules: Sequence[Rule] = BASE + MORE, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span (overlapping ones together) replaced by ``mark``; null texts stay null, other columns as they are."""
    names, at = df.columns, df.columns.index(text)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        index = Index(set().union(*(_trigrams(q) for *_, q in known)))
        for b in batches:
            texts = b.column(at).to_pylist()
            index.build([(t or "").encode("utf-8") for t in texts])
            found: dict[int, list[tuple[int, int]]] = {}
            for rule, pattern, query in known:
                for d in index.find(query):
                    spans = [m.span() for m in pattern.finditer(texts[d] or "") if m.end(rule.group) - m.start(rule.group) >= rule.least]
                    if spans:
                        found.setdefault(int(d), []).extend(spans)
            for d, spans in found.items():
                out, last = [], 0
                for s, e in sorted(spans):
                    if s >= last:
                        out += [texts[d][last:s], mark]
                    last = max(last, e)
                texts[d] = "".join(out) + texts[d][last:]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, schema)
