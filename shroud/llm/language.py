"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from a generator that its
code point seeds, so every task draws the same one.  An n-gram's vector binds
its letters: the componentwise product of the letters' vectors, the one that
stands ``k`` places before the end rotated by ``k``.  A text's vector bundles (adds up)
the vectors of all its n-grams; a language's profile bundles its training texts, each
weighted by ``WEIGHT // length`` (at least 1), so that long texts do not outweigh the rest.
The language whose profile has the greatest cosine with the text's vector is the prediction.

Letters are characters of which ``str.isalpha`` holds, lower-cased; all else is
one space, also before the first and after the last word.  Bundles are whole numbers
in doubles, so sums do not depend on how rows are dealt.  Texts go through in
pieces of bounded size.  Profiles are summed by Spark, a row per task, language and
component; only the languages' profiles (``dimensions`` doubles each, of at most
``MAX_LANGUAGES`` languages, else an error) come to the driver and go out to the tasks,
whatever the corpus.  Every labelled training text is learnt from, whole.

Defined results: a text that is null or has no letter is ``und`` with score 0,
and so is every text if there is nothing to learn from; ties go to the language least in code
points; rows with a null label (or no text) are not learnt from; repeated rows count as often
as they stand; a null key is hashed as the empty text; other columns are passed by, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMENSIONS = 2048
GRAM = 3
WEIGHT = 1 << 24
PIECE = 1 << 20
BLOCK = 1 << 20
DENSE = 1 << 24
MAX_LANGUAGES = 4096
UNKNOWN = "und"
#: A worker forgets letters beyond this number and draws them anew.
LETTERS = 1 << 12


class Encoder:
    """Texts to vectors; holds the letters' vectors and what is known of code points."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.kind = np.zeros(0x110000, np.int8)              # 0 not looked up yet, 1 letter, 2 other
        self.drawn: dict[int, np.ndarray] = {}

    def letter(self, point: int) -> np.ndarray:
        """The letter's vector, rotated by 0 ... gram - 1."""
        if point not in self.drawn:
            if len(self.drawn) >= LETTERS:
                self.drawn.clear()
            v = (np.random.Generator(np.random.PCG64(point)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1).astype(np.int8)
            self.drawn[point] = np.stack([np.roll(v, k) for k in range(self.gram)])
        return self.drawn[point]

    def points(self, text: str) -> np.ndarray:
        """Code points of the lower-cased letters, 32 for all else."""
        p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.kind[p]
        if not kind.all():
            for x in np.unique(p[kind == 0]).tolist():
                self.kind[x] = 1 if chr(x).isalpha() else 2
            kind = self.kind[p]
        return np.where(kind == 2, np.uint32(32), p)

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """The text's letters and single spaces, in parts that overlap by ``gram - 1``."""
        held = np.array([32], np.uint32)
        for a in range(0, len(text), PIECE):
            end = [np.array([32], np.uint32)] if a + PIECE >= len(text) else []
            p = np.concatenate([held, self.points(text[a:a + PIECE]), *end])
            p = p[np.append(True, (p[1:] != 32) | (p[:-1] != 32))]
            if len(p) >= self.gram:
                yield p
            held = p[-(self.gram - 1):] if self.gram > 1 else p[:0]

    def add(self, out: np.ndarray, rows: list[int], pieces: list[np.ndarray], weights: list[int] | None = None) -> None:
        """Adds the pieces' n-gram vectors, times the pieces' weights, to rows of ``out``."""
        n, given = self.gram, rows
        lengths = np.array([len(p) - n + 1 for p in pieces])
        points = np.concatenate(pieces)
        if points.max() < 1 << 16:
            letters = np.flatnonzero(np.bincount(points))
            local = np.zeros(1 << 16, np.int64)
            local[letters] = np.arange(len(letters))
            local = local[points]
        else:
            letters, local = np.unique(points, return_inverse=True)
        m = len(letters)
        code, width = np.zeros(len(points) - n + 1, np.int64), 1
        for k in range(n):
            code = code * m + local[k:len(points) - n + 1 + k]
            width *= m
        starts = np.cumsum([0] + [len(p) for p in pieces[:-1]])
        at = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        code = code[at]
        if width <= 1 << 22:
            kinds = np.flatnonzero(np.bincount(code, minlength=width))
            place = np.zeros(width, np.int64)
            place[kinds] = np.arange(len(kinds))
            which = place[code]
        else:
            kinds, which = np.unique(code, return_inverse=True)
        rows, own = np.unique(rows, return_inverse=True)
        if len(rows) * len(kinds) > DENSE and len(pieces) > 1:   # very many letters: fewer texts at a time
            half = len(pieces) // 2
            for part in (slice(None, half), slice(half, None)):
                self.add(out, given[part], pieces[part], weights and weights[part])
            return
        counts = np.bincount(np.repeat(own, lengths) * len(kinds) + which, None if weights is None else np.repeat(weights, lengths).astype(float),
                             len(rows) * len(kinds)).reshape(len(rows), -1)
        exact = np.float32 if weights is None else np.float64   # counts of a block fit the shorter ones
        vectors = np.stack([self.letter(x) for x in letters.tolist()])
        for a in range(0, len(kinds), 4096):                 # bounded: 4096 n-grams' vectors at a time
            some = kinds[a:a + 4096]
            bound = vectors[some % m, 0].copy()
            for k in range(1, n):
                bound *= vectors[some // m ** k % m, k]
            out[rows] += counts[:, a:a + 4096].astype(exact) @ bound.astype(exact)

    def bundles(self, texts: list[str | None], rows_of: list[int], n: int, weighted: bool = False) -> np.ndarray:
        """``n`` rows: row ``rows_of[i]`` gets the sum of the vectors of text i's n-grams (weighted by the text's length)."""
        out = np.zeros((n, self.dimensions))
        rows, pieces, weights, size = [], [], [], 0

        def added() -> None:
            if pieces:
                self.add(out, rows, pieces, weights if weighted else None)

        for i, t in zip(rows_of, texts):
            for p in self.pieces(t or ""):
                if size + len(p) > BLOCK and pieces:
                    added()
                    rows, pieces, weights, size = [], [], [], 0
                rows.append(i), pieces.append(p), weights.append(max(WEIGHT // len(t), 1))
                size += len(p)
        added()
        return out


def fit(df: DataFrame, text: str, label: str, *, dimensions: int = DIMENSIONS, gram: int = GRAM) -> tuple[list[str], np.ndarray]:
    """The languages in order and their profiles, a row each, from all rows with a text and a label."""
    df = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("t"), F.col(label).cast("string").alias("l"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = Encoder(dimensions, gram), {}

        def sent() -> Iterator[pa.RecordBatch]:
            for name, v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], ["l", "place", "total"])
            held.clear()

        for b in batches:
            names, own = np.unique(np.array(b.column(1).to_pylist(), object), return_inverse=True)
            for name, v in zip(names, encoder.bundles(b.column(0).to_pylist(), own.tolist(), len(names), weighted=True)):
                held[name] = held.get(name, 0) + v
            if len(held) > 64:
                yield from sent()
        yield from sent()

    totals = df.mapInArrow(learn, "l string, place int, total double").groupBy("l", "place").agg(F.sum("total").alias("total"))
    totals = written(totals, "profiles")
    names = [r[0] for r in totals.select("l").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{label} has over {MAX_LANGUAGES} values: not a column of languages")
    names.sort()
    at = {name: i for i, name in enumerate(names)}
    profiles = np.zeros((len(names), dimensions))
    for r in totals.toLocalIterator():                       # bounded: a row per language and component
        profiles[at[r[0]], r[1]] = r[2]
    return names, profiles


def predict(df: DataFrame, names: list[str], profiles: np.ndarray, *, key: str, text: str, gram: int = GRAM) -> DataFrame:
    """``key, lang_pred, score`` of each row."""
    dimensions = profiles.shape[1]
    length = np.linalg.norm(profiles, axis=1)
    known = length > 0
    names, unit = [n for n, k in zip(names, known) if k], profiles[known] / length[known, None]
    kind = df.schema[key].dataType.simpleString()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions, gram)
        for b in batches:
            v = encoder.bundles(b.column(1).to_pylist(), list(range(len(b))), len(b))
            size = np.linalg.norm(v, axis=1)
            some = (size > 0) & bool(names)
            best, score = np.array([UNKNOWN] * len(b), object), np.zeros(len(b))
            if some.any():
                cosines = v[some] @ unit.T / size[some, None]
                best[some] = np.array(names, object)[np.argmax(cosines, axis=1)]
                score[some] = np.clip(cosines.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    return df.select(F.col(key), F.col(text)).mapInArrow(compared, f"`{key}` {kind}, lang_pred string, score double")


def held_out(key: str, fold: int, rest: int):
    """Whether a row's key as text has this CRC-32 remainder; a null key is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(fold)) == rest


def identify(df: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", fold: int = 5, rest: int = 0,
             dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """``key, held_out, lang_pred, score`` of each row; rows whose key has the remainder ``rest`` are not learnt from."""
    df = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l"))    # no name of the input meets one of ours
    names, profiles = fit(df.where(~held_out("k", fold, rest)), "t", "l", dimensions=dimensions, gram=gram)
    found = predict(df, names, profiles, key="k", text="t", gram=gram)
    return found.select(F.col("k").alias(key), held_out("k", fold, rest).alias("held_out"), "lang_pred", "score")
