"""Toxicity by a classifier chain.

The categories stand in a fixed order: poor quality (where labels tell), latent groups of
the rows labelled toxic, and last the verdict.  The groups are found, not listed: spherical k-means
over the toxic rows' vectors of the features that speak for the label.

Features are a text's words and their first 4, 5 and 6 bytes, each counted once, as one of
``SPACE`` hashed places; none is dropped.  For each category each place has a weight: how much more
often it stands in positive rows, over that figure's standard error.  A category's linear (logistic)
model reads a few summaries of a text's weights (its strongest ones, how many are strong, the
sum of those against), the text's size, *and* the probabilities of the categories before
it.  Weights and probabilities are out-of-fold predictions in training: a row is never
summarised by weights that it helped to count, nor followed by a probability from a model that saw
it, so a later model sees earlier ones as noisy as they are on new texts.  The
verdict's threshold is the one with the best F1 out of fold.

Training fits on at most ``max_rows`` labelled rows, taken in the order of
their keys' hash (a documented bound); counting and summarising are Spark jobs over these, and what the driver gets
is a table of ``SPACE`` counts and a few numbers per row.  Scoring covers every row: one pass, no
shuffle.

Defined results: null text is empty; an empty text scores by the intercepts;
null labels are left out of training; a category without both classes is a
constant; without any labelled row nothing is toxic; equal texts score alike;
an empty table gives no rows; other columns of the input are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import written
from .near import fit_centres

PREFIXES = (4, 5, 6)
MAX_ROWS = 20_000
SPACE = 1 << 18
FOLDS = 3
GROUPS = 3
TOPS = (1, 2, 4, 8)
STRONG = (1.0, 2.0, 3.0, 5.0)
SKETCH = 64


def word_codes(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Rows and feature hashes of all words, by kind of feature; the logarithm of each text's number of words."""
    data, starts, ends, first = words.spans(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    rows, codes = [row], [words.hashed(data, starts, ends)]
    for p in PREFIXES:
        at = np.flatnonzero(ends - starts > p)
        code = np.full(len(at), p << 56, np.uint64)
        for i in range(p):
            code |= data[starts[at] + i].astype(np.uint64) << np.uint64(8 * i)
        rows.append(row[at])
        codes.append(words.mix(code))
    return rows, codes, np.log1p(np.diff(first))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place) pairs, in order."""
    rows, codes, _ = word_codes(texts)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = (words.mix(np.concatenate(codes)) % np.uint64(SPACE)).astype(np.int64)
    pair = np.unique(np.concatenate(rows) * SPACE + place)
    return pair // SPACE, pair % SPACE


def weights(positive: np.ndarray, every: np.ndarray, n_positive: int, n: int) -> np.ndarray:
    """Of each place, how much more often it stands in positive rows (logarithm), in standard errors."""
    p, q = (positive + 0.5) / (n_positive + 1), (every - positive + 0.5) / (n - n_positive + 1)
    return np.log(p / q) / np.sqrt(1 / (positive + 0.5) + 1 / (every - positive + 0.5))


def summaries(row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """A few numbers per text of its places' weights (rows ascend)."""
    size = np.bincount(row, minlength=n)
    some = np.flatnonzero(weight > STRONG[0])
    order = some[np.lexsort((-weight[some], row[some]))]
    r, w = row[order], weight[order]
    turn = np.arange(len(r)) - np.searchsorted(r, r, "left")
    out = [np.bincount(r[turn < k], w[turn < k], n) / k for k in TOPS]
    out += [np.log1p(np.bincount(r[w > t], minlength=n)) for t in STRONG]
    out += [np.bincount(row, np.minimum(weight, 0), n) / np.maximum(size, 1), np.log1p(size) / 5]
    return np.stack(out, 1)


@dataclass
class Chain:
    names: list[str]
    places: np.ndarray          # categories x SPACE weights
    mean: np.ndarray            # categories x summaries
    scale: np.ndarray
    linear: np.ndarray          # categories x summaries
    links: np.ndarray           # links[i, j]: weight of category i's probability in category j
    bias: np.ndarray
    threshold: float

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        row, at = features(texts)
        out = np.zeros((len(texts), len(self.names)))
        for j in range(len(self.names)):
            x = (summaries(row, self.places[j][at], len(texts)) - self.mean[j]) / self.scale[j]
            out[:, j] = _sigmoid(self.bias[j] + x @ self.linear[j] + out[:, :j] @ self.links[:j, j])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: np.ndarray, at: np.ndarray, n_features: int, extra: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression on present/absent features and dense extra columns: accelerated gradient descent."""
    n, m = len(y), extra.shape[1]
    if not n or y.min() == y.max():
        return np.zeros(n_features), np.zeros(m), (20.0 if n and y[0] else -20.0)
    w = np.zeros(n_features + m + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    per_row = np.bincount(rows, minlength=n) + (extra ** 2).sum(1) + 1
    # The curvature is at most that of a quarter of X'X, whose largest eigenvalue a few power steps find.
    v = np.ones(len(w))

    def ahead(u: np.ndarray) -> np.ndarray:
        return np.bincount(rows, u[at], n) + extra @ u[n_features:-1] + u[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(at, r[rows], n_features), extra.T @ r, [r.sum()]])

    for _ in range(8):
        v = back(ahead(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (0.3 * min(np.linalg.norm(back(ahead(v))), per_row.max() * n) + ridge)
    keep = np.full(len(w), ridge)
    keep[-1] = 0
    look, before, t = w.copy(), w.copy(), 1.0
    for _ in range(steps):
        grad = back(_sigmoid(ahead(look)) - y) + keep * look
        w = look - step * grad
        t, t0 = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        look = w + (t0 - 1) / t * (w - before)
        before = w
    return w[:n_features], w[n_features:-1], float(w[-1])


def _dense_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    none = np.zeros(0, np.int64)
    _, v, c = fit(none, none, 0, x, y, steps=600)
    return v, c


def counted(rows: DataFrame, names: list[str], folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each fold that have each place: (folds, 1 + categories, SPACE), all and positive ones; and rows of each fold in all."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((folds * (1 + len(names)), SPACE + 1), np.int64)
        for b in batches:
            row, at = features([(x or "").encode("utf-8") for x in b.column(1).to_pylist()])
            fold = b.column(0).to_numpy()
            for j in range(1 + len(names)):
                y = np.ones(len(b), bool) if not j else b.column(1 + j).fill_null(0).to_numpy() == 1
                for f in range(folds):
                    mine = y & (fold == f)
                    table[f * (1 + len(names)) + j, :SPACE] += np.bincount(at[mine[row]], minlength=SPACE)
                    table[f * (1 + len(names)) + j, SPACE] += mine.sum()
        used = np.flatnonzero(table.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(np.ascontiguousarray(c)) for c in table[:, used])], ["at", *(f"n{i}" for i in range(len(table)))])

    columns = [f"n{i}" for i in range(folds * (1 + len(names)))]
    got = rows.select("fold", "t", *names).mapInArrow(tally, "at long, " + ", ".join(f"{c} long" for c in columns)).groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # SPACE rows
    table = np.zeros((len(columns), SPACE + 1), np.int64)
    for i, c in enumerate(columns):
        table[i, got.column("at").to_numpy()] = got.column(c).to_numpy()
    table = table.reshape(folds, 1 + len(names), SPACE + 1)
    return table[:, :, :SPACE], table[:, :, SPACE]


def latent_groups(rows: DataFrame, label: str, n_groups: int) -> DataFrame:
    """``rows`` with 0/1 columns ``group_1`` ...: the positive rows by what speaks for the label in them."""
    table, totals = counted(rows, [label], 1)
    speak = np.maximum(weights(table[0, 1], table[0, 0], totals[0, 1], totals[0, 0]) - 2, 0).astype(np.float32)

    def sketch(places: np.ndarray) -> np.ndarray:
        """A place's random signs."""
        bits = words.mix(places.astype(np.uint64) + np.uint64(1))[:, None] >> np.arange(SKETCH, dtype=np.uint64) & np.uint64(1)
        return bits.astype(np.float64) * 2 - 1

    def vectors(texts: list) -> np.ndarray:
        row, at = features([(x or "").encode("utf-8") for x in texts])
        row, at = row[speak[at] > 0], at[speak[at] > 0]
        out = np.zeros((len(texts), SKETCH))
        for a in range(0, len(at), 1 << 16):
            np.add.at(out, row[a:a + (1 << 16)], sketch(at[a:a + (1 << 16)]) * speak[at[a:a + (1 << 16)], None])
        length = np.linalg.norm(out, axis=1)
        return out / np.maximum(length, 1e-12)[:, None] * (length > 0)[:, None]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in vectors(b.column(1).to_pylist())], pa.binary())], ["h", "v"])

    got = rows.where(F.col(label) == 1).select("h", "t").mapInArrow(sent, "h long, v binary").toArrow()   # max_rows rows of SKETCH numbers
    x = np.array([np.frombuffer(v, float) for v in got.column("v").to_pylist()]).reshape(-1, SKETCH)
    order = np.lexsort((*x.T[::-1], got.column("h").to_numpy()))
    centres = fit_centres(x[order], n_groups)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vectors(b.column("t").to_pylist())
            own = np.argmax(v @ centres.T, axis=1) if len(centres) else np.zeros(len(b), np.int64)
            y = b.column(label).to_numpy() == 1
            more = [pa.array((y & (own == g)).astype(np.int32)) for g in range(n_groups)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, *groups])

    groups = [f"group_{g + 1}" for g in range(n_groups)]
    return rows.mapInArrow(placed, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + "".join(f", {g} int" for g in groups))


def train(labelled: DataFrame, label: str = "toxic", *, earlier: tuple[str, ...] = (), key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, folds: int = FOLDS,
          n_groups: int = GROUPS) -> Chain:
    """Fit a chain on rows with a 0/1 column ``label`` and 0/1 columns ``earlier`` of categories before it; at most ``max_rows`` rows count (see :func:`sample`)."""
    parts = max(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    h = F.xxhash64(F.col(key).cast("string"))
    rows = labelled.select(h.alias("h"), F.pmod(F.shiftright(h, 3), F.lit(folds)).alias("fold"), F.col(text).cast("string").alias("t"), *[F.col(c).cast("int") for c in (*earlier, label)])
    rows = written(rows.where(F.col(label).isNotNull()).limit(max_rows).repartition(parts), "labelled")
    rows = written(latent_groups(rows, label, n_groups), "grouped")
    names = [*earlier, *(f"group_{g + 1}" for g in range(n_groups)), label]
    table, totals = counted(rows, names, folds)

    def of(use: list[int]) -> np.ndarray:
        """Weights from some folds."""
        t, n = table[use].sum(axis=0), totals[use].sum(axis=0)
        return np.stack([weights(t[j], t[0], n[j], n[0]) for j in range(1, 1 + len(names))]).astype(np.float32)

    without = np.stack([of([g for g in range(folds) if g != f]) for f in range(folds)])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at = features([(x or "").encode("utf-8") for x in b.column(2).to_pylist()])
            fold = b.column(1).to_numpy()
            x = np.concatenate([summaries(row, without[fold[row], j, at], len(b)) for j in range(len(names))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary()), *b.columns[3:]], ["h", "fold", "x", *names])

    got = rows.select("h", "fold", "t", *names).mapInArrow(summed, "h long, fold long, x binary, " + ", ".join(f"{c} int" for c in names)).toPandas()   # max_rows rows of a few numbers
    got = got.sort_values(["h", "x"], ignore_index=True)
    n, J = len(got), len(names)
    width = len(TOPS) + len(STRONG) + 2
    chain = Chain(names, of(list(range(folds))), np.zeros((J, width)), np.ones((J, width)), np.zeros((J, width)), np.zeros((J, J)), np.full(J, -20.0), 2.0)
    if not n:
        return chain
    x = np.array([np.frombuffer(v, float) for v in got["x"]]).reshape(n, J, width)
    ys, fold, oof = got[names].fillna(0).to_numpy(float), got["fold"].to_numpy(), np.zeros((n, J))
    for j in range(J):
        chain.mean[j], chain.scale[j] = x[:, j].mean(0), x[:, j].std(0) + 1e-6
        more = np.hstack([(x[:, j] - chain.mean[j]) / chain.scale[j], oof[:, :j]])
        for f in range(folds):
            v, c = _dense_fit(more[fold != f], ys[fold != f, j])
            oof[fold == f, j] = _sigmoid(more[fold == f] @ v + c)
        v, chain.bias[j] = _dense_fit(more, ys[:, j])
        chain.linear[j], chain.links[:j, j] = v[:width], v[width:]
    chain.threshold = best_threshold(oof[:, -1], ys[:, -1])
    return chain


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F1 is best: halfway to the next probability, among equal scores the middle one (new texts lie as near to either side)."""
    if not y.sum():
        return 2.0
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(y.sum(), 1))
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = best[len(best) // 2]
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0)) / 2)


def sample(labels: DataFrame, key: str = "doc_id", label: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled keys, in the order of their hash; a key labelled twice counts as positive (and as ``poor``, if that column is there) if once it is."""
    more = [F.max("poor").alias("poor")] if "poor" in labels.columns else []
    per_key = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key)).agg(F.max(label).alias(label), *more)
    return per_key.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(max_rows)


def train_on(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS) -> Chain:
    """A chain fitted on a bounded sample of the labelled rows of ``docs``: poor quality first, where ``labels`` tells it."""
    quality = [(F.col("quality") == 0).cast("int").alias("poor")] if "quality" in labels.columns else []
    keys = sample(labels.select(F.col(key).alias("_k"), F.col("toxic").alias("_y"), *quality), "_k", "_y", max_rows)
    joined = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(keys), "_k").withColumnRenamed("_y", "toxic")  # max_rows keys at most
    return train(joined, "toxic", earlier=("poor",) if quality else (), key="_k", text="_t", max_rows=max_rows)


def score(df: DataFrame, chain: Chain, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``p_<category>`` of each category and ``toxic``."""
    names = [f"p_{c}" for c in chain.names]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in names) + ", toxic boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.probabilities([(x or "").encode("utf-8") for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, p.T), pa.array(p[:, -1] >= chain.threshold)], [key, *names, "toxic"])

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def keep_clean(df: DataFrame, chain: Chain, *, text: str = "text") -> DataFrame:
    """The rows of ``df`` that the chain does not call toxic, with all their columns."""
    at, schema = df.columns.index(text), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.probabilities([(x or "").encode("utf-8") for x in b.column(at).to_pylist()])
            yield b.filter(pa.array(p[:, -1] < chain.threshold))

    return df.mapInArrow(run, schema)
