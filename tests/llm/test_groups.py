"""Near-duplicates, repeated passages, vectors, language model, toxicity and the pipeline, against plain versions."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from shroud.llm import graph, hmm, jaccard, near, search, suffix, toxicity, words
from shroud.llm.words import shingle_sets, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, parts=3):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS).repartition(parts, "doc_id")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, chains of near copies, shared passages, short, blank, null and very long texts."""
    rng = random.Random(11)
    texts = [None, "", " \t\n", "one", "ONE", "two words", "a b c d", "A  b C d", "x" * 80_000, prose(rng, 20_000)]
    texts += [texts[-1], texts[8]]
    for n in (12, 40, 150, 600):
        base = prose(rng, n)
        texts += [base, base, base.upper()] + [edited(rng, base, k) for k in (1, 1, 2, 3, max(1, n // 60), n // 30, n // 10)]
    chain = prose(rng, 200)
    for _ in range(12):
        chain = edited(rng, chain, 3)
        texts.append(chain)
    hot = prose(rng, 100)
    texts += [edited(rng, hot, rng.randrange(4)) for _ in range(60)]
    passage = prose(rng, 60)
    texts += [prose(rng, rng.randrange(5, 60)) + " " + passage + " " + prose(rng, rng.randrange(5, 60)) for _ in range(40)]
    texts += ["ab" * 300, "ab" * 250 + "c", "é" * 150, "né" + "é" * 149, "la la la " * 60]
    texts += [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    rng.shuffle(texts)
    return texts


def test_hashes_tell_words_apart(corpus):
    data = [(t or "").encode() for t in corpus]
    h, first = word_hashes(data)
    seen = {}
    for t, a, b in zip(corpus, first, first[1:]):
        w = brute.words(t)
        assert len(w) == b - a
        for x, y in zip(w, h[a:b].tolist()):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)
    assert [len(s) for s in shingle_sets(data)] == [len(brute.shingles(t)) for t in corpus]


@pytest.mark.parametrize("hub_rounds, bits", [(2, 8), (0, 3), (3, 10)])
def test_jaccard_components(spark, corpus, hub_rounds, bits, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 20_000)
    roots, sets = brute.jaccard_components(corpus)
    got = {r.doc_id: r for r in jaccard.join(docs(spark, corpus), hub_rounds=hub_rounds, fragment_bits=bits).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), x) for i, (s, x) in enumerate(zip(sets, roots))}


def test_jaccard_odd_tables(spark):
    assert jaccard.join(docs(spark, [])).count() == 0
    rows = jaccard.join(docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, None], [5, None, 5, 7, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 0, -1), (-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7)]
    named = docs(spark, ["a b c", "a b c"]).select(F.col("doc_id").alias("node"), F.col("text").alias("set"), F.lit(1).alias("id"), F.lit(1).alias("n"))
    assert sorted((r["node"], r.component_id) for r in jaccard.join(named, key="node", text="set").collect()) == [(0, 0), (1, 0)]


@pytest.mark.parametrize("size", [1 << 18, 16])
def test_components_of_chains_and_stars(spark, size, monkeypatch):
    monkeypatch.setattr(graph, "LINKS", size)                # beyond it, rounds of joins
    rng, u, links = random.Random(3), brute.Union(), []
    order = list(range(200))
    rng.shuffle(order)
    links += list(zip(order[:60], order[1:60]))
    links += [(order[70], x) for x in order[71:120]]
    links += [(rng.choice(order[130:]), rng.choice(order[130:])) for _ in range(50)]
    for a, b in links:
        u.join(a, b)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: u.root(x) for a, b in links if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    named = spark.createDataFrame([(f"x{a:03}" if a % 2 else f"я{a:03}", f"x{b:03}" if b % 2 else f"я{b:03}") for a, b in links], "a string, b string")
    by_name = {r.id: r.component for r in graph.components(named).collect()}
    for x, r in by_name.items():
        group = [y for y in by_name if by_name[y] == r]
        assert r == min(group, key=str.encode) and {int(y[1:]) for y in group} == {y for y in got if got[y] == got[int(x[1:])]}


@pytest.mark.parametrize("length, hot, bits, size", [(200, 2000, 8, 1 << 21), (200, 0, 4, 1 << 21), (64, 2, 2, 3000), (200, 2000, 0, 250)])
def test_repeated_passages(spark, corpus, length, hot, bits, size, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 30_000)
    want = brute.repeated_bytes(corpus, length)
    got = {r.doc_id: r for r in suffix.dedup(docs(spark, corpus), length=length, hot_blocks=hot, fragment_bits=bits, sort_bytes=size).collect()}
    for i, (n, removed, spans, kept) in enumerate(want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), r.kept_sha256) == (n, removed, spans, kept, hashlib.sha256(kept).hexdigest())


def test_suffix_ranks_and_segments(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(150):
        n, k, length = rng.integers(1, 120), rng.integers(1, 4), int(rng.integers(1, 30))
        data = rng.integers(97, 97 + k, n).astype(np.uint8)
        ranks = suffix.suffix_ranks(data.astype(np.int64) + 1, 1, 1, 10 ** 6, suffix.eights(data))
        assert np.argsort(ranks, kind="stable").tolist() == sorted(range(n), key=lambda i: data[i:].tobytes())
        starts = np.arange(max(n - length + 1, 0))
        weight = rng.integers(1, 3, len(starts))
        count = collections.Counter()
        for s, w in zip(starts, weight):
            count[data[s:s + length].tobytes()] += w
        assert suffix.repeated_starts(data, starts, weight, length).tolist() == [count[data[s:s + length].tobytes()] > 1 for s in starts]
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = suffix.anchors(data, np.array([1200, 100, 0, 3700]), 200)
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    cut = suffix.anchors(data, np.array([1200, 100, 0, 3700]), 200)
    starts = [{(int(g), int(a), s) for a, f, z, g in zip(*x) for s in range(f, z + 1)} for x in (whole, cut)]
    assert starts[0] == starts[1] and len(starts[0]) == 1001 + 3501


def test_suffix_odd_tables(spark):
    assert suffix.dedup(docs(spark, [])).count() == 0
    text = "é" * 99 + "".join(chr(97 + i % 26) for i in range(300))
    df = docs(spark, [text, text[30:], None, "short"]).withColumn("block", F.lit(1)).withColumn("keys", F.lit("k")).withColumn("kept", F.lit(None).cast("string"))
    out = {r.doc_id: r for r in suffix.without_repeats(df).collect()}
    assert out[2].text is None and out[3].text == "short" and out[0]["keys"] == "k" and out[1]["block"] == 1 and out[0].kept is None
    kept = [x[3].decode("utf-8", "ignore") for x in brute.repeated_bytes([text, text[30:]], 200)]
    assert [out[0].text, out[1].text] == kept


def test_suffix_working_sets(spark, monkeypatch):
    """What a task holds: one sort, the anchors of one block, a fragment whose share of the input is bounded, marks as bits."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 4 << 20).astype(np.uint8)

    def peak(f, *args):
        tracemalloc.start()
        f(*args)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / 1e6

    n = suffix.SORT_BYTES
    assert peak(suffix.repeated_starts, np.concatenate([data[:n // 2]] * 2), np.arange(n - 200), np.ones(n - 200, np.int64), 200) < 32
    assert peak(suffix.anchors, data, np.full(4096, 1024), 200) < 45
    grams = suffix.anchors(data, np.full(4096, 1024), 200)[3]
    assert np.bincount((grams >> np.uint64(40)).astype(int), minlength=256).max() < 2 * len(grams) / 256      # least hashes, evenly dealt
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 20_000)
    letters = data[:300_000].tobytes().decode()
    texts = [letters[i:i + 1000] for i in range(0, 300_000, 1000)]
    blocks, marks = suffix.repeated(docs(spark, texts + texts), fragment_bits=0)
    sizes = {r.block: len(r.a) // 8 * 1000 for r in blocks.collect()}
    starts = {r.block: suffix.marked(r.a, sizes[r.block]) for r in marks.collect()}
    assert sum(x.sum() for x in starts.values()) == 600 * 801 and max(len(r.a) for r in marks.collect()) < 20_000 / 8 + 200
    assert [suffix.bits_for(n, 8) for n in (0, 130, 1023, 7500, 75000)] == [8, 8, 8, 11, 15]


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    x = [list(map(float, base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.18, 0.25]))) for i in range(500)]
    x += [x[0]] * 20 + [[2 * v for v in x[0]], [0.0] * 16, [], None, [float("nan")] * 16, [None] + [1.0] * 15, [1.0, 0.0], [2.0, 0.0], [0.0, 1.0]]
    df = spark.createDataFrame([(i, v, 1, "n") for i, v in enumerate(x)], "vec_id long, embedding array<double>, node int, k string").repartition(4)
    ok = [i for i, v in enumerate(x) if v and None not in v and np.isfinite(v).all() and any(v)]
    n, u = collections.Counter(), brute.Union()
    for i in ok:
        for j in ok:
            if j < i and len(x[i]) == len(x[j]):
                a, b = np.array(x[i]), np.array(x[j])
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                    n[i] += 1
                    n[j] += 1
                    u.join(i, j)
    for cell_rows, block_rows in ((40, 64), (10 ** 6, 10 ** 6)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near.link(df, cell_rows=cell_rows, block_rows=block_rows).collect()}
        assert got == {i: (n[i], u.root(i), u.root(i) == i) for i in range(len(x))}
    assert near.link(df.limit(0)).count() == 0


def test_embedding_links_write_each_vector_once(spark, monkeypatch):
    """What is written does not grow with the number of cells, also where every vector may have partners in most cells."""
    x = np.random.default_rng(5).normal(size=(600, 32))
    x = np.concatenate([x, x[:40] + 0.01])
    tables = []

    def spied(df, name, of=near.written):
        tables.append(of(df, name))
        return tables[-1]
    monkeypatch.setattr(near, "written", spied)
    got = near.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), cell_rows=20, block_rows=32)
    assert got.where("n_links = 1").count() == 80 and got.where("n_links = 0").count() == 560
    vectors = [t.agg(F.sum(F.octet_length("data"))).first()[0] for t in tables if "data" in t.columns]
    assert vectors and sum(vectors) <= 2 * x.nbytes


def test_exact_search(spark):
    rng = np.random.default_rng(6)
    x = [list(map(float, v)) for v in rng.normal(size=(700, 8)) * rng.choice([0.2, 1, 3], (700, 1))]
    x += [x[0]] * 30 + [[0.0] * 8, None, [], [float("inf")] * 8, [None] * 8, [1.0, 2.0], [3.0, 1.0]]
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, id int, data string").repartition(4)
    ok = {i: np.floor(64 * np.array(v)) for i, v in zip(ids, x) if v and None not in v and np.isfinite(v).all()}
    want = {}
    for i in ok:
        if i % 20 == 0 or i in (735, 736):
            want[i] = sorted((-int(ok[i] @ v), j) for j, v in ok.items() if j != i and len(v) == len(ok[i]))[:20]
    for shard_rows, query_rows in ((64, 16), (10 ** 6, 10 ** 6)):
        rows = search.top_k(df, F.expr("vec_id % 20 = 0 or vec_id in (735, 736)"), k=20, shard_rows=shard_rows, query_rows=query_rows).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert got == {i: v for i, v in want.items() if v}
    assert search.top_k(df.limit(0), F.lit(True)).count() == 0


def test_search_with_repeated_rows(spark):
    """Copies of a query are one query, other vectors under its id are another; copies of a candidate are rows."""
    rng = np.random.default_rng(12)
    x = [list(map(float, v)) for v in rng.normal(size=(120, 4))]
    rows = list(enumerate(x)) + [(0, x[0])] * 2 + [(20, x[33])] + [(7, x[7])] * 3 + [(40, x[40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ok = [(i, tuple(np.floor(64 * np.array(v)).astype(int).tolist())) for i, v in rows]
    for shard_rows, query_rows in ((16, 2), (10 ** 6, 10 ** 6)):
        got = {}
        for r in search.top_k(df, F.expr("vec_id % 20 = 0"), k=10, shard_rows=shard_rows, query_rows=query_rows).collect():
            got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
        want = {}
        for i, v in sorted(set(ok)):
            if i % 20 == 0:
                best = sorted((-int(np.dot(v, w)), j) for j, w in ok if j != i)[:10]
                want.setdefault(i, []).extend((rank, s, j) for rank, (s, j) in enumerate(best, 1))
        assert {i: sorted(g) for i, g in got.items()} == {i: sorted(w) for i, w in want.items()}


def test_dual_search_prunes():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 6)) * 400
    x = np.floor(np.concatenate([c + rng.normal(size=(100, 6)) * 3 for c in centres]))
    s = search.DualSearch(x, np.arange(2000), x[::50], np.arange(0, 2000, 50), np.full(40, -np.inf), 5)
    for row, i in enumerate(range(0, 2000, 50)):
        want = sorted((-float(x[i] @ x[j]), j) for j in range(2000) if j != i)[:5]
        assert [(-a, b) for a, b in zip(s.score[row], s.found[row])] == want
    assert s.compared < 0.4 * 2000 * 40


def test_dual_search_compares_evenly_spread_points_together(monkeypatch):
    """Points without near neighbours are leaves of many points, not of one each; scores are exact in both precisions."""
    rng = np.random.default_rng(9)
    for scale in (64, 1 << 14):
        x, calls = np.floor(scale * rng.normal(size=(1500, 48))), []
        monkeypatch.setattr(search.DualSearch, "_compare", lambda s, q, p, of=search.DualSearch._compare: (calls.append(len(p)), of(s, q, p)))
        s = search.DualSearch(x, np.arange(1500), x[::15], np.arange(0, 1500, 15), np.full(100, -np.inf), 5)
        monkeypatch.undo()
        for row, i in enumerate(range(0, 1500, 15)):
            want = sorted((-int(v), j) for j, v in enumerate(x.astype(int) @ x[i].astype(int)) if j != i)[:5]
            assert [(-int(a), b) for a, b in zip(s.score[row], s.found[row])] == want
        assert len(calls) <= 20


def test_language_model_counts(spark, corpus):
    got = {r.doc_id: r for r in hmm.score(docs(spark, corpus), classes=512, states=3).collect()}
    tokens = [brute.words(t) + [None] for t in corpus]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(corpus))]
    count = collections.Counter(x for w, h in zip(tokens, held) if not h for x in w)
    N, V = sum(count.values()), len(count)
    for i, w in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(count[x] > 0 for x in w), N)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (N + V + 1)) for x in w), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert hmm.score(docs(spark, [])).count() == 0


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(9)
    S, K = 3, 4
    norm = lambda m: m / m.sum(-1, keepdims=True)
    model = hmm.Model(norm(rng.random(S)), norm(rng.random((S, S))), norm(rng.random((S, K))).T)
    texts = [rng.integers(0, K, n) for n in (1, 5, 2, 4, 1)]
    first = np.append(0, np.cumsum([len(t) for t in texts]))
    got = model.forward(first, np.concatenate(texts))
    import itertools
    starts, moves, emits = np.zeros(S), np.zeros((S, S)), np.zeros((K, S))
    for t, g in zip(texts, got):
        total, parts = 0, []
        for path in itertools.product(range(S), repeat=len(t)):
            p = model.start[path[0]] * model.emit[t[0], path[0]]
            for a, b, o in zip(path, path[1:], t[1:]):
                p *= model.move[a, b] * model.emit[o, b]
            total += p
            parts.append((path, p))
        assert g == pytest.approx(math.log10(total))
        for path, p in parts:
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for s, o in zip(path, t):
                emits[o, s] += p / total
    for mine, want in zip(model.expected(first, np.concatenate(texts)), (starts, moves, emits)):
        np.testing.assert_allclose(mine, want, rtol=1e-4)


def test_long_texts_in_segments(monkeypatch):
    """Cut into segments or not, in small pieces or one: the same likelihoods and expected counts."""
    rng = np.random.default_rng(4)
    S, K = 4, 30
    norm = lambda m: m / m.sum(-1, keepdims=True)
    model = hmm.Model(norm(rng.random(S)), norm(rng.random((S, S)) ** 4), norm(rng.random((S, K)) ** 4).T)
    size = [1, 700, 7, 8, 9, 64, 2, 350, 1, 16]
    first, kinds = np.append(0, np.cumsum(size)), rng.integers(0, K, sum(size)).astype(np.uint16)
    likely, counts = model.forward(first, kinds), model.expected(first, kinds)
    assert counts[0].sum() == pytest.approx(len(size)) and counts[2].sum() == pytest.approx(sum(size))
    assert counts[1].sum() == pytest.approx(sum(size) - len(size))
    for cut, words in ((8, 1 << 20), (7, 100), (1, 1 << 20), (64, 1)):
        monkeypatch.setattr(hmm, "CUT", cut)
        monkeypatch.setattr(hmm, "PIECE_WORDS", words)
        np.testing.assert_allclose(model.forward(first, kinds), likely, rtol=1e-10)
        for mine, want in zip(model.expected(first, kinds), counts):
            np.testing.assert_allclose(mine, want, rtol=1e-8, atol=1e-12)


def test_rounds_take_few_steps():
    """Each step of a round costs some calls: pieces are so wide that texts of all lengths share their steps, cut ones too."""
    rng = np.random.default_rng(5)
    size = rng.integers(1, 2000, 3000)
    size[:3] = 20_000, 9000, 9000
    first, kinds = np.append(0, np.cumsum(size)), rng.integers(0, 30, size.sum()).astype(np.uint16)
    pieces = [p for _, p in hmm._pieces(first, kinds)]
    assert sum(len(p.left) for p in pieces) < 1.2 * hmm.CUT and sum(len(p.kinds) for p in pieces) == len(kinds)
    emit = rng.random((30, 3))
    model = hmm.Model(np.full(3, 1 / 3), np.full((3, 3), 1 / 3), emit / emit.sum(0))
    tracemalloc.start()
    start, move, emits, likely = pieces[0].counts(model)
    assert tracemalloc.get_traced_memory()[1] < 24 * 1.6 * len(pieces[0].kinds)    # its states and little more
    tracemalloc.stop()
    assert likely == pytest.approx(pieces[0].likely(model).sum()) and emits.sum() == pytest.approx(len(pieces[0].kinds))
    distinct, number = hmm.numbered([b"b a b", b"", b"a c"], 64)[1::2]
    assert number.tolist()[0] == number[2] and (np.diff(distinct.astype(float)) > 0).all() and distinct[number[3]] == distinct[number[4]] == hmm.END


def test_language_model_learns(spark):
    rng = random.Random(1)
    kinds = [["the", "of", "ing", "shore", "thin"], ["les", "eau", "que", "entre", "ment"]]
    texts = [" ".join(rng.choice(kinds[i % 2]) for _ in range(40)) for i in range(200)]
    rows = [r for r in hmm.score(docs(spark, texts), states=4).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows) + 3 * len(rows)


def test_language_model_rounds_see_every_training_text(spark):
    """Scores are those of full rounds until the likelihood settles, however the rows are dealt out."""
    rng = random.Random(2)
    kinds = [["the", "of", "ing", "shore", "thin"], ["les", "eau", "que", "entre", "ment"], ["und", "zwei", "ich", "baum", "kraft"]]
    texts = [" ".join(rng.choice(kinds[i % 3]) for _ in range(900 if i % 50 == 0 else 20)) for i in range(600)]
    classes, states = 64, 3
    first, distinct, kind, number = hmm.numbered([t.encode() for t in texts], classes)
    train = np.array([zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))])
    at, seen = hmm._texts(first, kind[number], train)
    known = np.unique(number[np.repeat(train, np.diff(first))])
    total = np.bincount(seen, minlength=classes + 1) + np.bincount(kind[known], minlength=classes + 1)
    share = (total + 1.0) / (total.sum() + classes + 1)
    model, likely = hmm.Model.first(share, states), -np.inf
    while (now := model.forward(at, seen).sum()) - likely >= 1e-4 * -now:
        likely, model = now, hmm.Model.of(*model.expected(at, seen), share)
    path = model.forward(first, kind[number])
    for parts in (1, 5):
        got = {r.doc_id: r for r in hmm.score(docs(spark, texts, parts=parts), classes=classes, states=states).collect()}
        want = []
        for i in range(len(texts)):
            n = number[first[i]:first[i + 1]]
            c = np.bincount(number[np.repeat(train, np.diff(first))], minlength=len(distinct))
            want.append(path[i] + np.log10(c[n] + 1.0).sum() - np.log10(total[kind[n]] + 1.0).sum())
        np.testing.assert_allclose([got[i].score for i in range(len(texts))], want, rtol=1e-6)


def toxic_rows(n=400):
    rng = random.Random(2)
    texts, toxic = [], []
    for i in range(n):
        w = prose(rng, rng.randrange(20, 200), 800).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "SCUM", "pathetic", f"zorgon{rng.randrange(99)}"]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_on_held_out_rows(spark):
    texts, toxic = toxic_rows()
    df = docs(spark, texts + [None, "", "idiot " * 5000], list(range(400)) + [400, 401, 402])
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic) if i % 2] + [(1, 0, 0), (None, 0, 1), (3, 0, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train_on(df, labels)
    assert chain.names == ["poor", "group_1", "group_2", "group_3", "toxic"]
    out = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    wrong = [i for i in range(0, 400, 2) if out[i].toxic != bool(toxic[i])]
    assert len(wrong) <= 4 and len(out) == 403
    assert not out[400].toxic and not out[401].toxic and out[402].toxic
    assert all(0 <= out[i][f"p_{c}"] <= 1 for i in out for c in chain.names)


def test_chain_against_plain(spark):
    """Counts, weights, summaries and out-of-fold inputs once more, word by word."""
    texts, toxic = toxic_rows(150)
    texts[7] = ""
    rows = spark.createDataFrame([(i, t, y, int(i % 4 == 0)) for i, (t, y) in enumerate(zip(texts, toxic))], "doc_id long, text string, toxic int, poor int")
    chain = toxicity.train(rows, "toxic", earlier=("poor",), n_groups=0)
    hashes = {r.doc_id: r.h for r in rows.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    order = sorted(range(150), key=lambda i: hashes[i])
    fold = {i: (hashes[i] >> 3) % 3 for i in order}
    place = {}

    def places(i):
        found = set()
        for w in brute.words(texts[i]):
            for piece in {w, *(w.encode()[:p] + bytes([p]) for p in (4, 5, 6) if len(w.encode()) > p)}:
                if piece not in place:
                    _, codes, _ = toxicity.word_codes([(w if isinstance(piece, str) else w).encode()])
                    kind = 0 if isinstance(piece, str) else piece[-1] - 3
                    place[piece] = int(words.mix(codes[kind].copy())[0] % np.uint64(toxicity.SPACE))
                found.add(place[piece])
        return found

    own, ys = {i: places(i) for i in order}, {"poor": {i: int(i % 4 == 0) for i in order}, "toxic": dict(enumerate(toxic))}

    def weigh(inside, y):
        n, total = len(inside), sum(y[i] for i in inside)
        every, pos = collections.Counter(p for i in inside for p in own[i]), collections.Counter(p for i in inside if y[i] for p in own[i])

        def of(p):
            a, b = pos[p] + 0.5, every[p] - pos[p] + 0.5
            return math.log(a / (total + 1) / (b / (n - total + 1))) / math.sqrt(1 / a + 1 / b)
        return of

    def summary(i, of):
        w = sorted((of(p) for p in own[i]), reverse=True)
        strong = [x for x in w if x > 1]
        return [sum(strong[:k]) / k for k in (1, 2, 4, 8)] + [math.log1p(sum(x > t for x in strong)) for t in (1, 2, 3, 5)] + [sum(x for x in w if x < 0) / max(len(w), 1), math.log1p(len(w)) / 5]

    before = np.zeros((150, 0))
    for j, name in enumerate(("poor", "toxic")):
        y = np.array([ys[name][i] for i in order], float)
        parts = [weigh([i for i in order if fold[i] != f], ys[name]) for f in range(3)]
        x = np.array([summary(i, parts[fold[i]]) for i in order])
        np.testing.assert_allclose(chain.mean[j], x.mean(0), rtol=1e-4, atol=1e-5)
        more = np.hstack([(x - x.mean(0)) / (x.std(0) + 1e-6), before])
        f, oof = np.array([fold[i] for i in order]), np.zeros(150)
        for k in range(3):
            _, v, c = toxicity.fit(np.zeros(0, int), np.zeros(0, int), 0, more[f != k], y[f != k], steps=600)
            oof[f == k] = 1 / (1 + np.exp(-(more[f == k] @ v + c)))
        _, v, c = toxicity.fit(np.zeros(0, int), np.zeros(0, int), 0, more, y, steps=600)
        np.testing.assert_allclose([*chain.linear[j], *chain.links[:j, j], chain.bias[j]], [*v, c], rtol=1e-2, atol=1e-3)
        before = np.hstack([before, oof[:, None]])
    assert abs(chain.threshold - toxicity.best_threshold(before[:, 1], y)) < 1e-2


def test_toxicity_without_labels(spark):
    df = docs(spark, ["idiot", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train_on(df, none)
    assert [r.toxic for r in toxicity.score(df, chain).collect()] == [False, False]
    assert toxicity.keep_clean(df.withColumn("p_toxic", F.lit(1)), chain).count() == 2
    assert toxicity.score(df.limit(0), chain).count() == 0


def test_fit_finds_the_ridge_optimum():
    rng = np.random.default_rng(3)
    x = (rng.random((300, 20)) < 0.2).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] * 4 - x[:, 1] * 2 - 1)))).astype(float)
    rows, at = np.nonzero(x)
    w, v, c = toxicity.fit(rows, at, 20, np.zeros((300, 0)), y, steps=2000)
    grad = x.T @ (1 / (1 + np.exp(-(x @ w + c))) - y) + w
    assert np.abs(grad).max() < 1e-2


def test_pipeline_stages(spark, corpus, tmp_path):
    """Each stage against the plain version, on its own input."""
    texts, toxic = toxic_rows(200)
    everything = [f"{t}" if t is not None else None for t in corpus if t is None or len(t) < 20_000 and "abab" not in t] + texts + ["keep password=abcdef123456 out of this"]
    ids = list(range(len(everything)))
    df = docs(spark, everything)
    offset = len(everything) - 201
    for name, table in (("documents", df), ("labels", spark.createDataFrame([(offset + i, 1, y) for i, y in enumerate(toxic)] + [(i, 1, 0) for i in range(offset)], "doc_id long, quality int, toxic int"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard", "suffix_dedup", "secrets", "packing"]
    sf = str(tmp_path)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages["toxicity"](spark, now, sf)
    left = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == now.columns
    assert sum(offset + i in left for i in range(200) if toxic[i]) <= 2 and sum(i not in left for i in ids if i < offset or i >= offset + 200 or not toxic[i - offset]) <= 4
    kept = stages["ngram_jaccard"](spark, now, sf)
    roots, _ = brute.jaccard_components(everything)
    assert kept.columns == now.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))
    cut = stages["suffix_dedup"](spark, now, sf)
    want = [x[3].decode("utf-8", "ignore") for x in brute.repeated_bytes(everything, 200)]
    got = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == now.columns and all(got[i].text == (None if everything[i] is None else want[i]) and got[i].n_chars in (None, len(want[i])) for i in ids)
    clean = {r.doc_id: r.text for r in stages["secrets"](spark, now, sf).collect()}
    assert [i for i in ids if clean[i] != everything[i]] == [ids[-1]] and "abcdef123456" not in clean[ids[-1]]
    packed = stages["packing"](spark, now, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(ids)
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == packed.columns and whole.count() > 100


def test_near_duplicates_go_by_row(spark):
    """Rows without an id and rows that share one: of a component one row stays, every other row stays."""
    rng = random.Random(21)
    a, b, c, d, alone = (prose(rng, 60) for _ in range(5))
    near = lambda t: t + " end"
    rows = [(None, a, "s"), (None, near(a), "s"), (1, b, "s"), (5, near(b), "s"), (5, alone, "s"), (6, c, "s"), (6, near(c), "s"),
            (3, d, "s"), (None, near(d), "s"), (None, None, "s"), (None, None, "t"), (8, "", "s"), (8, "", "t"), (9, "x y z", "s"), (9, "x y z", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept = corpus_pipeline.distinct_documents(spark, df, "")
    got = collections.Counter(map(tuple, kept.collect()))
    assert kept.columns == df.columns and max(got.values()) == 1
    for group in ({rows[0], rows[1]}, {rows[5], rows[6]}):
        assert len(group & set(got)) == 1
    assert set(got) - {*rows[:2], *rows[5:7]} == {rows[2], rows[4], rows[7], *rows[9:14]}


def test_words_beyond_a_segment():
    long = b"q" * (words.LONG_WORD + 5)
    h, first = word_hashes([long + b" a " + b"w " * (words.SEGMENT // 2 + 10) + long, b"a"])
    assert h[0] == h[-2] and h[1] == h[-1] and first.tolist()[-1] == len(h)


def test_huge_and_tiny_components_link_as_any(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 1.0]), (4, [2.0, 2.0]), (5, [5e-324, -5e-324]), (6, [1.7e308, -1.7e308]), (7, [0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


def test_stages_keep_columns_of_any_name(spark):
    text = prose(random.Random(3), 60)
    df = spark.createDataFrame([(1, text, "a", 7, "x"), (2, text, "b", 8, "y"), (2, text, "b", 8, "y"), (None, "other " + text[::-1], "c", None, None)], "doc_id long, text string, _digest string, of int, row string")
    got = corpus_pipeline.distinct_documents(spark, df, "")
    assert got.columns == df.columns and sorted((r.doc_id or 0, r._digest, r.of, r.row) for r in got.collect()) == [(0, "c", None, None), (1, "a", 7, "x")]
