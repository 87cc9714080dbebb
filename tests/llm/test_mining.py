"""Language ID, phrase mining and hard negatives: against plain versions, with the odd cases of each."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import random
from pyspark.sql import functions as F

from shroud.llm import language, negatives, phrases
from shroud.llm.oracles import ORACLES
from shroud.llm.queries import QUERIES


# --- language ---------------------------------------------------------------------------------------------------------

def plain_vector(text, d, n=3):
    """Letter by letter."""
    out = np.zeros(d)
    letters = "".join(c if c.isalpha() else " " for c in f" {text or ''} ".lower())
    letters = re.sub(" +", " ", letters)
    drawn = {c: np.random.Generator(np.random.PCG64(ord(c))).integers(0, 2, d, dtype=np.int8).astype(float) * 2 - 1 for c in set(letters)}
    for i in range(len(letters) - n + 1):
        v = np.ones(d)
        for k in range(n):
            v *= np.roll(drawn[letters[i + n - 1 - k]], k)
        out += v
    return out


TEXTS = ["Le chat est sur la table, et il dort.", "the cat is on the table and it sleeps", "Die Katze schläft auf dem Tisch ÜBER", "日本語 の テキスト", "a", "x1y", "  \t", "", "12 34", None,
         "İstanbul ẞ ß", "word " * 400]


def test_bundles_are_sums_of_bound_letters(monkeypatch):
    for piece, block, dense in ((1 << 20, 1 << 20, 1 << 24), (7, 16, 8)):
        monkeypatch.setattr(language, "PIECE", piece)
        monkeypatch.setattr(language, "BLOCK", block)
        monkeypatch.setattr(language, "DENSE", dense)
        texts = TEXTS if piece > 7 else [t for t in TEXTS if t is None or "İ" not in t]
        got = language.Encoder(256).bundles(texts, list(range(len(texts))), len(texts))
        for t, v in zip(texts, got):
            assert (v == plain_vector(t, 256)).all(), t
    got = language.Encoder(64).bundles(["ab cd", "x" * 50], [0, 0], 1, weighted=True)[0]
    assert (got == plain_vector("ab cd", 64) * (2 ** 24 // 5) + plain_vector("x" * 50, 64) * (2 ** 24 // 50)).all()
    both = language.Encoder(256).bundles(["ab cd", "ef"], [0, 0], 1)
    assert (both[0] == plain_vector("ab cd", 256) + plain_vector("ef", 256)).all()


def test_letters_are_drawn_anew_when_forgotten(monkeypatch):
    monkeypatch.setattr(language, "LETTERS", 2)
    assert (language.Encoder(64).bundles(["abcabc"], [0], 1)[0] == plain_vector("abcabc", 64)).all()


def test_identify_against_plain(spark):
    rng = random.Random(3)
    alphabets = {"aa": "abcde ", "bb": "vwxyz ", "cc": "klmno "}
    rows = [(i, "".join(rng.choice(a) for _ in range(60)), name) for i, (name, a) in enumerate(rng.choice(list(alphabets.items())) for _ in range(60))]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "123 !", "cc"), (103, "abcd", None), (104, "vw" * 30000, "bb"), (104, "vw" * 30000, "bb"), (None, "klmno klm", "cc"), (105, "日本", "bb")]
    df = spark.createDataFrame([(*r, "x", 1.0, True) for r in rows], "doc_id long, text string, lang string, l string, score double, held_out boolean").repartition(5)
    d = 512
    got = language.identify(df, dimensions=d).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0
    profile = defaultdict(lambda: np.zeros(d))
    for i, t, name in rows:
        if not held(i) and t and name:
            profile[name] += plain_vector(t, d) * max(2 ** 24 // len(t), 1)
    names = sorted(profile)
    want = Counter()
    for i, t, _ in rows:
        v = plain_vector(t, d)
        cos = [v @ profile[n] / np.linalg.norm(v) / np.linalg.norm(profile[n]) if v.any() else 0 for n in names]
        want[i, held(i), names[int(np.argmax(cos))] if v.any() else "und", round(max(0, max(cos)), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in got) == want
    right = [(r.lang_pred == {k: n for k, _, n in rows}[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 100]
    assert right and all(right)


def test_nothing_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    assert language.identify(spark.createDataFrame([], schema)).count() == 0
    got = language.identify(spark.createDataFrame([(1, "text", None), (2, None, "en")], schema)).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got} == {(1, "und", 0.0), (2, "und", 0.0)}


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="not a column of languages"):
        language.fit(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "t string, l string"), "t", "l", dimensions=8)


def test_language_query_is_right_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_language"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right, n, rows = got.join(docs, "doc_id").agg(F.avg(F.when(F.col("held_out"), (F.col("lang") == F.col("lang_pred")).cast("double"))), F.count_if("held_out"), F.count("*")).first()
    assert rows == docs.count() and n > 100 and right >= 0.99


# --- phrases ----------------------------------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = set()
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        lines = []
        for p, a in found.items():
            if 100 * inside[p] >= share * a:
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            lines.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(lines)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(17)
    vocabulary = ["the", "of", "New", "york", "city", "é", "日本", "a-b", "\"q\"", "\xa0", "ⅷ"] + [f"w{i}" for i in range(30)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(n):
        w = rng.choices(vocabulary, weights, k=n)
        for i in range(0, n - 5, 7):
            w[i:i + 3] = rng.choice((["in", "New", "York"], ["machine", "learning", "model"], ["x"] * 3))
        return "".join(x + rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", "\n", "! "]) for x in w)

    rows = [(rng.choice(["en", "fr", None]), text(rng.randrange(1, 120))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, " \t "), ("de", "einmal"), ("en", rows[0][1]), ("en", rows[0][1]), ("fr", "again and again " * 3000), ("fr", "z" * 5000 + " again and again"), ("es", "no.end:" * 900)]
    return rows


@pytest.mark.parametrize("shards, bits, size, ranges, least", [(3, 16, 400, 200, 5), (1, 22, 1 << 20, 10 ** 9, 30), (4, 3, 900, 100, 3)])
def test_phrases_against_plain(spark, prose, monkeypatch, shards, bits, size, ranges, least):
    monkeypatch.setattr(phrases, "HELD_KEYS", 300)
    monkeypatch.setattr(phrases, "NAMINGS", 0.5)             # many phrases wait for the second naming
    df = spark.createDataFrame([(i, lang, t, "x", 1) for i, (lang, t) in enumerate(prose)], "n long, lang string, text string, kinds string, shard int").repartition(4)
    got = phrases.mine(df, least=least, share=80, top=40, shards=shards, filter_bits=bits, block_bytes=size, range_words=ranges)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == plain_phrases(prose, least, 80, 40)


def test_phrases_of_nothing(spark):
    schema = "lang string, text string"
    assert phrases.mine(spark.createDataFrame([], schema)).count() == 0
    assert phrases.mine(spark.createDataFrame([("en", "just a few words")], schema)).count() == 0
    assert phrases.mine(spark.createDataFrame([(None, None)], schema)).count() == 0


def test_activation_waits_for_both_parts(spark):
    """A scan counts a pair only after both its words got there, and then for one cycle."""
    kinds = np.sort(np.array([11, 22, 33], np.uint64))
    numbers = np.array([1, 2, 0, 2, 3], np.uint32)
    filters = np.zeros((4, 1 << 10), np.uint8)

    def pairs():
        return {n: (at.tolist(), since.tolist()) for n, at, _, since in phrases.levels(kinds, numbers, 0, "en", filters, 10)}[2]

    assert pairs() == ([], [])
    for scan, word in ((1, 11), (3, 22)):
        filters[0][np.concatenate(phrases.places(np.array([word], np.uint64), "en", 10))] = scan
    assert pairs() == ([0], [3])


def test_long_texts_keep_their_phrases():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("aaab bcd  \t.\n") for _ in range(rng.randrange(1, 80))).encode()
        size = rng.randrange(1, 30)
        want, got = Counter(), Counter()
        for piece in re.split(rb"[.,;:!?\n]", text):
            w = piece.split()
            want.update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        for part, lead in phrases.segments(text, size):
            seen = 0
            for piece in re.split(rb"[.,;:!?\n]", part):
                w = piece.split()
                got.update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1) if seen + i + k > lead)
                seen += len(w)
        assert got == want, (text, size)


def test_thin_numbers():
    for x in ([], [0], [1, 255], [256, 3], [2 ** 64 - 1, 0, 7]):
        a = np.array(x, np.uint64)
        assert (phrases.wide(phrases.thin(a)) == a).all()
        assert (phrases.unpacked(phrases.packed(np.sort(a))) == np.sort(a)).all()
    for x in ([], [1], [254, 255, 256, 0, 2 ** 40], [3] * 9):
        assert phrases.counts_of(phrases.few(np.array(x, np.int64))).tolist() == x


# --- hard negatives ---------------------------------------------------------------------------------------------------

def plain_negatives(rows, scale, positives, negatives_, low, high):
    use = []
    for k, v, l in rows:
        if l is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        use.append((k, l, tuple(int(np.floor(x * scale)) for x in v)))
    use = list(dict.fromkeys(use))
    out = set()
    for k, l, v in use:
        if k is None or k % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), (j is None, j or 0), m) for j, m, w in use if j != k)
        for s, (no_id, p), _ in [x for x in scored if x[2] == l][:positives]:
            window = [x for x in scored if x[2] != l and low * -s <= 100 * -x[0] <= high * -s][:negatives_]
            out |= {(k, None if no_id else p, r, j if not none else None, -s, -t) for r, (t, (none, j), _) in enumerate(window, 1)}
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    rows = [(int(i), (rng.integers(-2, 6, 6) / 4).tolist(), int(rng.integers(3))) for i in range(160)]
    rows += [(161, None, 1), (162, [], 1), (163, [1.0, None], 2), (164, [float("nan"), 1.0], 0), (165, [float("inf"), 1.0], 0), (166, [1.0, 1.0], None), (170, [0.0] * 6, 1), (180, [2.0, 1.0], 2),
             (None, [1.5] * 6, 1), (None, [1.25] * 6, 2), (190, [0.1, -0.3, 9.0, 0.0, 0.0, 0.0, 1.0, 2.0], 0), (190, [0.1, -0.3, 9.0, 0.0, 0.0, 0.0, 1.0, 2.0], 0), (200, [-1.0] * 6, 0), rows[10], rows[20]]
    return rows


@pytest.mark.parametrize("shard_rows, group_rows", [(1000, 256), (16, 3)])
def test_negatives_against_plain(spark, vectors, shard_rows, group_rows):
    df = spark.createDataFrame([(*r, "x", 3) for r in vectors], "vec_id long, embedding array<double>, label int, id string, rank int").repartition(4)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, scale=8.0, positives=5, negatives=10, low=30, high=90, shard_rows=shard_rows, group_rows=group_rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = got.collect()
    want = plain_negatives(vectors, 8.0, 5, 10, 30, 90)
    assert len(want) > 300 and len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_exact_scores_past_doubles(spark):
    big = float(2 ** 29)
    rows = [(0, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big / 2, 3.0], 2), (3, [big / 2, 2.0], 2), (4, [1e300, 1.0], 2), (5, [3e9, 0.0], 2)]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0, scale=1.0, high=90).collect()
    assert [(r.rank, r.negative_id, r.negative_score) for r in sorted(got)] == [(1, 2, 2 ** 57 + 3), (2, 3, 2 ** 57 + 2)]


def test_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert negatives.mine(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(spark.createDataFrame([(0, [1.0], 1)], schema), F.col("vec_id") % 10 == 0).count() == 0


def test_search_reaches_all_pairs_above_each_anchors_least_score():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-9, 10, (200, 24)), rng.integers(-9, 10, (15, 24))
    scores = q @ x.T
    for least in (np.full(15, -np.inf), np.full(15, 300.0), rng.integers(-50, 500, 15).astype(float), np.full(15, 10.0 ** 9)):
        a, r, s = negatives.Shard(x).reach(q, least)
        assert set(zip(a.tolist(), r.tolist(), s.tolist())) == {(i, j, scores[i, j]) for i in range(15) for j in range(200) if scores[i, j] >= least[i]}
    assert negatives.Shard(x).index(10.0).max() > 0            # some dimensions are left out of the index


@pytest.mark.parametrize("name", ["op12_phrases", "op13_negatives"])
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    at = [[c[0] for c in cur.description].index(c) for c in got.columns]
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r[i] for i in at) for r in cur.fetchall())
