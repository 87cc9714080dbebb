"""Gazetteer lookup, phone numbers by plan, word forms, clusters of overlapping hits."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from shroud.functions import spans
from shroud.functions.phones import PLAN
from shroud.functions.spans import SPAN_TYPE, stem, stemmed
from shroud.operators import gazetteer as Z
from shroud.operators.detect import detect_spans, type_counts_by
from shroud.operators.mask import mask
from shroud.operators.resolve import greedy_resolve


def found(spark, texts, names, **kw):
    t = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    n = spark.createDataFrame(names, "name string, entity_type string")
    return {(r.seq, r.start, r.end, r.entity_type, r.original) for r in Z.gazetteer_spans(t, n, keys=("seq",), **kw).collect()}


def plain(texts, names):
    """Scan from the left, at each word the longest name that ends where a word ends."""
    table = {}
    for name, kind in names:
        core = re.search(r"\w(?:.*\w)?", name or "", re.S)
        if core:
            table[core[0].lower()] = min(kind, table.get(core[0].lower(), kind))
    out = set()
    for i, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            if re.match(r"\w", t[at]) and not (at and re.match(r"\w", t[at - 1])):
                hit = next((n for n in range(len(t) - at, 0, -1) if t[at:at + n].lower() in table and not re.match(r"\w", t[at + n:at + n + 1] or " ")), 0)
                if hit:
                    out.add((i, at, at + hit, table[t[at:at + hit].lower()], t[at:at + hit]))
                    at += hit
                    continue
            at += 1
    return out


NAMES = [("Acme", "ORG"), ("Acme Trading Ltd.", "ORG"), ("Trading Ltd", "ORG"), ("Jean-Luc O'Neil", "PER"), ("Жан Вальжан", "PER"), ("ACME", "LOC"), ("New  York", "LOC"), ("", "ORG"), (None, "ORG"), ("...", "ORG"), ("日本", "LOC")]


@pytest.mark.parametrize("limit", [Z.BROADCAST_BYTES, 0])
def test_names(spark, monkeypatch, limit):
    monkeypatch.setattr(spans, "WINDOW_CHARS", 24)
    texts = ["acme trading ltd and Acme, acmes", "😀 😀 Acme Trading Ltd; Trading Ltd", "Jean-Luc O'Neil met ЖАН ВАЛЬЖАН.", "New York New  York", "", None, "日本 日本語", "x" * 100 + " Acme " + "word " * 40 + "Acme Trading Ltd"]
    got = found(spark, texts, NAMES, broadcast_bytes=limit)
    assert got == plain(texts, NAMES)
    assert (0, 0, 16, "ORG", "acme trading ltd") in got and (0, 21, 25, "LOC", "Acme") in got and not any(x[0] == 6 and x[1] == 3 for x in got)


def test_random_names(spark, monkeypatch):
    monkeypatch.setattr(spans, "WINDOW_CHARS", 16)
    rng = random.Random(5)
    words = ["a", "b", "ab", "ba", "aé"]
    names = [(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))), rng.choice("XY")) for _ in range(12)]
    texts = ["".join(rng.choice([*words, " ", " ", " ", "-", "😀"]) for _ in range(120)) for _ in range(60)]
    assert found(spark, texts, names) == plain(texts, names)


def test_the_plan_is_a_join_not_a_scan_per_name(spark):
    t = spark.createDataFrame([(1, "x")], "seq long, text string")
    n = spark.createDataFrame(NAMES, "name string, entity_type string")
    for limit, join in ((Z.BROADCAST_BYTES, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = Z.gazetteer_spans(t, n, keys=("seq",), broadcast_bytes=limit)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert plan.count(join) == 2 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_texts_no_names(spark):
    assert found(spark, [], NAMES) == set() and found(spark, ["Acme"], []) == set()


def test_gazetteer_and_rules_mask_together(spark, settings):
    t = spark.createDataFrame([("a", 0, "Иванов И. И. и Жан Вальжан", "ru")], "session_id string, seq long, text string, language string")
    n = spark.createDataFrame(NAMES, "name string, entity_type string")
    got = mask(t, settings, ner_spans=Z.gazetteer_spans(t, n), ner="both").first()
    assert got.masked_text == "[Имя 1] и [Имя 2]"


# --- phones -----------------------------------------------------------------------------------------------------------

def phones(spark, settings, texts):
    t = spark.createDataFrame([("s", i, x, "en") for i, x in enumerate(texts)], "session_id string, seq long, text string, language string")
    out = {}
    for r in detect_spans(t, settings).where("pattern = 'PHONE_PLAN'").orderBy("seq", "start").collect():
        out.setdefault(r.seq, []).append(r.original)
    return [out.get(i, []) for i in range(len(texts))]


def test_numbers_of_the_plan(spark, settings):
    good = ["+44 20 7946 0958", "+33 1 23 45 67 89", "+49 30 1234567", "+34 912 34 56 78", "+1 (202) 555-0143", "0033 1 23 45 67 89", "+353 1 234 5678", "+420.601.123.456", "+12025550143", "+998 90 123 45 67"]
    bad = ["+44 1234", "+999 123456789", "x+442079460958", "+33 1 23 45 67 8", "44 20 7946 0958", "+0 123 456 7890", "", None]
    assert phones(spark, settings, good) == [[x] for x in good]
    assert phones(spark, settings, bad) == [[] for _ in bad]
    mixed = ["call +44 20 7946 0958 24 hours, or +33 1 23 45 67 89/90", "+44 20 7946 0958 +34 912 34 56 78"]
    assert phones(spark, settings, mixed) == [["+44 20 7946 0958", "+33 1 23 45 67 89"], ["+44 20 7946 0958", "+34 912 34 56 78"]]


def test_calling_codes_are_prefix_free():
    assert not [(a, b) for a in PLAN for b in PLAN if a != b and b.startswith(a)]


def test_foreign_phones_are_masked_and_come_back(spark, settings):
    from shroud.operators.unmask import unmask_with_entries
    t = spark.createDataFrame([("a", 0, "ring +44 20 7946 0958 now", "en")], "session_id string, seq long, text string, language string")
    r = unmask_with_entries(mask(t, settings), settings).first()
    assert "7946" not in r.masked_text and r.entities_found == ["PHONE"] and r.unmasked_text == "ring +44 20 7946 0958 now"


# --- word forms -------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("forms", [["свидетельство", "свидетельства", "свидетельством", "СВИДЕТЕЛЬСТВАХ"], ["счёт", "счета", "счёту", "счетом"], ["карта", "карты", "картой", "картам"], ["кузов", "кузова", "кузове"],
                                   ["payment", "payments"], ["адрес", "адреса", "адресами"], ["платёж", "платежа", "платежей"]])
def test_forms_share_a_stem(spark, forms):
    got = spark.createDataFrame([(w,) for w in forms], "w string").select(stem(F.col("w")).alias("s")).distinct().collect()
    assert len(got) == 1 and got[0].s == stemmed(forms[0])


def test_short_words_and_other_words_keep_their_stems(spark):
    got = [r.s for r in spark.createDataFrame([("мир",), ("вин",), ("инна",), ("птс",), ("card",), ("мира",)], "w string").select(stem(F.col("w")).alias("s")).collect()]
    assert got == ["мир", "вин", "инна", "птс", "card", "мира"]


def test_inflected_context_raises_the_score(spark, settings):
    texts = ["по свидетельствам XTA00000000000012", "транспортного средства XTA00000000000012", "средства транспортного XTA00000000000012", "ничего XTA00000000000012"]
    t = spark.createDataFrame([("s", i, x, "ru") for i, x in enumerate(texts)], "session_id string, seq long, text string, language string")
    got = {r.seq: r.score for r in detect_spans(t, settings).where("pattern = 'VIN'").collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.7, 3: 0.7}


# --- overlaps and counts ----------------------------------------------------------------------------------------------

def test_clusters_keep_what_one_fold_over_all_hits_keeps(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        hits = []
        for k in range(rng.randrange(0, 90)):
            a = rng.randrange(200)
            hits.append((a, a + rng.randrange(1, 9), "T", rng.choice([0.5, 0.7]), rng.random() < 0.5, k, "p"))
        rows.append((i, hits))
    got = spark.createDataFrame(rows, f"i int, h {SPAN_TYPE}").select("i", greedy_resolve(F.col("h")).alias("k")).collect()
    for r in got:
        kept = []
        for x in sorted(rows[r.i][1], key=lambda x: (not x[4], -x[3], x[0] - x[1], x[0], x[5])):
            if all(x[1] <= y[0] or x[0] >= y[1] for y in kept):
                kept.append(x)
        assert [tuple(x) for x in r.k] == kept


def test_many_hits_in_one_text(spark):
    def seconds(n):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * 3).alias("start"), (i * 3 + 4 - i % 2 * 2).alias("end"), F.lit("T").alias("etype"), F.lit(0.5).alias("score"),
                                                                                                    F.lit(True).alias("custom"), i.alias("prio"), F.lit("p").alias("pattern"))).alias("h"))
        t = time.time()
        assert df.select(F.size(greedy_resolve(F.col("h")))).first()[0] == n // 2
        return time.time() - t
    seconds(100)
    assert seconds(10_000) < 20


def test_rollup_counts(spark):
    hits = spark.createDataFrame([("en", "A"), ("en", "A"), ("en", "B"), (None, "A")], "lang string, t string")
    got = {tuple(r) for r in type_counts_by(hits, "lang", "t").collect()}
    assert got == {("en", "A", 2, 0), ("en", "B", 1, 0), (None, "A", 1, 0), ("en", None, 3, 1), (None, None, 1, 1), (None, None, 4, 3)}


def test_first_words_are_broadcast_by_their_own_size(spark, monkeypatch):
    """Many names with one first word: shuffled by it, all words that begin one would be one task's."""
    from shroud.operators import gazetteer
    seen = []
    monkeypatch.setattr(gazetteer, "leftmost_longest", lambda hits, keys, of=gazetteer.leftmost_longest: (seen.append(hits), of(hits, keys))[1])
    names = spark.range(300).selectExpr("concat('Acme#', lpad(id, 6, '0')) AS name", "'ORG' AS entity_type")
    texts = spark.range(40).selectExpr("'s' AS session_id", "id AS seq", "concat('From Acme#', lpad(id, 6, '0'), ' to Acme#00000X') AS text")
    got = gazetteer.gazetteer_spans(texts, names, broadcast_bytes=2000)
    assert sorted((r.seq, r.start, r.original) for r in got.collect()) == [(i, 5, f"Acme#{i:06d}") for i in range(40)]
    joins = [x for x in seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert [("strategy=broadcast" in x, "first#" in x) for x in sorted(joins, key=lambda x: "first#" in x)] == [(False, False), (True, True)]


def test_training_reads_texts_once(spark, monkeypatch):
    from shroud.operators.tagger import train
    texts = spark.createDataFrame([("s", 1, "by Acme Ltd and Bob.")], "session_id string, seq long, text string")
    spans = spark.createDataFrame([("s", 1, 3, "Acme Ltd", "ORG")], "session_id string, seq long, start int, original string, entity_type string")
    calls = []
    monkeypatch.setattr(type(texts), "collect", lambda self, of=type(texts).collect: (calls.append(1), of(self))[1])
    model = train(texts, spans)
    assert len(calls) == 1 and model.steps[0][2] > model.steps[0][1] and model.steps[2][2] > model.steps[2][1]
