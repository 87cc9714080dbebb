"""Sessions across batches: reuse, counters, guards, store, delete, expiry."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shroud.operators.ranks import rank_within
from shroud.operators.sessions import mask_sessions
from shroud.operators.unmask import unmask
from shroud.sources import store as S
from tests.helpers import spans



def now():
    return F.expr("TIMESTAMP '2026-01-01 00:00:00'")


def tx(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else "ru") for r in rows],
                                 "session_id string, seq long, text string, language string")


def inj(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], 0.9, i) for i, r in enumerate(rows)],
                                 "session_id string, seq long, start int, end int, entity_type string, score double, idx int")


@pytest.fixture(scope="module")
def first_batch(spark, settings):
    t = tx(spark, [("a", 0, "Иванов пришёл"), ("a", 1, "Петров и Иванов"), ("b", 0, "привет как дела")])
    ner = inj(spark, [("a", 0, 0, 6, "PER"), ("a", 1, 0, 6, "PER"), ("a", 1, 9, 15, "PER")])
    r = mask_sessions(t, settings, now=now(), ner_spans=ner, detectors=False, ner="none")
    m, s = S.merge(S.empty_mapping(spark), S.empty_sessions(spark), r.entries, r.touched, now(), settings.mapping_ttl)
    st = S.Store(spark, tempfile.mkdtemp(prefix="store-"))
    st.write(m, s)
    masked = {(x["session_id"], x["seq"]): x["masked_text"] for x in r.masked.collect()}
    return st, masked


def test_markers_across_texts(first_batch):
    _, masked = first_batch
    assert masked[("a", 0)] == "[Имя 1] пришёл"
    assert masked[("a", 1)] == "[Имя 2] и [Имя 1]"
    assert masked[("b", 0)] == "привет как дела"


def test_empty_session_is_stored(first_batch):
    st, _ = first_batch
    assert {r["session_id"] for r in st.sessions(now()).collect()} == {"a", "b"}


def test_second_batch_reuses_and_guards(spark, settings, first_batch):
    st, _ = first_batch
    t = tx(spark, [("a", 10, "Иванов снова, Сидоров"), ("a", 11, "hello", "en"),
                   ("a", 12, "перезвоните [Имя 2]"), ("b", 10, "text", "en"), ("c", 0, "x", "fr")])
    ner = inj(spark, [("a", 10, 0, 6, "PER"), ("a", 10, 14, 21, "PER")])
    r = mask_sessions(t, settings.with_(other_languages=None), mapping=st.mapping(), sessions=st.sessions(), now=now(),
                      ner_spans=ner, detectors=False, ner="none")
    masked = {(x["session_id"], x["seq"]): x["masked_text"] for x in r.masked.collect()}
    assert masked[("a", 10)] == "[Имя 1] снова, [Имя 3]"
    rej = {(x["session_id"], x["seq"]): x["reason"] for x in r.rejected.collect()}
    assert rej == {("a", 11): "language_mismatch", ("a", 12): "contains_issued_token",
                   ("b", 10): "language_mismatch", ("c", 0): "unsupported_language"}
    new = [(e["original"], e["out"]) for e in r.entries.collect()]
    assert new == [("Сидоров", "[Имя 3]")]


def test_unmask_with_store(spark, settings, first_batch):
    st, _ = first_batch
    replies = spark.createDataFrame([("a", 0, "[Имя 2] звонил [Имя 1]"), ("zz", 0, "[Имя 1]")],
                                    "session_id string, seq long, text string")
    got = {r["session_id"]: (r["unmasked_text"], r["tokens_replaced"])
           for r in unmask(replies, st.mapping(now()), settings).collect()}
    assert got == {"a": ("Петров звонил Иванов", 2), "zz": ("[Имя 1]", 0)}


def test_delete_and_stats(spark, first_batch):
    st, _ = first_batch
    req = spark.createDataFrame([("a",), ("nope",)], "session_id string")
    report, (m2, s2, _) = S.delete_sessions(st.mapping(now()), st.sessions(now()), req)
    assert {r["session_id"]: r["deleted"] for r in report.collect()} == {"a": True, "nope": False}
    assert m2.filter("session_id = 'a'").count() == 0
    assert S.stats(s2, now()).collect()[0]["active_sessions"] == 1


def test_expiry(first_batch):
    st, _ = first_batch
    assert S.stats(st.sessions(), now()).collect()[0]["active_sessions"] == 2
    later = now() + F.expr("INTERVAL 301 SECONDS")
    assert S.stats(st.sessions(), later).collect()[0]["active_sessions"] == 0
    assert st.mapping(later).count() == 0


def test_rank_within_large_group(spark):
    df = spark.range(0, 5000).select(F.lit("g").alias("k"), (F.col("id") * 7 % 5000).alias("o"))
    df = df.unionByName(spark.range(0, 10).select(F.lit("h").alias("k"), F.col("id").alias("o")))
    r = rank_within(df, ["k"], ["o"], "r", partitions=8)
    rows = r.collect()
    assert all(x["r"] == x["o"] + 1 for x in rows)
    assert len(rows) == 5010


def test_expired_entries_stay_expired(spark, settings):
    from shroud.sources.store import empty_mapping, empty_sessions, merge
    m, s = empty_mapping(spark), empty_sessions(spark)
    for hour, name in ((0, "Иванов"), (1, "Петров")):
        at = F.expr(f"TIMESTAMP '2026-01-01 0{hour}:00:00'")
        r = mask_sessions(tx(spark, [("a", hour, f"{name} тут")]), settings, mapping=m, sessions=s, now=at,
                          ner_spans=inj(spark, [("a", hour, 0, 6, "PER")]), detectors=False, ner="none")
        m, s = merge(m, s, r.entries, r.touched, at, settings.mapping_ttl)
    assert [(x["out"], x["original"]) for x in m.collect()] == [("[Имя 1]", "Петров")]


def test_surrogates_go_on_while_values_are_left(spark, settings):
    """All of a session's first salts are taken: entities go on with the next ones, each gets its own out."""
    from shroud.functions import surrogates as G
    from shroud.operators.sessions import _surrogates
    schema = "session_id string, ctype string, original string, first_seq long, first_ord int, lang string"
    new = spark.createDataFrame([("a", "PHONE", f"+7 912 000-00-{i:02d}", i, 0, "ru") for i in range(3)], schema)
    first = new.select("session_id", F.explode(F.expr(G.candidates_sql(settings, "session_id", "ctype", "original", 0, 264))).alias("out"))
    none = spark.createDataFrame([], "session_id string, tok string")
    got = _surrogates(new, none, first, settings).collect()
    assert len(got) == len({r["out"] for r in got}) == 3
    assert not {r["out"] for r in got} & {r["out"] for r in first.collect()}


def test_a_type_without_values_left_fails(spark, settings, monkeypatch):
    from shroud.functions import surrogates as G
    from shroud.operators import sessions
    schema = "session_id string, ctype string, original string, first_seq long, first_ord int, lang string"
    new = spark.createDataFrame([("a", "PHONE", "+7 912 000-00-00", 0, 0, "ru")], schema)
    first = new.select("session_id", F.explode(F.expr(G.candidates_sql(settings, "session_id", "ctype", "original", 0, 8))).alias("out"))
    monkeypatch.setitem(sessions.SPACES, "PHONE", (sessions.SPACES["PHONE"][0], first.distinct().count()))
    with pytest.raises(ValueError, match="no free surrogate"):
        sessions._surrogates(new, spark.createDataFrame([], "session_id string, tok string"), first, settings)
