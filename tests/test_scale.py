"""Work is dealt out and not done twice, whatever the layout of the files."""

import pytest
from pyspark.sql import functions as F

from shroud.functions import surrogates as G
from shroud.operators.mask import mask
from shroud.operators.unmask import unmask_with_entries
from shroud.plans import queries as Q

from tests.helpers import texts

ENTRIES = "session_id string, text string, entries array<struct<out:string,original:string>>"


@pytest.fixture()
def customers(spark, tmp_path):
    """A customer table of one file of one row group."""
    spark.range(40000).select(F.col("id").alias("c_custkey"), F.lit("Customer").alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", ["detect_requisites", "type_counts_requisites", "mask_requisites", "masked_spans", "unmask_counts", "context_boost", "mask_hint",
                                   "detect_phone_plan", "context_forms", "surrogate_values"])
def test_customer_texts_are_dealt_out(spark, customers, monkeypatch, query):
    """Texts of one small file are worked on in many tasks, the more the more rows there are."""
    monkeypatch.setattr(Q, "ROWS_PER_TASK", 1000)
    plan = Q.QUERIES[query](spark, customers)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [c_custkey" in plan and ", 40" in plan
    assert Q._customers(spark, customers).rdd.getNumPartitions() == 40


def test_only_needed_salts_are_computed(spark, settings, monkeypatch):
    """A value whose first candidate is free computes no other one."""
    plain = type(G.SPARK).hmac_hex
    monkeypatch.setattr(type(G.SPARK), "hmac_hex", lambda self, ipad, opad, sid, t, o, salt: f"IF({salt} > 0, CAST(raise_error('salt') AS STRING), {plain(self, ipad, opad, sid, t, o, salt)})")
    r = mask(texts(spark, [("a", "ИНН 7707083893, почта ivan@company.ru")]), settings).first()
    assert len(r["entries"]) == 2 and "7707083893" not in r["masked_text"]


def test_unmask_with_entries_of_any_shape(spark, settings):
    """Outs of other shapes, one inside another, with characters of the regex language, over unions of runs of digits."""
    cases = [("a", "клиент №5!, <P 1><P 1>", {"клиент №5!": "A", "<P 1>": "B"}, "A, BB", 3),
             ("b", r"x \E[1] y", {r"\E[1]": "q$1"}, "x q$1 y", 1),
             ("c", "😀12 34 56 78 90 12 34", {"34 56 78 90": "A", "12 34": "B"}, "😀B 56 78 90 B", 2),
             ("d", "aXbXc", {"Xb": "1", "aXbX": "2", "X": "3"}, "2c", 1),
             ("e", "plain", {}, "plain", 0), ("f", None, {"X": "1"}, None, 0), ("g", "keep", {"": "1"}, "keep", 0)]
    df = spark.createDataFrame([(k, t, list(m.items())) for k, t, m, *_ in cases] + [("h", "null", None)], ENTRIES)
    got = {r["session_id"]: (r["unmasked_text"], r["tokens_replaced"]) for r in unmask_with_entries(df, settings, text="text").collect()}
    assert got == {k: (t, n) for k, _, _, t, n in cases} | {"h": ("null", 0)}


def test_estimates_of_compressed_files_broadcast_nothing(spark, customers):
    """Long texts around the narrow key of a small file are not taken for a small table."""
    c = Q._customers(spark, customers).select("c_custkey", F.repeat(F.lit("x"), 50000).alias("text"))
    plan = c.join(c.withColumnRenamed("text", "other"), "c_custkey")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("query, run", [("stream_sessions", "run_stream_unmask"), ("stream_mask", "run_stream_mask")])
def test_a_micro_batch_is_more_than_one_file(spark, customers, monkeypatch, query, run):
    class Seen(Exception):
        pass

    def stop(spark, path, *args, **kw):
        raise Seen(len(spark.read.parquet(path).inputFiles()))
    monkeypatch.setattr(Q, run, stop)
    with pytest.raises(Seen) as seen:
        Q.QUERIES[query](spark, customers if query == "stream_sessions" else "/root/testdata/sf0.001")
    assert seen.value.args[0] > 1


def test_chunks_are_cut_in_one_pass(spark):
    """No chunk is read from the beginning of its text; null and empty texts are one chunk."""
    from shroud.streaming.chunks import cut_chunks
    df = spark.createDataFrame([("a", "😀bcdefg\nhij"), ("b", ""), ("c", None), ("d", "abcd")], "session_id string, text string")
    cut = cut_chunks(df, size=F.lit(4))
    assert "substring(text" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, cut.collect()), key=lambda r: r[:2]) == [
        ("a", 0, "😀bcd", False), ("a", 1, "efg\n", False), ("a", 2, "hij", True), ("b", 0, "", True), ("c", 0, None, True), ("d", 0, "abcd", True)]


def test_order_texts_are_dealt_out(spark, monkeypatch):
    """The names in texts of orders are looked for in many tasks, whatever the joins before left."""
    monkeypatch.setattr(Q, "ROWS_PER_TASK", 50)
    assert Q._named_texts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 30
