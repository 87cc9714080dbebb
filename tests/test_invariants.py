"""Invariants over the supplied documents (sf0.001) and the driver contract."""

import pytest
from pyspark.sql import functions as F

from shroud.operators.mask import mask
from shroud.operators.unmask import unmask_with_entries
from shroud.plans.queries import _docs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def masked(spark, settings):
    m = unmask_with_entries(mask(_docs(spark, SF).repartition(8, "seq"), settings), settings)
    return m.collect()


def test_roundtrip(masked):
    assert all(r["unmasked_text"] == r["text"] for r in masked)
    assert sum(len(r["entries"]) for r in masked) > 0


def test_spans_cut_outs_and_are_disjoint(masked):
    for r in masked:
        outs = {e["out"] for e in r["entries"]}
        prev_end = -1
        for sp in r["masked_spans"]:
            assert r["masked_text"][sp["start"]:sp["end"]] in outs
            assert sp["start"] >= prev_end
            prev_end = sp["end"]


def test_no_original_left(masked):
    for r in masked:
        for e in r["entries"]:
            if e["kind"] == "surrogate":
                assert e["original"] not in r["masked_text"]


def test_mask_twice_same_outs(spark, settings, masked):
    again = {r["seq"]: r["entries"] for r in mask(_docs(spark, SF), settings).collect()}
    for r in masked:
        assert [e["out"] for e in again[r["seq"]]] == [e["out"] for e in r["entries"]]


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "masked_text" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
