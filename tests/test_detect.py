"""Real detectors on the fixture strings."""

import pytest

from shroud.functions import patterns as P
from shroud.operators.detect import detect_spans
from tests.helpers import texts


@pytest.fixture(scope="module")
def hits(spark, settings):
    rows = [
        ("acct_no_phone", "40702810000000000111"),
        ("phone1", "+7 (495) 123-45-67"),
        ("phone2", "89001234567"),
        ("acct", "счёт 40702810000000000111"),
        ("bik_none", "номер 123456789"),
        ("bik", "БИК 044525225"),
        ("kpp_none", "идентификатор 230801001"),
        ("kpp", "КПП: 230801001"),
        ("both", "КПП 230801001, БИК 044525225"),
        ("third", "КПП 230801001, БИК 044525225 и 230801002"),
        ("addr1", "г. Москва, ул. Мира, д. 5, кв. 25"),
        ("addr2", "Московская обл., г. Химки, ш. Ленинградское, д. 1"),
        ("addr3", "ул. Пушкина, д. 10"),
        ("addr4", "проспект Ленина, 12"),
        ("pass1", "4511 654321"), ("pass2", "4511654321"), ("pass3", "4511 № 654321"),
        ("pass4", "серия 4511 номер 654321"), ("pass5", "серии 4511 номер 654321"),
        ("pass6", "4511 серии 654321"), ("pass7", "серии 03 10 № 123456"),
        ("card1", "4111 1111 1111 1111"), ("card2", "4111-1111-1111-1111"), ("card3", "4111111111111111"),
        ("card4", "3714 496353 98431"), ("card_bad", "4111111111111112"),
        ("emoji", "😀 ИНН 7707083893"),
        ("vin_word", "ABCDEFGHJKLMNPRST"),
        ("vin", "VIN 1HGBH41JXMN109186"),
    ]
    t = texts(spark, rows)
    d = detect_spans(t, settings).collect()
    out = {}
    for r in d:
        out.setdefault(r["session_id"], []).append(r)
    return out


def types(hits, k):
    return {r["entity_type"] for r in hits.get(k, [])}


def test_phone_not_inside_account(hits):
    assert "PHONE_RU" not in types(hits, "acct_no_phone")
    assert "PHONE_RU" in types(hits, "phone1") and "PHONE_RU" in types(hits, "phone2")


def test_account(hits):
    a = [r for r in hits["acct"] if r["entity_type"] == "ACCOUNT_RU"]
    assert len(a) == 1 and a[0]["end"] - a[0]["start"] == 20


def test_bik_kpp_need_left_context(hits):
    assert "BIK_RU" not in types(hits, "bik_none")
    b = [r for r in hits["bik"] if r["entity_type"] == "BIK_RU"]
    assert [(r["start"], r["end"]) for r in b] == [(4, 13)]
    assert "KPP_RU" not in types(hits, "kpp_none") and "KPP_RU" in types(hits, "kpp")


def test_bik_kpp_no_cross_firing(hits):
    for k in ("both", "third"):
        bik = [r["original"] for r in hits[k] if r["entity_type"] == "BIK_RU"]
        kpp = [r["original"] for r in hits[k] if r["entity_type"] == "KPP_RU"]
        assert bik == ["044525225"] and kpp == ["230801001"]


def test_address_patterns(hits):
    for k in ("addr1", "addr2", "addr3", "addr4"):
        assert "ADDRESS_RU" in types(hits, k), k


def test_passport_formats(hits):
    for k in ("pass1", "pass2", "pass3", "pass4", "pass5", "pass6", "pass7"):
        assert "PASSPORT_RU" in types(hits, k), k
    labeled = [r for r in hits["pass4"] if r["pattern"] == "PASSPORT_LABELED"]
    assert labeled and labeled[0]["original"] == "серия 4511 номер 654321"


def test_card_formats_and_luhn(hits):
    for k in ("card1", "card2", "card3", "card4"):
        c = [r for r in hits[k] if r["entity_type"] == "CARD"]
        assert c and all(r["score"] == 1.0 for r in c), k
    assert "CARD" not in types(hits, "card_bad")


def test_code_point_offsets_after_emoji(hits):
    inn = [r for r in hits["emoji"] if r["entity_type"] == "INN_RU"]
    assert [(r["start"], r["end"], r["original"]) for r in inn] == [(6, 16, "7707083893")]


def test_vin_needs_digit(hits):
    assert "VIN" not in types(hits, "vin_word")
    assert "VIN" in types(hits, "vin")


def test_context_boost_raises_score(hits):
    inn = [r for r in hits["emoji"] if r["entity_type"] == "INN_RU"][0]
    assert inn["score"] == 1.0   # 0.75 + context "инн"


def test_language_routing():
    ru = {p.entity_type for p in P.patterns_for("ru")}
    en = {p.entity_type for p in P.patterns_for("en")}
    assert "PHONE_RU" in ru and "PHONE_NUMBER" not in ru and "PERSON" not in ru
    assert {"PHONE_NUMBER", "PERSON", "CARD", "VIN", "EMAIL_ADDRESS"} <= en
    assert not ({"INN_RU", "BIK_RU", "KPP_RU", "ACCOUNT_RU"} & en)
    assert {"INN_RU", "OGRN_RU", "EMAIL_ADDRESS", "PASSPORT_RU", "SNILS_RU", "ADDRESS_RU", "CARD",
            "CREDIT_CARD", "VIN", "ACCOUNT_RU", "BIK_RU", "KPP_RU"} <= ru


def test_user_recognizer_with_context_and_validator(spark, settings):
    """A registry row added by the user runs like the built-in ones."""
    from shroud.operators.detect import detect_spans, patterns_table
    extra = (
        P.add_recognizer("TICKET", "TICKET_8", r"\bTK-\d{8}\b", 0.6, context=["билет"], context_required=True),
        P.add_recognizer("CARD", "CARD_DOTTED", r"\b\d{4}\.\d{4}\.\d{4}\.\d{4}\b", 0.5, validator="card"),
    )
    from pyspark.sql import functions as F
    t = texts(spark, [("u1", "билет TK-12345678, а TK-87654321 без пометки, карта 4111.1111.1111.1111 и 4111.1111.1111.1112")])
    rows = detect_spans(t, settings, registry=P.REGISTRY + extra, entity_types={"TICKET", "CARD"}).collect()
    got = sorted((r["pattern"], r["original"], round(r["score"], 6)) for r in rows)
    assert ("TICKET_8", "TK-12345678", 0.95) in got       # required context also boosts
    assert not any(o == "TK-87654321" for _, o, _ in got)
    assert ("CARD_DOTTED", "4111.1111.1111.1111", 1.0) in got
    assert not any(o.endswith("1112") for _, o, _ in got)
    assert patterns_table(spark, "en").filter(F.col("name") == "VIN").count() == 1
