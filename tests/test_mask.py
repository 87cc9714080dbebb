"""Masking with injected spans (stub NER / analyzer), ported fixture cases."""

import re

import pytest

from shroud import config as C
from shroud.operators.mask import mask
from tests.helpers import by_session, spans, texts


def entry_for(row, original):
    return next(e for e in row["entries"] if e["original"] == original)


@pytest.fixture(scope="module")
def injected(spark, settings):
    t = texts(spark, [
        ("per", "Иванов Иван пришёл"),
        ("org", "Сотрудник ООО Ромашка уволен"),
        ("addr", "адрес: г. Москва, ул. Мира, д. 5, кв. 25"),
        ("two", "Иванов и Петров"),
        ("clip", "ООО Ромашка \n БИК: 044525000"),
        ("skip", "[Имя 1] и Петров"),
        ("phone", "Звоните на +79991234567"),
        ("inn", "ИНН 772512345678"),
        ("pass", "паспорт серии 4511 № 654321"),
        ("card", "card 4111111111111111", "en"),
        ("call", "call +12025550143", "en"),
        ("acct", "счёт 40702810000000000111 и снова 40702810000000000111"),
        ("spans", "Петров звонил на +79991234567"),
        ("empty", ""),
        ("nopii", "Сегодня хорошая погода"),
        ("dup", "ООО Ромашка"),
        ("john", "John Smith called", "en"),
        ("custom", "ИНН 7707083893"),
        ("hint", "Иванов пришёл", "ru", True),
        ("hint_none", "ИНН 772512345678", "ru", True),
        ("en_skip_ner", "Hello world", "en"),
    ])
    ner = spans(spark, [
        ("per", 0, 11, "PER"), ("org", 10, 21, "ORG"), ("two", 0, 6, "PER"), ("two", 9, 15, "PER"),
        ("clip", 0, len("ООО Ромашка \n БИК"), "ORG"), ("skip", 10, 16, "PER"), ("spans", 0, 6, "PER"),
        ("dup", 0, 11, "ORG"), ("hint", 0, 6, "PER"), ("en_skip_ner", 0, 5, "PER"),
    ])
    a = "адрес: г. Москва, ул. Мира, д. 5, кв. 25"
    acct = "счёт 40702810000000000111 и снова 40702810000000000111"
    pat = spans(spark, [
        ("addr", a.index("г."), len(a), "ADDRESS_RU"), ("phone", 11, 23, "PHONE_RU"), ("inn", 4, 16, "INN_RU"),
        ("pass", 14, 27, "PASSPORT_RU"), ("card", 5, 21, "CREDIT_CARD"), ("call", 5, 17, "PHONE_NUMBER"),
        ("acct", 5, 25, "ACCOUNT_RU"), ("acct", acct.rindex("4070"), acct.rindex("4070") + 20, "ACCOUNT_RU"),
        ("spans", 17, 29, "PHONE_RU"), ("dup", 0, 11, "ORG"), ("john", 0, 10, "PERSON"),
        ("custom", 4, 14, "INN_RU", 0.85), ("custom", 4, 14, "PHONE_NUMBER", 0.85),
        ("hint_none", 4, 16, "INN_RU"),
    ])
    m = mask(t, settings, ner_spans=ner, pattern_spans=pat, detectors=False, ner="none")
    return by_session(m.collect())


def test_person_marker(injected):
    r = injected["per"]
    assert r["masked_text"] == "[Имя 1] пришёл"
    e = entry_for(r, "Иванов Иван")
    assert (e["out"], e["ctype"], e["kind"], e["idx"]) == ("[Имя 1]", "PERSON", "marker", 1)
    assert "PERSON" in r["entities_found"]


def test_org_and_address_markers(injected):
    assert entry_for(injected["org"], "ООО Ромашка")["out"] == "[Организация 1]"
    assert entry_for(injected["addr"], "г. Москва, ул. Мира, д. 5, кв. 25")["out"] == "[Адрес 1]"
    assert "ул. Мира" not in injected["addr"]["masked_text"]


def test_counter_increments(injected):
    assert injected["two"]["masked_text"] == "[Имя 1] и [Имя 2]"


def test_ner_span_clipped_at_newline(injected):
    r = injected["clip"]
    assert r["masked_text"] == "[Организация 1] \n БИК: 044525000"


def test_marker_collision_with_text_skips_number(injected):
    assert injected["skip"]["masked_text"] == "[Имя 1] и [Имя 2]"


def test_surrogate_formats(injected):
    e = entry_for(injected["phone"], "+79991234567")
    assert e["ctype"] == "PHONE" and e["kind"] == "surrogate"
    assert re.fullmatch(r"\+7 9\d{2} 555-\d{2}-\d{2}", e["out"])
    inn = entry_for(injected["inn"], "772512345678")["out"]
    assert len(inn) == 12 and inn.isdigit() and inn != "772512345678"
    assert re.fullmatch(r"\d{4} \d{6}", entry_for(injected["pass"], "4511 № 654321")["out"])


def test_canonicalisation(injected):
    assert entry_for(injected["card"], "4111111111111111")["ctype"] == "CARD"
    assert entry_for(injected["call"], "+12025550143")["ctype"] == "PHONE"


def test_same_original_one_entry(injected):
    r = injected["acct"]
    accts = [e for e in r["entries"] if e["ctype"] == "ACCOUNT"]
    assert len(accts) == 1
    assert r["masked_text"].count(accts[0]["out"]) == 2


def test_masked_spans_cut_outs(injected):
    r = injected["spans"]
    outs = {e["ctype"]: e["out"] for e in r["entries"]}
    for sp in r["masked_spans"]:
        assert r["masked_text"][sp["start"]:sp["end"]] == outs[sp["type"]]
    assert r["masked_text"].startswith("[Имя 1] звонил на ")


def test_empty_and_no_pii(injected):
    for k, text in (("empty", ""), ("nopii", "Сегодня хорошая погода")):
        r = injected[k]
        assert r["masked_text"] == text and r["entries"] == [] and r["entities_found"] == []
        assert r["masked_spans"] == [] and r["hint"] is None


def test_ner_beats_pattern(injected):
    r = injected["dup"]
    assert len(r["entries"]) == 1 and r["masked_text"] == "[Организация 1]"


def test_english_person_label(injected):
    assert injected["john"]["masked_text"] == "[Name 1] called"


def test_custom_beats_builtin(injected):
    r = injected["custom"]
    assert len(r["entries"]) == 1 and r["entries"][0]["ctype"] == "INN"


def test_hint_and_prepend(injected, settings):
    r = injected["hint"]
    assert r["hint"] == settings.hint_text_ru and "[Имя N]" in r["hint"]
    assert r["masked_text"].startswith(r["hint"] + "\n\n")
    sp = r["masked_spans"][0]
    assert r["masked_text"][sp["start"]:sp["end"]] == "[Имя 1]"
    n = injected["hint_none"]
    assert n["hint"] is None and not n["masked_text"].startswith("Примечание")


def test_english_ignores_ner_spans(injected):
    assert injected["en_skip_ner"]["masked_text"] == "Hello world"


def test_existing_entries_continue_counter(spark, settings):
    from pyspark.sql import functions as F

    from shroud.operators.mask import ENTRY_TYPE, mask_prepared, prepare
    t = texts(spark, [("s", "Сидоров пришёл"), ("r", "Иванов здесь")])
    ner = spans(spark, [("s", 0, 7, "PER"), ("r", 0, 6, "PER")])
    p = prepare(t, settings, ner_spans=ner, detectors=False, ner="none")
    prev = F.expr(
        f"CAST(CASE WHEN session_id = 's' THEN array(named_struct('ctype','PERSON','original','Петров','out','[Имя 5]',"
        f"'kind','marker','idx',5,'ord',0,'new',false)) ELSE array(named_struct('ctype','PERSON','original','Иванов',"
        f"'out','[Имя 1]','kind','marker','idx',1,'ord',0,'new',false)) END AS {ENTRY_TYPE})")
    out = by_session(mask_prepared(p, settings, prev).collect())
    assert out["s"]["masked_text"] == "[Имя 6] пришёл"
    assert out["r"]["masked_text"] == "[Имя 1] здесь" and out["r"]["entries"] == []


def test_no_row_is_lost_by_its_language(spark, settings):
    t = texts(spark, [("x", "mail a@b.org, ИНН", "fr"), ("y", "текст", "ru"), ("z", "mail a@b.org", None)])
    out = by_session(mask(t, settings).collect())
    assert set(out) == {"x", "y", "z"} and all(r["reason"] is None for r in out.values())
    assert out["x"]["entities_found"] == ["EMAIL"] and out["z"]["entities_found"] == ["EMAIL"]
    out = by_session(mask(t, settings.with_(other_languages=None)).collect())
    assert {k: (r["reason"], r["masked_text"]) for k, r in out.items()} == {
        "x": ("unsupported_language", None), "y": (None, "текст"), "z": ("unsupported_language", None)}


def test_nothing_is_cut_short(spark, settings):
    region = "далёкая большая северная новая дальняя Московская обл., "
    org = "ООО «" + "очень " * 40 + "длинное имя»"
    t = texts(spark, [("a", f"проживает по адресу, {region}г. Химки, ул. Мира, д. 5"), ("v", "машина xta21099043234567 тут"),
                      ("w", "vin ABCDEFGHJKLMNPRST тут"), ("o", f"это {org} тут"), ("l", "слово " * 20_000)])
    out = by_session(mask(t, settings).collect())
    assert out["a"]["masked_text"] == "проживает по адресу, [Адрес 1]"
    assert out["v"]["entities_found"] == ["VIN"] and "xta21099043234567" not in out["v"]["masked_text"]
    assert out["w"]["entities_found"] == ["VIN"]
    assert out["o"]["masked_text"] == "это [Организация 1] тут"
    assert out["l"]["entities_found"] == []


def test_own_type_is_masked_or_refused(spark, settings):
    from shroud.functions.patterns import REGISTRY, add_recognizer
    from shroud.operators.sessions import mask_sessions
    registry = (*REGISTRY, add_recognizer("EMP_ID", "EMP", r"EMP-\d{6}", 0.9))
    t = texts(spark, [("s", "badge EMP-123456", "en")])
    own = settings.with_(marker_types=C.MARKER_TYPES + ("EMP_ID",), marker_labels_ru={**C.MARKER_LABELS_RU, "EMP_ID": "Табель"},
                         marker_labels_en={**C.MARKER_LABELS_EN, "EMP_ID": "Badge"})
    assert mask(t, own, registry=registry).collect()[0]["masked_text"] == "badge [Badge 1]"
    assert mask_sessions(t, own, registry=registry).masked.collect()[0]["masked_text"] == "badge [Badge 1]"
    with pytest.raises(Exception, match="EMP_ID"):
        mask(t, settings, registry=registry).select("masked_text").collect()
    with pytest.raises(Exception, match="EMP_ID"):
        mask_sessions(t, settings, registry=registry).masked.collect()


def test_tagger_hook_feeds_masking(spark, settings):
    from shroud.operators.ner import tagger_spans

    def factory():
        import re

        import pandas as pd

        def tag(pdf):
            rows = [(s, q, m.start(), m.end(), "PER") for s, q, t in zip(pdf.session_id, pdf.seq, pdf.text)
                    for m in re.finditer("Иванов", t)]
            return pd.DataFrame(rows, columns=["session_id", "seq", "start", "end", "entity_type"])
        return tag

    t = texts(spark, [("t1", "Звонил Иванов, потом снова Иванов"), ("t2", "никого")])
    ner = tagger_spans(t, factory)
    out = by_session(mask(t, settings, ner_spans=ner, detectors=False, ner="none").collect())
    assert out["t1"]["masked_text"] == "Звонил [Имя 1], потом снова [Имя 1]"
    assert out["t2"]["masked_text"] == "никого"
