"""Builders for injected spans: the stand-ins for NER and analyzer output."""

TEXTS = "session_id string, seq long, text string, language string, prepend_hint boolean"
SPANS = "session_id string, seq long, start int, end int, entity_type string, score double, idx int"


def texts(spark, rows):
    """rows: (session_id, text[, language[, prepend_hint]])"""
    full = []
    for i, r in enumerate(rows):
        sid, text = r[0], r[1]
        lang = r[2] if len(r) > 2 else "ru"
        hint = r[3] if len(r) > 3 else False
        full.append((sid, 0, text, lang, hint))
    return spark.createDataFrame(full, TEXTS)


def spans(spark, rows):
    """rows: (session_id, start, end, entity_type[, score])"""
    full = []
    for i, r in enumerate(rows):
        score = r[4] if len(r) > 4 else 0.9
        full.append((r[0], 0, r[1], r[2], r[3], float(score), i))
    return spark.createDataFrame(full or [], SPANS)


def by_session(rows, key="session_id"):
    return {r[key]: r for r in rows}
