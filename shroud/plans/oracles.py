"""DuckDB oracles for the registered queries (same keys).

They are written independently of the Spark code paths: regex hits with
offsets come from DuckDB's own ``regexp_extract_all``/``string_split_regex``;
carrier entities from segment lengths; round trips from the source columns;
marker numbers from window functions over the data.  Surrogate values use
the generator rules rendered for DuckDB (same fixed rules, other engine).
"""

from __future__ import annotations

from ..functions import surrogates as G
from . import carriers
from .queries import SETTINGS

D = G.DUCK


def _hits_sql(table: str, key: str, text: str, regex: str, extra_cols: str = "") -> str:
    return f"""
WITH h AS (
  SELECT {key}, regexp_extract_all({text}, '{regex}') AS hits, string_split_regex({text}, '{regex}') AS gaps
  FROM {table}
), e AS (
  SELECT {key}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM h WHERE len(hits) > 0
)
SELECT {key}{extra_cols},
  CAST(coalesce(list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g))), 0)
     + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda x: length(x))), 0) AS INTEGER) AS start,
  CAST(coalesce(list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g))), 0)
     + coalesce(list_sum(list_transform(list_slice(hits, 1, i), lambda x: length(x))), 0) AS INTEGER) AS "end",
  hits[i] AS original
FROM e"""


EMAIL_RE_DUCK = r"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}\b"


def _luhn_duck(d: str) -> str:
    return (f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
            f"CASE WHEN (length({d}) - i) % 2 = 1 THEN "
            f"(CASE WHEN 2 * CAST(substr({d}, i, 1) AS INTEGER) > 9 THEN 2 * CAST(substr({d}, i, 1) AS INTEGER) - 9 "
            f"ELSE 2 * CAST(substr({d}, i, 1) AS INTEGER) END) "
            f"ELSE CAST(substr({d}, i, 1) AS INTEGER) END)) % 10 = 0)")


def detect_card_luhn() -> str:
    parts = []
    for name, rx in (("CARD_SPACED", r"\b\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4}\b"),
                     ("CARD_AMEX", r"\b\d{4}[\s\-]\d{6}[\s\-]\d{5}\b"),
                     ("CARD_PLAIN", r"\b\d{13,19}\b")):
        q = _hits_sql("documents", "doc_id", "text", rx, f", '{name}' AS pattern")
        d = "regexp_replace(original, '[^0-9]', '', 'g')"
        parts.append(f"SELECT * FROM ({q}) WHERE length({d}) BETWEEN 13 AND 19 AND {_luhn_duck(d)}")
    return "\nUNION ALL\n".join(parts)


def _gen(ctype: str, orig: str, sid: str, salt: int = 0) -> str:
    ipad, opad = SETTINGS.hmac_pads()
    h = D.hmac_hex(ipad, opad, "sid", "t", "o", str(salt))
    return (f"(SELECT {G.dispatch(D)} FROM (SELECT *, {h} AS h FROM "
            f"(SELECT {sid} AS sid, '{ctype}' AS t, {orig} AS o)))")


def surrogate_values() -> str:
    seg = dict((k, v) for k, v in carriers.REQUISITE_SEGMENTS if k != "lit")
    extra = {
        "EMAIL": "('c' || CAST(c_custkey AS STRING) || '@mail.ru')",
        "CARD": "('4111 ' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || ' 1111 1111')",
    }
    parts = []
    for t in G.GENERATORS:
        o = extra.get(t) or seg[t]
        parts.append(f"SELECT c_custkey, '{t}' AS ctype, {o} AS o FROM customer")
    ipad, opad = SETTINGS.hmac_pads()
    h = D.hmac_hex(ipad, opad, "('s' || CAST(c_custkey AS STRING))", "ctype", "o", "0")
    return (f"WITH base AS ({' UNION ALL '.join(parts)}), hx AS (SELECT c_custkey, ctype AS t, o, {h} AS h FROM base) "
            f"SELECT c_custkey, t AS ctype, {G.dispatch(D)} AS out FROM hx")


def mask_requisites() -> str:
    markers = {"PERSON": "'[Имя 1]'", "ORG": "'[Организация 1]'", "ADDRESS": "'[Адрес 1]'"}
    text = carriers.text_sql()
    sid = "CAST(c_custkey AS STRING)"
    pieces = []
    for kind, expr in carriers.REQUISITE_SEGMENTS:
        if kind == "lit":
            pieces.append(expr)
        elif kind in markers:
            pieces.append(markers[kind])
        else:
            c0, c1 = _gen(kind, expr, sid, 0), _gen(kind, expr, sid, 1)
            pieces.append(f"(CASE WHEN contains({text}, {c0}) THEN {c1} ELSE {c0} END)")
    return f"SELECT c_custkey, {' || '.join(pieces)} AS masked_text FROM customer"


def marker_numbering() -> str:
    text = carriers.person_text_sql("c_custkey")
    return f"""
WITH p AS (
  SELECT CAST(c_nationkey AS STRING) AS session_id, c_custkey, {carriers.surname('c_custkey')} || ' П. П.' AS original
  FROM customer
), k AS (
  SELECT session_id, original, row_number() OVER (PARTITION BY session_id ORDER BY c_custkey) AS k FROM p
), taken AS (
  SELECT DISTINCT CAST(c_nationkey AS STRING) AS session_id, c_custkey % 5 + 1 AS n FROM customer WHERE c_custkey % 7 = 0
), nums AS (
  SELECT s.session_id, r.n FROM (SELECT DISTINCT session_id FROM p) s, range(1, 100000) r(n)
  WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.session_id = s.session_id AND t.n = r.n)
), free AS (
  SELECT session_id, n, row_number() OVER (PARTITION BY session_id ORDER BY n) AS k FROM nums
)
SELECT k.session_id, k.original, '[Имя ' || CAST(free.n AS STRING) || ']' AS out
FROM k JOIN free ON k.session_id = free.session_id AND k.k = free.k"""


PHONE_DUCK = r"(?:\+\d{1,3}[\s\-]?)?(?:\(\d{3}\)|\d{3})[\s\-]?\d{3}[\s\-]?\d{4}"


def detect_phone_number() -> str:
    # RE2 has no look-arounds: take the hits, then require that the character
    # before is not a word character or '+', and the one after not a word character.
    q = _hits_sql("documents", "doc_id", "text", PHONE_DUCK)
    return f"""
SELECT h.doc_id, h.start, h."end", h.original FROM ({q}) h JOIN documents d ON d.doc_id = h.doc_id
WHERE (h.start = 0 OR NOT regexp_matches(substr(d.text, h.start, 1), '[\\w+]'))
  AND (h."end" = length(d.text) OR NOT regexp_matches(substr(d.text, h."end" + 1, 1), '\\w'))"""


def context_boost() -> str:
    segs = carriers.BOOST_SEGMENTS
    def start(i):
        return "length(" + " || ".join(e for _, e in segs[:i]) + ")"
    rows = []
    for i, (kind, _expr) in enumerate(segs):
        if kind == "lit":
            continue
        inn_score = "1.0" if kind == "INN_A" else "0.75"
        rows.append(f"SELECT c_custkey, 'INN_10' AS pattern, CAST({start(i)} AS INTEGER) AS start, "
                    f"CAST({inn_score} AS DOUBLE) AS score FROM customer")
        rows.append(f"SELECT c_custkey, 'PASSPORT_NOSPACE' AS pattern, CAST({start(i)} AS INTEGER) AS start, "
                    f"CAST(0.7 AS DOUBLE) AS score FROM customer")
    return "\nUNION ALL\n".join(rows)


def _masked_pieces():
    markers = {"PERSON": "'[Имя 1]'", "ORG": "'[Организация 1]'", "ADDRESS": "'[Адрес 1]'"}
    text = carriers.text_sql()
    sid = "CAST(c_custkey AS STRING)"
    pieces = []
    for kind, expr in carriers.REQUISITE_SEGMENTS:
        if kind == "lit":
            pieces.append((kind, expr))
        elif kind in markers:
            pieces.append((kind, markers[kind]))
        else:
            c0, c1 = _gen(kind, expr, sid, 0), _gen(kind, expr, sid, 1)
            pieces.append((kind, f"(CASE WHEN contains({text}, {c0}) THEN {c1} ELSE {c0} END)"))
    return pieces


def masked_spans() -> str:
    pieces = _masked_pieces()
    columns = ", ".join(f"{expr} AS p{i}" for i, (_, expr) in enumerate(pieces))
    rows = []
    for i, (kind, _) in enumerate(pieces):
        if kind != "lit":
            before = " + ".join(f"length(p{j})" for j in range(i))
            rows.append(f"SELECT c_custkey, '{kind}' AS type, CAST({before} AS INTEGER) AS start, CAST({before} + length(p{i}) AS INTEGER) AS \"end\" FROM pieces")
    return f"WITH pieces AS MATERIALIZED (SELECT c_custkey, {columns} FROM customer) " + " UNION ALL ".join(rows)


def mask_hint() -> str:
    hint = SETTINGS.hint_text_ru.replace("'", "''")
    return f"""
SELECT c_custkey,
  CASE WHEN c_custkey % 2 = 0 THEN '{hint}' END AS hint,
  CASE WHEN c_custkey % 2 = 0 THEN '[Имя 1]' ELSE {_gen('INN', carriers._inn('c_custkey', 7919), 'CAST(c_custkey AS STRING)')} END AS first_out,
  CAST(CASE WHEN c_custkey % 2 = 1 THEN 4 WHEN c_custkey % 4 = 0 THEN length('{hint}') + 2 + 10 ELSE 10 END AS INTEGER) AS first_start
FROM customer"""


_NAMED = """(SELECT o_orderkey, s_name, n_name, c_name FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON s_suppkey = o_orderkey % (SELECT max(s_suppkey) + 1 FROM supplier) JOIN nation ON s_nationkey = n_nationkey)"""


def mask_gazetteer() -> str:
    # a single word in capitals is no name to the masker
    outs = iter(("'[Организация 1]'", "lower(n_name)", "upper(s_name)", "'[Имя 1]'"))
    return f"SELECT o_orderkey, {' || '.join(e if k == 'lit' else next(outs) for k, e in carriers.NAME_SEGMENTS)} AS masked_text FROM {_NAMED}"


def context_forms() -> str:
    segs = carriers.FORM_SEGMENTS
    return " UNION ALL ".join(f"SELECT c_custkey, CAST(length({' || '.join(e for _, e in segs[:i])}) AS INTEGER) AS start, CAST({0.7 if k == 'VIN_B' else 1.0} AS DOUBLE) AS score FROM customer"
                              for i, (k, _) in enumerate(segs) if k != "lit")


def type_rollup() -> str:
    hits = f"""SELECT doc_id, 'EMAIL' AS ctype FROM ({_hits_sql("documents", "doc_id", "text", EMAIL_RE_DUCK)}) UNION ALL SELECT doc_id, 'CARD' AS ctype FROM ({detect_card_luhn()})"""
    return f"SELECT lang, ctype, count(*) AS n, CAST(grouping(lang, ctype) AS INTEGER) AS level FROM ({hits}) JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, ctype)"


ORACLES = {
    "gazetteer_hits": carriers.expected_entities_sql(_NAMED, "o_orderkey", carriers.NAME_SEGMENTS),
    "mask_gazetteer": mask_gazetteer(),
    "tagged_names": f"""SELECT o_orderkey, ctype, start, "end" FROM ({carriers.expected_entities_sql(_NAMED, "o_orderkey", carriers.NAME_SEGMENTS)}) WHERE ctype <> 'LOC'""",
    "detect_phone_plan": f'SELECT c_custkey, start, "end", original FROM ({carriers.expected_entities_sql("customer", "c_custkey", carriers.PLAN_SEGMENTS)})',
    "context_forms": context_forms(),
    "type_rollup": type_rollup(),
    "detect_email": _hits_sql("documents", "doc_id", "text", EMAIL_RE_DUCK),
    "detect_card_luhn": detect_card_luhn(),
    "detect_requisites": carriers.expected_entities_sql("customer", "c_custkey"),
    "mask_requisites": mask_requisites(),
    "surrogate_values": surrogate_values(),
    "roundtrip_documents": "SELECT doc_id, text, CAST(0 AS INTEGER) AS still_clear FROM documents",
    "roundtrip_pages": "SELECT page_id, html, CAST(0 AS INTEGER) AS still_clear FROM pages",
    "type_counts_requisites": f"""
SELECT ctype, count(*) AS n FROM ({carriers.expected_entities_sql("customer", "c_custkey")}) GROUP BY ctype""",
    "language_routing": """
SELECT doc_id, 'default' AS setting, CAST(NULL AS VARCHAR) AS reason, false AS refused FROM documents
UNION ALL
SELECT doc_id, 'strict' AS setting, CASE WHEN lang IS NULL OR lang NOT IN ('ru', 'en') THEN 'unsupported_language' END AS reason,
       (lang IS NULL OR lang NOT IN ('ru', 'en')) AS refused FROM documents""",
    "session_expiry": "SELECT CAST(c_custkey AS VARCHAR) AS session_id, '[Имя 1]' AS out, 'Петров П. П.' AS original FROM customer",
    "roundtrip_conversations": f"SELECT conv_id, turn, {carriers.turn_text_sql()} AS text, CAST(0 AS INTEGER) AS still_clear, CAST(1 AS INTEGER) AS tokens_replaced FROM conversations",
    "unmask_sessions": "SELECT doc_id, text, CAST(0 AS INTEGER) AS still_clear FROM documents",
    "marker_numbering": marker_numbering(),
    "guard_rejections": f"""
SELECT CAST(c_nationkey AS STRING) AS session_id, c_custkey,
       CASE WHEN c_custkey % 3 = 0 THEN 'language_mismatch' ELSE 'contains_issued_token' END AS reason
FROM customer
WHERE c_custkey % 3 = 0
   OR (c_custkey % 3 = 1 AND CAST(c_nationkey AS STRING) IN (
         SELECT session_id FROM ({marker_numbering()}) WHERE out = '[Имя 1]'))""",
    "session_delete": """
SELECT CAST(n_nationkey AS STRING) AS session_id,
       EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS deleted
FROM nation n WHERE n_regionkey = 1
UNION ALL
SELECT 'gone-' || CAST(n_nationkey AS STRING) AS session_id, false AS deleted FROM nation WHERE n_regionkey = 1""",
    "session_stats": """
SELECT 'at_write' AS moment, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS active_sessions
FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT 'after_ttl' AS moment, CAST(0 AS BIGINT) AS active_sessions""",
    "ner_clip": """
SELECT s_suppkey, 'ORG' AS ctype, 'ООО ' || s_name AS original, 0 AS start,
       CAST(length('ООО ' || s_name) AS INTEGER) AS "end" FROM supplier
UNION ALL
SELECT s_suppkey, 'BIK' AS ctype, '04' || lpad(CAST(s_suppkey AS STRING), 7, '0') AS original,
       CAST(length('ООО ' || s_name || ' \n БИК ') AS INTEGER) AS start,
       CAST(length('ООО ' || s_name || ' \n БИК ') + 9 AS INTEGER) AS "end" FROM supplier""",
    "stream_unmask": "SELECT doc_id, coalesce(text, '') AS text, CAST(0 AS INTEGER) AS still_clear, CAST(0 AS BIGINT) AS open_replies FROM documents",
    "stream_sessions": f"""
SELECT c_custkey, seq, CASE WHEN seq = 0 THEN 'Договор с ' WHEN c_custkey % 3 = 2 THEN {carriers.surname('c_custkey')} || ' готов' ELSE 'я 1] готов' END AS unmasked_text,
       CASE WHEN seq = 1 AND c_custkey % 3 <> 2 THEN 'no_session' END AS reason, CAST(0 AS BIGINT) AS open_replies
FROM customer, (SELECT unnest([0, 1])::BIGINT AS seq)""",
    "stream_mask": f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, {carriers.turn_text_sql()} AS text, CAST(0 AS INTEGER) AS still_clear, CAST(1 AS BIGINT) AS outs FROM conversations",
    "unmask_imported": """
SELECT c_custkey, '😀 INN-' || c_custkey || ' and Client ' || c_custkey || ', P' || c_custkey || 'P' || c_custkey || ' <Person 2>' AS text, CAST(4 AS INTEGER) AS tokens_replaced,
       CASE WHEN c_custkey % 2 = 0 THEN 'contains_issued_token' END AS reason FROM customer""",
    "store_log": """
WITH n AS (SELECT DISTINCT c_nationkey AS k, CAST(c_nationkey AS VARCHAR) AS session_id FROM customer
           UNION SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1),
     g AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1),
     e AS (SELECT c_nationkey AS k, c_custkey % 2 AS odd, count(*) AS c FROM customer GROUP BY ALL),
     s AS (SELECT n.k, session_id, n.k IN (SELECT k FROM g) AS back, session_id < '2' AS renewed FROM n)
SELECT session_id, CASE WHEN back THEN 'en' ELSE 'ru' END AS language, t AS tokens_total, t AS outs
FROM (SELECT *, CAST(coalesce((SELECT sum(c) FROM e WHERE e.k = s.k AND (odd = 1 OR NOT back)), 0) AS BIGINT) AS t FROM s) WHERE back OR renewed""",
    "detect_phone_number": detect_phone_number(),
    "context_boost": context_boost(),
    "masked_spans": masked_spans(),
    "unmask_counts": f"SELECT c_custkey, {carriers.text_sql()} || ' / ' || {carriers.text_sql()} AS text, "
                     f"CAST(24 AS INTEGER) AS tokens_replaced FROM customer",
    "mask_hint": mask_hint(),
}
