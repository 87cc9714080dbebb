"""Masking (T1-T3, T7, T8, W1-W4, A2, F13, F15, G14) for texts that are
their own session, or that carry their session's earlier entries as an array
column.  Everything runs inside the row: no shuffle, no Python worker.

Per text:
1. NER spans (ru only) and pattern hits -> resolved, ordered spans (ord).
2. Allocation fold in ``ord`` order: an existing (type, original) reuses its
   out; a marker type takes the next free number (skipping numbers whose
   marker text is in the text); a surrogate type takes the first salt whose
   candidate is neither in the text nor related by containment to an out
   already issued.  A salt's candidate is computed when all before it are
   taken, a wider range after salts 0..K-1, and exhausting that raises an
   error (the reference loops for ever there).
3. Rewrite left to right, skipping a span that starts before the cursor; the
   masked spans carry offsets into the masked text.

Multi-text sessions whose earlier entries are not small go through
:mod:`shroud.operators.sessions`, which distributes the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import surrogates as G
from ..functions.patterns import REGISTRY
from ..functions.spans import SPAN_TYPE, empty_spans, explode_rows
from .detect import pattern_hits
from .ner import NER_TYPE, clip_and_filter, collect_injected, resolve_ner_overlaps, rule_ner, sort_by_start
from .resolve import ordered_spans

ENTRY_FIELDS = "ctype:string,original:string,out:string,kind:string,idx:int,ord:int,new:boolean"
ENTRY_TYPE = f"array<struct<{ENTRY_FIELDS}>>"
MSPAN_TYPE = "array<struct<start:int,end:int,type:string>>"


def sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _label_sql(s: C.Settings, ctype_sql: str, lang_sql: str = "language") -> str:
    whens = " ".join(
        f"WHEN {sql_str(t)} THEN IF({lang_sql} = 'en', {sql_str(s.marker_labels_en.get(t, t))}, "
        f"{sql_str(s.marker_labels_ru.get(t, t))})" for t in s.marker_types)
    return f"CASE {ctype_sql} {whens} ELSE {ctype_sql} END"


def taken_col(t: str) -> str:
    return f"_taken_{t}"


def _taken_expr(s: C.Settings, t: str, text: str, lang: str) -> Column:
    """Marker numbers of type ``t`` already written in the text (sorted)."""
    import re as _re

    def nums(label: str) -> Column:
        rx = _re.escape(s.marker_open) + _re.escape(label) + " ([1-9][0-9]{0,8})" + _re.escape(s.marker_close)
        found = F.regexp_extract_all(F.col(text), F.lit(rx), 1)
        return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))
    empty = F.array().cast("array<int>")
    has_open = F.coalesce(F.col(text).contains(s.marker_open), F.lit(False))
    en = nums(s.marker_labels_en.get(t, t))
    ru = nums(s.marker_labels_ru.get(t, t))
    return F.when(~has_open, empty).when(F.col(lang) == "en", en).otherwise(ru)


def allocation_sql(s: C.Settings, spans: str = "spans", prev: str = "_prev", text: str = "text",
                   sid: str = "session_id", lang: str = "language") -> str:
    """The T1/W1/G14 fold as Spark SQL (one expression per row)."""
    marker_types = ", ".join(sql_str(t) for t in s.marker_types)
    taken = "CASE x.ctype " + " ".join(
        f"WHEN {sql_str(t)} THEN tk.{taken_col(t)}" for t in s.marker_types) + " END"
    cur = ("coalesce(array_max(transform(filter(acc, e -> e.kind = 'marker' AND e.ctype = x.ctype), "
           "e -> e.idx)), 0)")
    next_idx = f"aggregate(filter({taken}, tn -> tn > {cur}), {cur} + 1, (i, tn) -> IF(tn = i, i + 1, i))"
    marker = G.marker_text(s.marker_open, _label_sql(s, "x.ctype", lang), "i", s.marker_close)
    ok = (f"NOT contains({text}, c) AND NOT exists(acc, e -> e.out = c OR contains(e.out, c) "
          f"OR contains(c, e.out))")

    def first_free(salt_from: int, salt_to: int) -> str:
        """The first of these salts' candidates that is free; those after it are not computed."""
        cand = G.candidate_sql(s, sid, "x.ctype", "x.original", "s")
        return (f"aggregate(sequence({salt_from}, {salt_to - 1}), CAST(NULL AS STRING), (found, s) -> IF(found IS NOT NULL, found, "
                f"transform(array({cand}), c -> IF({ok}, c, CAST(NULL AS STRING)))[0]))")
    k = s.surrogate_candidates
    surrogate_out = (f"coalesce({first_free(0, k)}, {first_free(k, k + s.surrogate_fallback_candidates)}, "
                     f"raise_error(concat('no free surrogate for type ', x.ctype)))")
    return (
        f"aggregate({spans}, {prev}, (acc, x) -> CASE "
        f"WHEN exists(acc, e -> e.ctype = x.ctype AND e.original = x.original) THEN acc "
        f"WHEN x.ctype IN ({marker_types}) THEN concat(acc, transform(array({next_idx}), i -> "
        f"named_struct('ctype', x.ctype, 'original', x.original, 'out', {marker}, 'kind', 'marker', "
        f"'idx', i, 'ord', x.ord, 'new', true))) "
        f"ELSE concat(acc, array(named_struct('ctype', x.ctype, 'original', x.original, 'out', "
        f"{surrogate_out}, 'kind', 'surrogate', 'idx', CAST(NULL AS INT), 'ord', x.ord, 'new', true))) END)"
    )


def rewrite_sql(spans: str = "_spans_out", text: str = "text") -> str:
    """T2 + W2/W3 + F13: left-to-right assembly and offsets in the output."""
    return (
        f"aggregate(array_sort({spans}, (a, b) -> CASE WHEN a.start < b.start THEN -1 WHEN a.start > b.start THEN 1 "
        f"WHEN a.ord < b.ord THEN -1 WHEN a.ord > b.ord THEN 1 ELSE 0 END), "
        f"named_struct('cur', 0, 'np', 0, 'parts', CAST(array() AS ARRAY<STRING>), 'ms', CAST(array() AS {MSPAN_TYPE})), "
        f"(acc, x) -> IF(x.start < acc.cur, acc, named_struct("
        f"'cur', x.end, "
        f"'np', acc.np + (x.start - acc.cur) + length(x.out), "
        f"'parts', concat(acc.parts, array(substring({text}, acc.cur + 1, x.start - acc.cur), x.out)), "
        f"'ms', concat(acc.ms, array(named_struct('start', acc.np + (x.start - acc.cur), "
        f"'end', acc.np + (x.start - acc.cur) + length(x.out), 'type', x.ctype))))), "
        f"acc -> named_struct('masked', concat(array_join(acc.parts, ''), substring({text}, acc.cur + 1)), "
        f"'spans', acc.ms))"
    )


def detector_set(language: Column, s: C.Settings) -> Column:
    """The detector set of a row's language: its own for ru and en, ``other_languages`` for any other and for null."""
    return F.when(language.isin(*C.SUPPORTED_LANGUAGES), language).otherwise(F.lit(s.other_languages))


def injected_pattern_array(df: DataFrame, spans: DataFrame, keys) -> DataFrame:
    """Injected analyzer results (stub or external) as the pattern-hit array."""
    custom = F.col("entity_type").isin(*sorted(C.CUSTOM_ENTITY_TYPES))
    src = spans.withColumn("_custom", custom)
    idx = F.col("idx") if "idx" in spans.columns else F.lit(0)
    elem = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                    F.col("entity_type").alias("etype"), F.col("score").cast("double").alias("score"),
                    F.col("_custom").alias("custom"), idx.cast("int").alias("prio"),
                    F.lit("injected").alias("pattern"))
    grouped = src.groupBy(*keys).agg(F.collect_list(elem).alias("_pat_in"))
    return df.join(grouped, list(keys), "left")


def prepare(texts: DataFrame, s: C.Settings, *, ner_spans: DataFrame | None = None,
            pattern_spans: DataFrame | None = None, detectors: bool = True, ner: str = "rule",
            keys=("session_id", "seq"), registry=REGISTRY) -> DataFrame:
    """Detection + resolution: adds ``spans`` (ordered, with ctype/original/ord).

    NER spans are ``ner_spans`` if given, else the rules' (``ner="rule"``); with ``ner="both"`` these and those, the longest first."""
    df = texts
    if "prepend_hint" not in df.columns:
        df = df.withColumn("prepend_hint", F.lit(False))
    if "language" not in df.columns:
        df = df.withColumn("language", F.lit("ru"))
    text, lang = F.col("text"), detector_set(F.col("language"), s)
    empty_ner = F.array().cast(NER_TYPE)
    if ner_spans is not None:
        df = collect_injected(df, ner_spans, "_ner_in", keys)
        ner_raw = F.coalesce(F.col("_ner_in"), empty_ner)
        if ner == "both":
            ner_raw = resolve_ner_overlaps(F.concat(ner_raw, rule_ner(text)))
    elif ner == "rule":
        ner_raw = rule_ner(text)
    else:
        ner_raw = empty_ner
    ner_arr = F.when(lang == "ru", sort_by_start(clip_and_filter(text, ner_raw))).otherwise(empty_ner)
    pat = pattern_hits(text, lang, s, registry) if detectors else empty_spans()
    if pattern_spans is not None:
        df = injected_pattern_array(df, pattern_spans, keys)
        pat = F.concat(pat, F.coalesce(F.col("_pat_in"), empty_spans()))
    spans = ordered_spans(text, ner_arr, pat)
    if registry is not REGISTRY or pattern_spans is not None:
        # types that come from outside: one that no setting routes must not stay in clear
        spans = F.transform(spans, lambda x: F.when(x["ctype"].isin(*C.routed_types(s)), x).otherwise(F.raise_error(
            F.concat(F.lit("no setting routes the entity type "), x["ctype"])).cast("struct<start:int,end:int,ctype:string,original:string,ord:int,src:string>")))
    df = df.withColumn("spans", spans)
    return df.drop(*[c for c in ("_ner_in", "_pat_in") if c in df.columns])


def mask_prepared(df: DataFrame, s: C.Settings, prev: Column | None = None) -> DataFrame:
    """Allocation + rewrite over prepared rows (``spans`` present).

    The whole chain is one expression whose stages are bound to lambda
    variables (``tk`` taken numbers, ``sp`` spans, ``ent``
    entries, ``so`` spans with outs).  Catalyst inlines a column referenced
    once into a lambda, where it would then run once per array element; a
    lambda variable cannot be inlined, so every stage runs once per row."""
    taken = F.struct(*[_taken_expr(s, t, "text", "language").alias(taken_col(t)) for t in s.marker_types])
    df = df.withColumn("_tk", taken)
    df = df.withColumn("_prev", prev if prev is not None else F.array().cast(ENTRY_TYPE))
    chain = (
        f"transform(array(_tk), tk -> "
        f"transform(array(spans), sp -> "
        f"transform(array({allocation_sql(s, spans='sp')}), ent -> "
        f"transform(array(transform(sp, x -> named_struct('start', x.start, 'end', x.end, 'ctype', x.ctype, "
        f"'ord', x.ord, 'out', get(filter(ent, e -> e.ctype = x.ctype AND e.original = x.original), 0).out))), "
        f"so -> named_struct('fin', {finish_sql(s, 'so')}, 'entries', filter(ent, e -> e.new), "
        f"'entities_found', array_distinct(transform(sp, x -> x.ctype))))[0])[0])[0])[0]")
    df = df.withColumn("_m", F.when(F.col("reason").isNull(), F.expr(chain)) if "reason" in df.columns else F.expr(chain))
    df = (df.withColumn("hint", F.col("_m.fin.hint"))
            .withColumn("masked_text", F.col("_m.fin.masked_text"))
            .withColumn("masked_spans", F.col("_m.fin.masked_spans"))
            .withColumn("entities_found", F.col("_m.entities_found"))
            .withColumn("ttl", F.lit(s.mapping_ttl))
            .withColumn("entries", F.col("_m.entries")))
    return df.drop("_tk", "_prev", "_m")


def finish_sql(s: C.Settings, spans_out: str = "_spans_out") -> str:
    """Rewrite + hint (T7/F15) + prepend (T8) as one let-bound expression:
    every stage is evaluated once per row, whatever the optimizer inlines."""
    marker_types = ", ".join(sql_str(t) for t in s.marker_types)
    hint = f"IF(language = 'en', {sql_str(s.hint_text_en)}, {sql_str(s.hint_text_ru)})"
    return (
        f"transform(array({rewrite_sql(spans_out)}), r -> "
        f"transform(array(exists(r.spans, q -> q.type IN ({marker_types}))), hm -> "
        f"transform(array(IF(hm AND coalesce(prepend_hint, false), length({hint}) + 2, 0)), sh -> "
        f"named_struct('hint', IF(hm, {hint}, CAST(NULL AS STRING)), "
        f"'masked_text', IF(sh > 0, concat({hint}, '\\n\\n', r.masked), r.masked), "
        f"'masked_spans', transform(r.spans, x -> named_struct('start', x.start + sh, 'end', x.end + sh, "
        f"'type', x.type))))[0])[0])[0]"
    )


def finish(df: DataFrame, s: C.Settings) -> DataFrame:
    """Rewrite (``_spans_out``) + hint + prepend + entities_found + ttl."""
    df = df.withColumn("_fin", F.expr(finish_sql(s)))
    df = (df.withColumn("hint", F.col("_fin.hint"))
            .withColumn("masked_text", F.col("_fin.masked_text"))
            .withColumn("masked_spans", F.col("_fin.masked_spans")))
    df = df.withColumn("entities_found", F.array_distinct(F.transform("spans", lambda x: x["ctype"])))
    df = df.withColumn("ttl", F.lit(s.mapping_ttl))
    return df.drop("_spans_out", "_fin")


def mask(texts: DataFrame, s: C.Settings, *, keys=("session_id", "seq"), **kw) -> DataFrame:
    """T3 for texts that are each their own (new) session.

    Returns the input columns plus masked_text, entities_found, hint,
    masked_spans, ttl, spans (resolved input spans), entries (the new mapping
    entries of the text) and reason.  Every input row comes back: one whose
    language the settings refuse has the reason and null masked columns.
    """
    C.validate(s)
    rows = texts if "language" in texts.columns else texts.withColumn("language", F.lit("ru"))
    refused = detector_set(F.col("language"), s).isNull()
    rows = rows.withColumn("reason", F.when(refused, F.lit("unsupported_language")))
    return mask_prepared(prepare(rows, s, keys=keys, **kw), s)


def masked_view(df: DataFrame, keys=("session_id", "seq")) -> DataFrame:
    """S9 shape: (session_id, seq, masked_text, entities_found, hint, masked_spans, ttl)."""
    return df.select(*keys, "masked_text", "entities_found", "hint", "masked_spans", "ttl")


def entries_view(df: DataFrame, keys=("session_id", "seq"), ttl: int = C.MAPPING_TTL_SECONDS) -> DataFrame:
    """New mapping entries as rows (one per entry)."""
    return (explode_rows(df, [*keys, "language"], "entries", "e", pos="_p")
              .select(*keys, "language", F.col("e.out").alias("out"), F.col("e.original").alias("original"),
                      F.col("e.ctype").alias("type"), F.col("e.kind").alias("kind"),
                      F.col("e.idx").alias("index"), F.col("e.ord").alias("ord")))
