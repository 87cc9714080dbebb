"""One pass over a text table that attaches the pattern hits of
every detector allowed for the row's language (F5) as one array column.

Cost control (no shuffle, no Python worker):
* a cheap row gate per family (``\\d{9}``, ``\\d``, ``@``) is evaluated once
  and guards every pattern of that family, so a text without digits never
  runs the numeric regexes;
* the language branch is a ``CASE``, so each row runs one detector set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.patterns import GATE_NONE, GATE_REGEX, REGISTRY, PatternDef, patterns_for
from ..functions.spans import checked_hits, empty_spans, explode_rows, raw_hits, rules_sql


def _gate_cols(text: Column, registry) -> dict[str, Column]:
    gates = {}
    for p in registry:
        if p.gate != GATE_NONE and p.gate not in gates:
            gates[p.gate] = F.coalesce(text.rlike(GATE_REGEX[p.gate]), F.lit(False))
    return gates


def pattern_hits(text: Column, language: Column, s: C.Settings,
                 registry: tuple[PatternDef, ...] = REGISTRY, entity_types=None) -> Column:
    """Union of the allowed detectors' hits for each row.

    Each pattern adds its two regex calls to an array; offsets, checks and scores are
    one expression over this array, whatever the number of patterns."""
    registry = [p for p in registry if entity_types is None or p.entity_type in entity_types]
    if not registry:
        return empty_spans()
    gates = _gate_cols(text, registry)
    whole = F.coalesce(text, F.lit(""))
    raw = {p.name: raw_hits(whole, p, i) for i, p in enumerate(registry)}

    def run(lang: str) -> Column:
        mine = [p for p in registry if C.detector_runs_for(p.entity_type, lang)]
        none = F.array(F.when(F.lit(False), raw[registry[0].name]))
        return F.array(*[F.when(gates[p.gate], raw[p.name]) if p.gate != GATE_NONE else raw[p.name] for p in mine]) if mine else none

    both = F.when(language == "ru", run("ru")).otherwise(run("en"))
    bound = F.struct(both.alias("raw"), F.expr(rules_sql(registry)).alias("rules"), whole.alias("text"))
    return F.transform(F.array(bound), lambda z: checked_hits(z["text"], z["raw"], z["rules"], s))[0]


def detect(df: DataFrame, s: C.Settings, text: str = "text", language: str = "language",
           out: str = "pat_spans", registry=REGISTRY, entity_types=None) -> DataFrame:
    """Add ``out`` = array of hits (start, end, etype, score, custom, prio, pattern)."""
    lang = F.col(language) if language in df.columns else F.lit(language)
    return df.withColumn(out, pattern_hits(F.col(text), lang, s, registry, entity_types))


def detect_spans(df: DataFrame, s: C.Settings, keys=("session_id", "seq"), text="text",
                 language="language", registry=REGISTRY, entity_types=None) -> DataFrame:
    """Detected hits as rows: keys + (start, end, entity_type, score, pattern, original)."""
    d = detect(df.select(*keys, text, language), s, text, language, "_h", registry, entity_types)
    return (explode_rows(d, [*keys, text], "_h", "h")
             .select(*keys, F.col("h.start").alias("start"), F.col("h.end").alias("end"),
                     F.col("h.etype").alias("entity_type"), F.col("h.score").alias("score"),
                     F.col("h.pattern").alias("pattern"),
                     F.expr(f"substring({text}, h.start + 1, h.end - h.start)").alias("original")))


def type_counts_by(hits: DataFrame, *by: str) -> DataFrame:
    """A10: hits counted by ``by`` and by each of its leading parts (grouping sets); ``level`` tells how many columns are totalled."""
    return hits.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def patterns_table(spark, language: str | None = None):
    """The pattern registry as a DataFrame (X1): one row per pattern."""
    rows = []
    for p in REGISTRY:
        langs = [lg for lg in C.SUPPORTED_LANGUAGES if C.detector_runs_for(p.entity_type, lg)]
        if language and language not in langs:
            continue
        rows.append((p.entity_type, p.name, p.regex, float(p.score), list(p.context),
                     p.validator, p.context_required, langs))
    return spark.createDataFrame(
        rows, "entity_type string, name string, regex string, score double, context array<string>, "
              "validator string, context_required boolean, languages array<string>")


__all__ = ["detect", "detect_spans", "pattern_hits", "patterns_for", "patterns_table", "type_counts_by"]
