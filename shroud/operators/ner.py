"""Person / organisation spans (D15-D17) and the NER post-filters.

The reference takes PER/ORG spans from a statistical tagger.  Here spans come
from one of three places, all producing the same shape
``array<struct<start:int,end:int,etype:string>>`` per text:

* rule patterns (default): Russian surname + initials, full name with a
  patronymic, organisation legal form + name;
* an injected ``spans`` DataFrame (tests, or any external tagger's output);
* a user tagger run with ``mapInPandas`` (X4), loaded once per partition.

Whatever the source, spans are clipped at the first newline and trimmed
(F7), empty ones dropped (F8), single all-caps words dropped (F6), and only
PER/ORG kept (F12).
"""

from __future__ import annotations

from typing import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import extract_spans

NER_TYPE = "array<struct<start:int,end:int,etype:string>>"

# Rule patterns (our choice; case-sensitive).
_UP = "[А-ЯЁ]"
_LO = "[а-яё]"
_NAME = f"{_UP}{_LO}+(?:-{_UP}{_LO}+)?"
_PATRONYMIC = f"{_UP}{_LO}+(?:ович|евич|овна|евна|ична|ич)"
PER_RU_RE = (
    rf"(?U)\b(?:{_NAME}\s+{_NAME}\s+{_PATRONYMIC}"          # Фамилия Имя Отчество
    rf"|{_NAME}\s+{_UP}\.\s?{_UP}\."                          # Фамилия И. О.
    rf"|{_UP}\.\s?{_UP}\.\s?{_NAME}"                          # И. О. Фамилия
    rf"|{_NAME}\s+{_PATRONYMIC})(?!\w)"                       # Имя Отчество
)
ORG_RU_RE = (
    r"(?U)\b(?:ООО|ОАО|ЗАО|ПАО|АО|НКО|ФГУП|ГУП|МУП|ИП)\s+"
    r"(?:«[^»\n]++»|\"[^\"\n]++\"|[А-ЯЁ][\w\-]*+(?:\s+[А-ЯЁ][\w\-]*+)*+)"
)


def _typed(arr: Column, etype: str) -> Column:
    return F.transform(arr, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                               F.lit(etype).alias("etype")))


def rule_ner(text: Column) -> Column:
    """Rule-based PER/ORG spans, non-overlapping (longest first)."""
    raw = F.concat(_typed(extract_spans(text, PER_RU_RE), "PER"),
                   _typed(extract_spans(text, ORG_RU_RE), "ORG"))
    return resolve_ner_overlaps(raw)


def resolve_ner_overlaps(arr: Column) -> Column:
    ordered = F.array_sort(arr, lambda a, b: F.when((a["end"] - a["start"]) != (b["end"] - b["start"]),
                                                    F.when((a["end"] - a["start"]) > (b["end"] - b["start"]), -1).otherwise(1))
                           .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                           .otherwise(0))
    kept = F.aggregate(ordered, F.array().cast(NER_TYPE),
                       lambda acc, x: F.when(F.exists(acc, lambda k: (x["start"] < k["end"]) & (x["end"] > k["start"])), acc)
                       .otherwise(F.concat(acc, F.array(x))))
    return sort_by_start(kept)


def sort_by_start(arr: Column) -> Column:
    return F.array_sort(arr, lambda a, b: F.when(a["start"] < b["start"], -1)
                        .when(a["start"] > b["start"], 1).otherwise(0))


def clip_and_filter(text: Column, arr: Column) -> Column:
    """F12, F7, F8, F6 over an array of (start, end, etype) spans."""
    def clip(x):
        s, e = x["start"], x["end"]
        seg = F.substring(text, s + 1, e - s)
        nl = F.locate("\n", seg)
        e1 = F.when(nl > 0, s + nl - 1).otherwise(e)
        seg1 = F.substring(text, s + 1, e1 - s)
        lead = F.length(seg1) - F.length(F.regexp_replace(seg1, r"(?U)^\s+", ""))
        trail = F.length(seg1) - F.length(F.regexp_replace(seg1, r"(?U)\s+$", ""))
        return F.struct((s + lead).alias("start"), (e1 - trail).alias("end"), x["etype"].alias("etype"))

    typed = F.filter(arr, lambda x: x["etype"].isin("PER", "ORG"))
    clipped = F.filter(F.transform(typed, clip), lambda x: x["end"] > x["start"])

    def not_fp(x):
        w = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        one_word = F.size(F.split(w, r"(?U)\s+", -1)) == 1
        return ~(one_word & (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w)))
    return F.filter(clipped, not_fp)


def collect_injected(texts: DataFrame, spans: DataFrame, out: str,
                     keys=("session_id", "seq"), with_score: bool = False) -> DataFrame:
    """Attach injected spans (one row per span) to texts as an array column,
    keeping their original order.  One shuffle on the text key."""
    if with_score:
        elem = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                        F.col("entity_type").alias("etype"), F.col("score").cast("double").alias("score"),
                        F.col("_i").alias("_i"))
    else:
        elem = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                        F.col("entity_type").alias("etype"), F.col("_i").alias("_i"))
    idx = F.col("idx") if "idx" in spans.columns else F.col("start")
    grouped = (spans.withColumn("_i", idx.cast("long"))
               .groupBy(*keys).agg(F.array_sort(F.collect_list(elem), lambda a, b: F.when(a["_i"] < b["_i"], -1)
                                                .when(a["_i"] > b["_i"], 1).otherwise(0)).alias(out)))
    drop_i = F.transform(F.col(out), lambda x: x.dropFields("_i"))
    return texts.join(grouped.withColumn(out, drop_i), list(keys), "left")


def tagger_spans(texts: DataFrame, tagger: Callable, keys=("session_id", "seq"), text="text") -> DataFrame:
    """Run a user NER tagger over texts with ``mapInPandas``.

    ``tagger`` is a factory called once per partition; it returns a function
    mapping a pandas DataFrame (keys + text) to a pandas DataFrame with
    keys + start, end, entity_type.
    """
    schema = ", ".join([f"{k} {dict(texts.dtypes)[k]}" for k in keys]) + \
        ", start int, end int, entity_type string, score double, detector string"

    def run(batches: Iterator):
        fn = tagger()
        import pandas as pd
        for pdf in batches:
            res = fn(pdf)
            if res is None or len(res) == 0:
                continue
            res = res.copy()
            if "score" not in res:
                res["score"] = 1.0
            res["detector"] = "ner"
            yield res[list(keys) + ["start", "end", "entity_type", "score", "detector"]].astype(
                {"start": "int32", "end": "int32"})
    return texts.select(*keys, text).mapInPandas(run, schema)
