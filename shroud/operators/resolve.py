"""Overlap resolution and canonical projection.

J2 is not a join: a dropped hit must not block others, so it is a per-text
fold over the hits sorted by priority (custom detector first, then score,
then length, all descending; ties by start and registration order so the
result does not depend on engine sort stability), cluster by cluster of hits that touch.  J1 drops any pattern hit
that overlaps a NER span, whatever its score.  Both run inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..functions.spans import SPAN_TYPE, appended, items, nothing

ORDERED_TYPE = "array<struct<start:int,end:int,ctype:string,original:string,ord:int,src:string>>"


def _desc(a: Column, b: Column) -> Column:
    return F.when(a > b, -1).otherwise(1)


def priority_sort(arr: Column) -> Column:
    """O1: 3-key descending priority with explicit tie-breakers."""
    def cmp(a, b):
        la, lb = a["end"] - a["start"], b["end"] - b["start"]
        return (F.when(a["custom"] != b["custom"], F.when(a["custom"], -1).otherwise(1))
                .when(a["score"] != b["score"], _desc(a["score"], b["score"]))
                .when(la != lb, _desc(la, lb))
                .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                .when(a["prio"] != b["prio"], F.when(a["prio"] < b["prio"], -1).otherwise(1))
                .otherwise(0))
    return F.array_sort(arr, cmp)


def overlaps(x: Column, k: Column) -> Column:
    """Half-open overlap: touching spans do not overlap."""
    return (x["start"] < k["end"]) & (x["end"] > k["start"])


def _settled(cluster: Column) -> Column:
    """The hits of one cluster that overlap nothing kept before them in priority order."""
    kept = F.aggregate(priority_sort(cluster), F.array().cast(SPAN_TYPE),
                       lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(x, k)), kept).otherwise(F.concat(kept, F.array(x))))
    return F.when(F.size(cluster) < 2, cluster).otherwise(kept)


def greedy_resolve(arr: Column) -> Column:
    """Keep a hit if it overlaps nothing kept so far, in priority order.

    Hits in order of start fall into clusters: one begins where the running maximum of
    ``end`` is not past the hit's start.  Hits of different clusters do not overlap, so each
    cluster is settled by itself and a text with very many hits costs no more than these."""
    by_start = F.array_sort(arr, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    none = F.array().cast(SPAN_TYPE)
    init = F.struct(nothing(SPAN_TYPE).alias("out"), none.alias("cluster"), F.lit(0).alias("reach"))

    def step(acc, x):
        apart = F.struct(appended(acc["out"], _settled(acc["cluster"])).alias("out"), F.array(x).alias("cluster"), x["end"].alias("reach"))
        touching = F.struct(acc["out"].alias("out"), F.concat(acc["cluster"], F.array(x)).alias("cluster"), F.greatest(acc["reach"], x["end"]).alias("reach"))
        return F.when(x["start"] >= acc["reach"], apart).otherwise(touching)
    return priority_sort(F.aggregate(by_start, init, step, lambda acc: F.concat(items(acc["out"]), _settled(acc["cluster"]))))


def drop_overlapping_ner(arr: Column, ner: Column) -> Column:
    """Anti join on interval overlap with the NER spans of the same text."""
    return F.filter(arr, lambda x: ~F.exists(ner, lambda n: overlaps(x, n)))


def canonical(etype: Column) -> Column:
    """Detector type -> canonical type; unknown types pass through."""
    expr = None
    for k, v in C.CANONICAL_TYPE.items():
        expr = F.when(etype == k, F.lit(v)) if expr is None else expr.when(etype == k, F.lit(v))
    return expr.otherwise(etype)


def ordered_spans(text: Column, ner: Column, pat: Column) -> Column:
    """U1 + P1 + P2: NER spans in text order, then the resolved pattern hits in
    priority order; ``ord`` is the allocation order.  ``ner`` and ``pat`` are
    bound once (one-element transform), so neither is re-evaluated inside the
    per-hit lambdas."""
    def body(z):
        n, p = z["n"], z["p"]
        ner_part = F.transform(n, lambda q: F.struct(q["start"].alias("start"), q["end"].alias("end"),
                                                     q["etype"].alias("etype"), F.lit("ner").alias("src")))
        pat_part = F.transform(drop_overlapping_ner(greedy_resolve(p), n),
                               lambda q: F.struct(q["start"].alias("start"), q["end"].alias("end"),
                                                  q["etype"].alias("etype"), F.lit("pattern").alias("src")))
        both = F.concat(ner_part, pat_part)
        return F.transform(both, lambda x, i: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), canonical(x["etype"]).alias("ctype"),
            F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("original"),
            i.cast("int").alias("ord"), x["src"].alias("src")))
    return F.transform(F.array(F.struct(ner.alias("n"), pat.alias("p"))), body)[0]
