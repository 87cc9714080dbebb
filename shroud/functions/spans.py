"""Span extraction and per-hit checks as native column expressions.

P-EXTRACT: ``split(text, re)`` gives the gaps and ``regexp_extract_all`` the
hits of one regex; a running fold over their lengths yields half-open
code-point offsets.  No Python worker is involved.  (``regexp_instr`` is not
used: it counts UTF-16 units, not code points.)
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .patterns import PatternDef, PRIORITY_RANK

HIT_TYPE = "array<struct<start:int,end:int,hit:string>>"
SPAN_FIELDS = "start:int,end:int,etype:string,score:double,custom:boolean,prio:int,pattern:string"
SPAN_TYPE = f"array<struct<{SPAN_FIELDS}>>"


CHUNK = 64


def appended(acc: Column, more: Column) -> Column:
    """``acc`` (struct of ``full``: arrays of CHUNK items and more, ``part``) with the items of ``more`` at its end.

    Appending to one array copies it each time; here only ``part`` is copied, and ``full`` once in CHUNK items."""
    grown = F.concat(acc["part"], more)
    return F.when(F.size(grown) < CHUNK, F.struct(acc["full"].alias("full"), grown.alias("part"))).otherwise(
        F.struct(F.concat(acc["full"], F.array(grown)).alias("full"), F.filter(grown, lambda x: F.lit(False)).alias("part")))


def nothing(array_type: str) -> Column:
    return F.struct(F.array().cast(f"array<{array_type}>").alias("full"), F.array().cast(array_type).alias("part"))


def items(acc: Column) -> Column:
    return F.concat(F.flatten(acc["full"]), acc["part"])


def located(gaps: Column, hits: Column) -> Column:
    """array<struct<start,end,hit>> from the gaps and hits of one regex."""
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))
    init = F.struct(F.lit(0).alias("pos"), nothing(HIT_TYPE).alias("spans"))

    def step(acc, x):
        s = acc["pos"] + x["g"]
        e = s + F.length(x["h"])
        grown = F.struct(e.alias("pos"), appended(acc["spans"], F.array(F.struct(s.alias("start"), e.alias("end"), x["h"].alias("hit")))).alias("spans"))
        return F.when(x["h"].isNull(), acc).otherwise(grown)

    return F.aggregate(pairs, init, step, lambda acc: items(acc["spans"]))


WINDOW_CHARS = 1000


def windows(text: Column, ahead: Column) -> Column:
    """array<struct<base, p, n, t>>: a text cut into pieces of ``n`` characters from ``base`` on; ``t`` is the piece with the
    ``p`` characters before it (0 or 1) and ``ahead`` characters after it.  A long text is read once, not once per position."""
    size = F.greatest(ahead, F.lit(WINDOW_CHARS))
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), 0)

    def of(all_: Column):
        def one(w: Column, i: Column) -> Column:
            before = F.when(i > 0, F.right(F.get(all_, i - 1), F.lit(1))).otherwise(F.lit(""))
            after = F.coalesce(F.substring(F.get(all_, i + 1), F.lit(1), ahead), F.lit(""))
            return F.struct((i * size).alias("base"), F.length(before).alias("p"), F.length(w).alias("n"), F.concat(before, w, after).alias("t"))
        return F.transform(all_, one)
    return F.transform(F.array(pieces), of)[0]


def extract_spans(text: Column, regex: str) -> Column:
    """All non-overlapping matches of ``regex``: array<struct<start,end,hit>>."""
    text = F.coalesce(text, F.lit(""))
    return located(F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), 0))


def _luhn(d: Column) -> Column:
    return F.call_function("luhn_check", d)


def left_context_ok(text: Column, start: Column, terms: Column) -> Column:
    """one of ``terms`` (an array) in the 30 characters left of the hit, and no run of
    4+ digits between the right-most end of such a word and the hit."""
    ws = F.greatest(start - C.CONTEXT_LEFT_WINDOW, F.lit(0))
    rwin = F.reverse(F.lower(F.substring(text, ws + 1, start - ws)))

    def end(t):
        # right-most occurrence ends at (start - p + 1) in text offsets
        p = F.call_function("locate", F.reverse(t), rwin)
        return F.when(p > 0, start - p + 1).otherwise(F.lit(-1))

    def clear(best):
        return (best >= 0) & ~F.substring(text, best + 1, start - best).rlike(r"(?U)\d{%d,}" % C.CONTEXT_NOISE_DIGITS)
    return F.transform(F.array(F.array_max(F.transform(terms, end))), clear)[0]


# Endings that inflection adds (our choice); a stem keeps at least four letters.
RU_ENDINGS = "иями|ями|ами|ого|его|ому|ему|ыми|ими|иях|ией|ой|ей|ий|ый|ая|яя|ое|ее|ые|ие|ов|ев|ам|ям|ах|ях|ом|ем|ою|ею|ую|юю|а|я|о|е|у|ю|ы|и|ь|й"
EN_ENDINGS = "ing|ed|es|s"
STEM = (r"^(\p{IsCyrillic}{4,}?)(?:%s)$" % RU_ENDINGS, r"^([a-z]{4,}?)(?:%s)$" % EN_ENDINGS)


def stem(word: Column) -> Column:
    """A word without its inflectional ending, lower-cased, ё as е."""
    word = F.translate(F.lower(word), "ё", "е")
    for rule in STEM:
        word = F.regexp_replace(word, rule, "$1")
    return word


def stemmed(term: str) -> str:
    """The same for the words of a context term."""
    out = []
    for w in re.findall(r"[\w/]+", term.lower().replace("ё", "е")):
        for rule in STEM:
            w = re.sub(rule.replace(r"\p{IsCyrillic}", "[а-я]"), r"\1", w)
        out.append(w)
    return " ".join(out)


def context_boost(text: Column, start: Column, score: Column, terms: Column, forms: Column, s: C.Settings) -> Column:
    """F2: raise the score when one of ``terms`` is part of one of the last
    ``context_prefix_words`` words left of the hit, or one of ``forms`` (the terms'
    stems between spaces) stands there by the words' stems, a term of several words as these in a row."""
    n = s.context_prefix_words

    def words_from(lo):
        return F.filter(F.split(F.lower(F.substring(text, lo + 1, start - lo)), r"(?U)[^\w/]+", -1),
                        lambda w: w != "")

    def near_by(near):
        # Enough words near by (the first of them may be cut), or all words before the hit.
        words = F.when((F.size(near) > n) | (start <= 200), near).otherwise(words_from(F.lit(0)))
        return F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n))

    def found(ws):
        listed = F.exists(ws, lambda w: F.exists(terms, lambda t: F.call_function("contains", w, t)))
        joined = F.concat(F.lit(" "), F.array_join(F.transform(ws, stem), " "), F.lit(" "))
        return listed | F.transform(F.array(joined), lambda j: F.exists(forms, lambda f: F.call_function("contains", j, f)))[0]

    last = F.transform(F.array(words_from(F.greatest(start - 200, F.lit(0)))), near_by)
    boosted = F.least(F.lit(1.0), F.greatest(score + s.context_boost, F.lit(s.context_min_score)))
    return F.when(F.transform(last, found)[0], boosted).otherwise(score)


def sql_text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rules_sql(patterns) -> str:
    """What is the same for all hits of a pattern, an array with one struct per pattern (folds to a literal)."""
    def strings(xs):
        return "array(" + ", ".join(map(sql_text, xs)) + ")" if xs else "CAST(array() AS ARRAY<STRING>)"

    rows = []
    for p in patterns:
        if not (p.validator in (None, "card") or callable(p.validator)):
            raise C.ConfigError(f"unknown validator {p.validator!r} of pattern {p.name}")
        card = p.validator == "card"
        rows.append(f"named_struct('etype', {sql_text(p.entity_type)}, 'score', {float(1.0 if card else p.score)}D, 'custom', {str(p.custom).lower()}, 'prio', {PRIORITY_RANK.get(p.name, 999)}, "
                    f"'pattern', {sql_text(p.name)}, 'card', {str(card).lower()}, 'required', {str(bool(p.context_required and p.context)).lower()}, "
                    f"'terms', {strings([t.lower() for t in p.context])}, 'forms', {strings(sorted({f' {stemmed(t)} ' for t in p.context}))})")
    return "array(" + ", ".join(rows) + ")"


def raw_hits(text: Column, p: PatternDef, place: int) -> Column:
    """Gaps and hits of one pattern, those that a function of the user's lets pass, and its place among the rules."""
    hits = F.regexp_extract_all(text, F.lit(p.regex), 0)
    at = located(F.split(text, p.regex, -1), hits) if p.refine is not None or callable(p.validator) else F.array().cast(HIT_TYPE)
    if p.refine is not None:
        sized = F.transform(at, lambda x: F.struct(x.alias("x"), p.refine(x["hit"]).alias("n")))
        at = F.transform(F.filter(sized, lambda y: y["n"].isNotNull()), lambda y: F.struct(
            y["x"]["start"].alias("start"), (y["x"]["start"] + y["n"]).alias("end"), F.substring(y["x"]["hit"], F.lit(1), y["n"]).alias("hit")))
    if callable(p.validator):
        at = F.filter(at, lambda x: p.validator(x["hit"]))
    none = F.array().cast("array<string>")
    if p.refine is not None or callable(p.validator):
        return F.struct(none.alias("gaps"), none.alias("hits"), at.alias("at"), F.lit(place).alias("place"))
    # a text without a hit is not split
    return F.transform(F.array(hits), lambda h: F.struct(F.when(F.size(h) > 0, F.split(text, p.regex, -1)).otherwise(none).alias("gaps"), h.alias("hits"),
                                                         at.alias("at"), F.lit(place).alias("place")))[0]


def checked_hits(text: Column, raw: Column, rules: Column, s: C.Settings) -> Column:
    """The hits in ``raw`` (an array of raw_hits, with nulls) after validator, required context and score
    boost: array<struct<start,end,etype,score,custom,prio,pattern>>.  One expression for the hits of all patterns."""
    def of_pattern(r):
        return F.transform(F.concat(located(r["gaps"], r["hits"]), r["at"]), lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), F.get(rules, r["place"]).alias("r")))

    hits = F.flatten(F.transform(F.filter(raw, lambda r: r.isNotNull()), of_pattern))
    hits = F.filter(hits, lambda x: (~x["r"]["card"] | _card_valid(x["hit"])) & (~x["r"]["required"] | left_context_ok(text, x["start"], x["r"]["terms"])))

    def scored(x):
        r = x["r"]
        score = F.when(F.size(r["terms"]) > 0, context_boost(text, x["start"], r["score"], r["terms"], r["forms"], s)).otherwise(r["score"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), r["etype"].alias("etype"), score.cast("double").alias("score"), r["custom"].alias("custom"),
                        r["prio"].alias("prio"), r["pattern"].alias("pattern"))
    return F.transform(hits, scored)


def _card_valid(hit: Column) -> Column:
    d = F.regexp_replace(hit, "[^0-9]", "")
    return F.length(d).between(13, 19) & _luhn(d)


def empty_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def explode_rows(df, keep, array_col, alias: str = "x", pos: str | None = None):
    """Explode an array column into rows, dropping rows whose array is empty.

    A plain ``explode`` makes the optimizer infer ``size(array) > 0`` and push
    it below the generator, which evaluates the (expensive) array expression
    twice; ``explode_outer`` + a null filter on the element does not."""
    from pyspark.sql import functions as F
    if pos:
        out = df.select(*keep, F.posexplode_outer(array_col).alias(pos, alias))
    else:
        out = df.select(*keep, F.explode_outer(array_col).alias(alias))
    return out.filter(F.col(alias).isNotNull())
