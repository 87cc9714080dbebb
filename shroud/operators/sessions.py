"""Masking of many texts per session against a stored mapping (T1, J3, J4,
J5, J8, A1, W1, W4, F9, F10, G14, U2), distributed.

The reference handles one request at a time, each reading and rewriting the
whole session.  Here a batch of texts is masked as if its texts arrived in
``seq`` order, without ever sending a session to one task:

1. guards against the stored state: refused language (B6), language
   differing from the session's (F9; a new session takes the language of its
   first text), text containing an out issued earlier (F10, token equi-join);
2. detection and resolution per text (row-local), then the entity table:
   one row per distinct (session, type, original) with its first occurrence
   (seq, ord) - W4;
3. existing entries are reused by an equi-join (J3);
4. new markers are numbered by a distributed rank in first-occurrence order,
   after the session's highest stored number (A1), skipping numbers whose
   marker text appears in any text of the batch (W1);
5. new surrogates are placed in rounds of joins: each unplaced entity offers
   its next candidate that is not in any text of the session's batch and not
   related by containment to a stored or placed out; of related offers the
   first in first-occurrence order is placed, the others go on with the next
   salts, until all are placed or a type's values are used up (an error);
6. spans get their outs back by an equi-join and each text is rewritten.

Checking candidates against all texts of the batch (not only the text that
introduced the value) means a text can never trip F10 on an out issued in
the same batch; F10 guards against earlier batches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import surrogates as G
from ..functions.tokens import out_tokens, substrings_min
from ..session import ensure_checkpoint_dir
from ..sources.store import empty_mapping, empty_sessions, live
from .mask import _label_sql, _taken_expr, detector_set, finish, prepare, taken_col
from .ranks import rank_within
from .unmask import token_hits

MIN_SURROGATE_LEN = 9
#: Types of which a session can use up all values: their form and number.  Others have over 10^8.
SPACES = {"PHONE": (r"^\+7 9[0-9]{2} 555-[0-9]{2}-[0-9]{2}$", 10 ** 6), "BIK": ("^04[0-9]{7}$", 10 ** 7),
          "KPP": ("^[1-9][0-9]{3}0[1-5][0-9]{3}$", 45 * 10 ** 6)}


@dataclass
class SessionMaskResult:
    masked: DataFrame      # keys + masked columns (accepted texts)
    entries: DataFrame     # new mapping entries
    rejected: DataFrame    # keys + reason
    touched: DataFrame     # (session_id, language) of sessions with an accepted text


def guards(texts: DataFrame, mapping: DataFrame, sessions: DataFrame, s: C.Settings,
           keys=("session_id", "seq")):
    """(accepted texts with column ``language``, rejected rows)."""
    keys = list(keys)
    refused = detector_set(F.col("language"), s).isNull()
    rej_lang = texts.filter(refused).select(*keys, F.lit("unsupported_language").alias("reason"))
    t = texts.filter(~refused)
    first_lang = t.groupBy("session_id").agg(F.min_by("language", F.col("seq")).alias("_first_lang"))
    stored = sessions.select("session_id", F.col("language").alias("_stored_lang"))
    t = t.join(stored, "session_id", "left").join(first_lang, "session_id", "left")
    t = t.withColumn("_sess_lang", F.coalesce("_stored_lang", "_first_lang"))
    rej_mismatch = (t.filter(~F.col("language").eqNullSafe(F.col("_sess_lang")))
                    .select(*keys, F.lit("language_mismatch").alias("reason")))
    t = t.filter(F.col("language").eqNullSafe(F.col("_sess_lang"))).drop("_stored_lang", "_first_lang", "_sess_lang")
    bad = token_hits(t, mapping, s, keys).select(*keys).distinct()
    rej_token = t.join(bad, keys, "left_semi").select(*keys, F.lit("contains_issued_token").alias("reason"))
    accepted = t.join(bad, keys, "left_anti")
    return accepted, rej_lang.unionByName(rej_mismatch).unionByName(rej_token)


def _materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder: it is
    reused by several joins below, and a lost executor does not send the
    job back to detection."""
    return df.checkpoint()


def _markers(new: DataFrame, taken: DataFrame, maxidx: DataFrame, s: C.Settings) -> DataFrame:
    g = ["session_id", "ctype"]
    nm = new.filter(F.col("ctype").isin(*s.marker_types))
    nm = nm.join(maxidx, g, "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    nm = rank_within(nm, g, ["first_seq", "first_ord", "original"], "_k")
    tk = (taken.join(nm.select(*g, "_m").distinct(), g)
               .filter(F.col("_num") > F.col("_m")))
    tk = rank_within(tk, g, ["_num"], "_j").withColumn("_pos", F.col("_num") - F.col("_m") - F.col("_j"))
    # Entity k lands at k-th free number: m + (its rank among entities and
    # taken numbers ordered by "free numbers before").
    both = nm.select(*g, "original", "first_seq", "first_ord", "lang", "_m",
                     (F.col("_k") - 1).alias("_pos"), F.lit(1).alias("_flag"), F.col("_k").alias("_tie"))
    tk_rows = tk.select(*g, F.lit(None).cast("string").alias("original"), F.lit(None).cast("long").alias("first_seq"),
                        F.lit(None).cast("int").alias("first_ord"), F.lit(None).cast("string").alias("lang"),
                        "_m", F.col("_pos").cast("long"), F.lit(0).alias("_flag"), F.col("_num").cast("long").alias("_tie"))
    u = rank_within(both.unionByName(tk_rows), g, ["_pos", "_flag", "_tie"], "_u").filter(F.col("_flag") == 1)
    idx = (F.col("_m") + F.col("_u")).cast("int")
    label = F.expr(_label_sql(s, "ctype", "lang"))
    out = F.concat(F.lit(s.marker_open), label, F.lit(" "), idx.cast("string"), F.lit(s.marker_close))
    return u.select("session_id", "ctype", "original", "first_seq", "first_ord", "lang",
                    out.alias("out"), F.lit("marker").alias("kind"), idx.alias("index"))


def _unused(df: DataFrame, batch_tokens: DataFrame, outs: DataFrame, shortest: int = MIN_SURROGATE_LEN) -> DataFrame:
    """Rows of ``session_id, cand`` whose candidate is in no text of the batch and not related to an out (of ``shortest`` characters at least)."""
    df = df.join(batch_tokens.withColumnRenamed("tok", "cand"), ["session_id", "cand"], "left_anti")
    # not equal to / inside an out
    sub = outs.select("session_id", F.explode(substrings_min(F.col("out"), MIN_SURROGATE_LEN)).alias("cand")).distinct()
    df = df.join(sub, ["session_id", "cand"], "left_anti")
    # no out inside the candidate
    inner = (df.select("session_id", "cand", F.explode(substrings_min(F.col("cand"), shortest)).alias("out"))
             .join(outs.select("session_id", "out"), ["session_id", "out"], "left_semi").select("session_id", "cand").distinct())
    return df.join(inner, ["session_id", "cand"], "left_anti")


def _check_space(waiting: DataFrame, batch_tokens: DataFrame, outs: DataFrame) -> None:
    """Raise if a waiting entity's type has no value left in its session."""
    used = (outs.select("session_id", F.explode(substrings_min(F.col("out"), MIN_SURROGATE_LEN)).alias("tok"))
            .unionByName(batch_tokens).distinct())
    for ctype, (form, size) in SPACES.items():
        asking = waiting.filter(F.col("ctype") == ctype).select("session_id").distinct()
        full = (used.filter(F.col("tok").rlike(form)).join(asking, "session_id", "left_semi")
                .groupBy("session_id").count().filter(F.col("count") >= size))
        if full.limit(1).count():
            raise ValueError(f"no free surrogate for type {ctype}: a session uses all {size} values")


def _surrogates(new: DataFrame, batch_tokens: DataFrame, stored_outs: DataFrame, s: C.Settings) -> DataFrame:
    ent = ["session_id", "ctype", "original"]
    cols = [*ent, "first_seq", "first_ord", "lang"]
    turn = F.struct("first_seq", "first_ord", "ctype", "original")
    waiting = _materialize(new.filter(F.col("ctype").isin(*s.surrogate_types)).select(*cols))
    outs, placed, lo, step = stored_outs.select("session_id", "out").where("out <> ''"), None, 0, s.surrogate_candidates
    # outs that came from elsewhere may be shorter than any that is issued here
    shortest = min(outs.agg(F.min(F.length("out"))).first()[0] or MIN_SURROGATE_LEN, MIN_SURROGATE_LEN)
    while True:
        c = waiting.select(*cols, F.posexplode(F.expr(G.candidates_sql(s, "session_id", "ctype", "original", lo, lo + step))).alias("salt", "cand"))
        # each entity's next candidate; an entity that loses it goes on with those after it
        left = _materialize(_unused(c, batch_tokens, outs, shortest))
        while True:
            offers = _materialize(left.groupBy(*cols).agg(F.min(F.struct("salt", "cand")).alias("x")).select(*cols, "x.salt", "x.cand", turn.alias("turn")))
            if not offers.limit(1).count():
                break
            # of equal offers the first is placed, and of offers that contain one another
            first = offers.groupBy("session_id", "cand").agg(F.min("turn").alias("turn"))
            inside = (first.select("session_id", F.col("cand").alias("long"), F.col("turn").alias("t"), F.explode(substrings_min(F.col("cand"), MIN_SURROGATE_LEN)).alias("cand"))
                      .filter(F.col("cand") != F.col("long")).join(first, ["session_id", "cand"]))
            lost = inside.select("session_id", F.when(F.col("t") > F.col("turn"), F.col("long")).otherwise(F.col("cand")).alias("cand")).distinct()
            won = first.join(lost, ["session_id", "cand"], "left_anti")
            now = _materialize(offers.join(won, ["session_id", "cand", "turn"], "left_semi").select(*cols, F.col("cand").alias("out")))
            placed = now if placed is None else placed.unionByName(now)
            outs = outs.unionByName(now.select("session_id", "out"))
            tried = offers.select(*ent, F.col("salt").alias("_tried"))
            left = (left.join(now.select(*ent), ent, "left_anti").join(tried, ent).filter(F.col("salt") > F.col("_tried")).drop("_tried"))
            left = _materialize(_unused(left, batch_tokens, now.select("session_id", "out")))
        if placed is not None:
            waiting = _materialize(waiting.join(placed.select(*ent), ent, "left_anti"))
        if not waiting.limit(1).count():
            break
        lo, step = lo + step, min(2 * step, s.surrogate_fallback_candidates)
        _check_space(waiting, batch_tokens, outs)
    both = placed if placed is not None else waiting.withColumn("out", F.lit(None).cast("string"))
    return both.withColumn("kind", F.lit("surrogate")).withColumn("index", F.lit(None).cast("int"))


def mask_sessions(texts: DataFrame, s: C.Settings, mapping: DataFrame | None = None,
                  sessions: DataFrame | None = None, now: Column | None = None,
                  keys=("session_id", "seq"), checkpoint: bool = True, **prep_kw) -> SessionMaskResult:
    C.validate(s)
    spark = texts.sparkSession
    ensure_checkpoint_dir(spark)
    keys = list(keys)
    now = now if now is not None else F.current_timestamp()
    mapping = live(mapping if mapping is not None else empty_mapping(spark), now)
    sessions = live(sessions if sessions is not None else empty_sessions(spark), now)
    if "prepend_hint" not in texts.columns:
        texts = texts.withColumn("prepend_hint", F.lit(False))
    batch_sessions = texts.select("session_id").distinct()
    mapping = mapping.join(batch_sessions, "session_id", "left_semi")
    accepted, rejected = guards(texts, mapping, sessions, s, keys)
    prep = prepare(accepted, s, keys=keys, **prep_kw)
    for t in s.marker_types:
        prep = prep.withColumn(taken_col(t), _taken_expr(s, t, "text", "language"))
    prep = prep.withColumn("_toks", out_tokens(F.col("text"), s))
    if checkpoint:
        prep = prep.checkpoint()   # detection runs once; lineage cut in the shared folder

    lang = prep.select("session_id", F.col("language").alias("lang")).dropDuplicates(["session_id"])
    occ = (prep.select("session_id", "seq", F.explode("spans").alias("x"))
               .select("session_id", "seq", "x.start", "x.end", "x.ctype", "x.original", "x.ord"))
    ent = (occ.groupBy("session_id", "ctype", "original")
              .agg(F.min(F.struct("seq", "ord")).alias("_f"))
              .select("session_id", "ctype", "original", F.col("_f.seq").alias("first_seq"),
                      F.col("_f.ord").alias("first_ord")))
    stored = mapping.select("session_id", F.col("type").alias("ctype"), "original", F.col("out").alias("_old"))
    ent = ent.join(stored, ["session_id", "ctype", "original"], "left")
    ent = _materialize(ent)
    new = ent.filter(F.col("_old").isNull()).drop("_old").join(lang, "session_id")

    maxidx = (mapping.filter(F.col("kind") == "marker")
              .groupBy("session_id", F.col("type").alias("ctype")).agg(F.max("index").alias("_m")))
    taken = None
    for t in s.marker_types:
        part = prep.select("session_id", F.lit(t).alias("ctype"), F.explode(taken_col(t)).alias("_num"))
        taken = part if taken is None else taken.unionByName(part)
    taken = taken.distinct()
    batch_tokens = prep.select("session_id", F.explode("_toks.tok").alias("tok")).distinct()

    markers = _markers(new, taken, maxidx, s)
    surr = _surrogates(new, batch_tokens, mapping.select("session_id", "out"), s)
    cols = ["session_id", "ctype", "original", "first_seq", "first_ord", "lang", "out", "kind", "index"]
    new_entries = markers.select(*cols).unionByName(surr.select(*cols))

    outs = (ent.filter(F.col("_old").isNotNull()).select("session_id", "ctype", "original", F.col("_old").alias("out"))
            .unionByName(new_entries.select("session_id", "ctype", "original", "out")))
    # a span without an out would stay in clear: fail instead
    placed = occ.join(outs, ["session_id", "ctype", "original"], "left").withColumn(
        "out", F.coalesce("out", F.raise_error(F.concat(F.lit("no out for a span of type "), F.col("ctype"))).cast("string")))
    spans_out = (placed
                 .groupBy("session_id", "seq")
                 .agg(F.collect_list(F.struct("start", "end", "ctype", "ord", "out")).alias("_spans_out")))
    masked = prep.drop("_toks", *[taken_col(t) for t in s.marker_types]).join(spans_out, ["session_id", "seq"], "left")
    masked = masked.withColumn("_spans_out", F.coalesce(
        "_spans_out", F.array().cast("array<struct<start:int,end:int,ctype:string,ord:int,out:string>>")))
    masked = finish(masked, s)
    entries = new_entries.select("session_id", F.col("lang").alias("language"), "out", "original",
                                 F.col("ctype").alias("type"), "kind", "index",
                                 F.col("first_seq").alias("seq"), F.col("first_ord").alias("ord"))
    touched = accepted.select("session_id", "language").dropDuplicates(["session_id"])
    return SessionMaskResult(masked, entries, rejected, touched)
