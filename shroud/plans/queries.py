"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
computed from the supplied tables.  Keys name the SURVEY operator ids they
exercise.  Oracles for the same keys are in :mod:`shroud.plans.oracles`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import surrogates as G
from ..functions.patterns import REGISTRY
from ..functions.spans import explode_rows
from ..operators.detect import detect_spans, type_counts_by
from ..operators.gazetteer import gazetteer_spans
from ..operators.mask import entries_view, mask, prepare
from ..operators.resolve import canonical
from ..operators.sessions import mask_sessions
from ..operators.tagger import tagged_spans, train
from ..operators.unmask import unmask, unmask_with_entries
from ..session import ensure_checkpoint_dir, saved, scratch_path, tune
from ..sources import store as S
from ..sources.texts import read_table, texts_from
from ..streaming.chunks import assemble, cut_chunks, run_stream_unmask
from ..streaming.masking import run_stream_mask
from . import carriers

# Fixed secret for reproducible query results (tests and the oracle use the same).
QUERY_SECRET = "query-secret-for-reproducible-surrogates"
SETTINGS = C.Settings(secret=QUERY_SECRET)
# A fixed clock for session expiry, so results do not depend on wall time.
NOW = "TIMESTAMP '2026-01-01 00:00:00'"


def _patterns(*names):
    return tuple(p for p in REGISTRY if p.name in names)


def _spread(texts: DataFrame) -> DataFrame:
    """Deal texts out anew only where the scan has fewer partitions than there are cores (a small file of one row group)."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts if texts.rdd.getNumPartitions() >= cores else texts.repartition(cores, "seq")


ROWS_PER_TASK = 10000       # texts of a few hundred characters: some tens of seconds of detection and masking


def _dealt(rows: DataFrame, key: str, like: DataFrame | None = None) -> DataFrame:
    """Narrow rows dealt out by ``key`` before texts are built around them: a small file (or its one row group) is read by one task,
    whatever its number of rows; what follows runs in tasks of like length, and more of them for more rows (``like``: a table with as many)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(2 * cores, -(-(rows if like is None else like).count() // ROWS_PER_TASK)), key)


def _customers(spark, sf_dir) -> DataFrame:
    """``c_custkey`` of every customer, dealt out."""
    return _dealt(read_table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


def _docs(spark, sf_dir, lang="en"):
    d = read_table(spark, sf_dir, "documents")
    return texts_from(d, "doc_id", "text", language=F.lit(lang), session=F.col("doc_id").cast("string"))


def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail hits with code-point offsets in documents."""
    t = _docs(spark, sf_dir)
    d = detect_spans(t, SETTINGS, keys=("seq",), registry=_patterns("EMAIL"))
    return d.select(F.col("seq").alias("doc_id"), "start", "end", "original")


def detect_card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7 + F3 + F4: card-shaped runs that pass Luhn, per pattern."""
    t = _docs(spark, sf_dir)
    d = detect_spans(t, SETTINGS, keys=("seq",), registry=_patterns("CARD_SPACED", "CARD_AMEX", "CARD_PLAIN"))
    return d.select(F.col("seq").alias("doc_id"), "pattern", "start", "end", "original")


def _requisite_texts(spark, sf_dir):
    c = _customers(spark, sf_dir)
    return c.select(F.col("c_custkey").cast("string").alias("session_id"), F.col("c_custkey").alias("seq"),
                    F.expr(carriers.text_sql()).alias("text"), F.lit("ru").alias("language"))


def detect_requisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D11, D15/D16 (rule NER), F1, F2, J1, J2, O1, P1, P2 on carrier text:
    resolved entities with offsets."""
    p = prepare(_requisite_texts(spark, sf_dir), SETTINGS)
    return (explode_rows(p, [F.col("seq").alias("c_custkey")], "spans")
            .select("c_custkey", F.col("x.ctype").alias("ctype"), F.col("x.original").alias("original"),
                    F.col("x.start").alias("start"), F.col("x.end").alias("end")))


def mask_requisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked carrier text, each customer its own session."""
    m = mask(_requisite_texts(spark, sf_dir), SETTINGS)
    return m.select(F.col("seq").alias("c_custkey"), "masked_text")


def _surrogate_originals(spark, sf_dir):
    c = _customers(spark, sf_dir)
    seg = dict((k, v) for k, v in carriers.REQUISITE_SEGMENTS if k != "lit")
    extra = {
        "EMAIL": "('c' || CAST(c_custkey AS STRING) || '@mail.ru')",
        "CARD": "('4111 ' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || ' 1111 1111')",
    }
    parts = [F.struct(F.lit(t).alias("ctype"), F.expr(extra.get(t) or seg[t]).alias("original")) for t in G.GENERATORS]
    return c.select("c_custkey", F.inline(F.array(*parts)))


def surrogate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1-G13 + seed: first candidate per (customer session, type, original)."""
    o = _surrogate_originals(spark, sf_dir).withColumn("session_id", F.concat(F.lit("s"), F.col("c_custkey").cast("string")))
    cands = F.expr(G.candidates_sql(SETTINGS, "session_id", "ctype", "original", 0, 1))
    return o.select("c_custkey", "ctype", F.get(cands, 0).alias("out"))


def _still_clear(masked: DataFrame):
    """E-mail addresses that the masked text still shows, by a plain expression (surrogates are at example.com): none, if masking did its work."""
    found = F.regexp_extract_all("masked_text", F.lit(r"(?U)\b[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}\b"), F.lit(0))
    return F.size(F.filter(found, lambda x: ~x.endswith("@example.com")))


def roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 then T5 per document (each its own session): the original text back."""
    t = _spread(_docs(spark, sf_dir))
    m = unmask_with_entries(mask(t, SETTINGS), SETTINGS)
    return m.select(F.col("seq").alias("doc_id"), F.col("unmasked_text").alias("text"), _still_clear(m).alias("still_clear"))


def roundtrip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 then T5 over raw HTML pages."""
    p = read_table(spark, sf_dir, "pages")
    t = texts_from(p, "page_id", "html", language=F.lit("en"), session=F.col("page_id").cast("string"))
    m = unmask_with_entries(mask(_spread(t), SETTINGS), SETTINGS)
    return m.select(F.col("seq").alias("page_id"), F.col("unmasked_text").alias("html"), _still_clear(m).alias("still_clear"))


def unmask_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1/J3/W1 across texts (session = source), then J6 + T5 against the
    written mapping: every document restored."""
    d = read_table(spark, sf_dir, "documents")
    t = d.select(F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), "text",
                 F.lit("en").alias("language"))
    r = mask_sessions(t, SETTINGS, now=F.expr(NOW))
    masked = r.masked.select("session_id", "seq", F.col("masked_text").alias("text"))
    u = unmask(masked, r.entries, SETTINGS).join(r.masked.select("session_id", "seq", _still_clear(r.masked).alias("still_clear")), ["session_id", "seq"])
    return u.select(F.col("seq").alias("doc_id"), F.col("unmasked_text").alias("text"), "still_clear")


def roundtrip_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with natural (conv_id, turn) keys: mask then unmask.  Each turn ends with an address of its conversation's own."""
    c = read_table(spark, sf_dir, "conversations")
    t = c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.expr(carriers.turn_text_sql()).alias("text"),
                 F.lit("en").alias("language"))
    r = mask_sessions(t, SETTINGS, now=F.expr(NOW))
    masked = r.masked.select("session_id", "seq", F.col("masked_text").alias("text"))
    u = unmask(masked, r.entries, SETTINGS).join(r.masked.select("session_id", "seq", _still_clear(r.masked).alias("still_clear")), ["session_id", "seq"])
    return u.select(F.col("session_id").cast("long").alias("conv_id"), F.col("seq").alias("turn"),
                    F.col("unmasked_text").alias("text"), "still_clear", "tokens_replaced")


def _person_texts(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").cast("string").alias("session_id"), F.col("c_custkey").alias("seq"),
                    F.expr(carriers.person_text_sql("c_custkey")).alias("text"), F.lit("ru").alias("language"))


def marker_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + G15 + A1 across the texts of a session: markers numbered in
    first-occurrence order, skipping numbers written in the session's texts."""
    r = mask_sessions(_person_texts(spark, sf_dir), SETTINGS, now=F.expr(NOW))
    return r.entries.filter("kind = 'marker'").select("session_id", "original", "out")


def _store(spark, name):
    return S.Store(spark, scratch_path(spark, f"stores/{name}-{uuid.uuid4().hex}"))


def _two_batches(spark, sf_dir):
    """Batch 1 masks every customer's person text (session = nation) and is
    written to a store; batch 2 sends a second text per customer."""
    now = F.expr(NOW)
    first = _person_texts(spark, sf_dir)
    r1 = mask_sessions(first, SETTINGS, now=now)
    st = _store(spark, "guards")
    m, s = S.merge(S.empty_mapping(spark), S.empty_sessions(spark), r1.entries, r1.touched, now, SETTINGS.mapping_ttl)
    st.write(m, s)
    c = read_table(spark, sf_dir, "customer")
    second = c.select(
        F.col("c_nationkey").cast("string").alias("session_id"), (F.col("c_custkey") + 1000000000).alias("seq"),
        F.expr("CASE WHEN c_custkey % 3 = 1 THEN 'повторно [Имя 1] звонил' ELSE 'обычный текст' END").alias("text"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'en' ELSE 'ru' END").alias("language"))
    return st, second, now


def guard_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 + F10 + J5 + S2: second-batch texts rejected for another language
    or for containing an out issued by the first batch."""
    st, second, now = _two_batches(spark, sf_dir)
    r2 = mask_sessions(second, SETTINGS, mapping=st.mapping(), sessions=st.sessions(), now=now)
    return r2.rejected.select("session_id", (F.col("seq") - 1000000000).alias("c_custkey"), "reason")


def session_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 + A7: delete requests for the nations of one region plus ids that
    never existed; deleted = the session had a mapping."""
    st, _, now = _two_batches(spark, sf_dir)
    n = read_table(spark, sf_dir, "nation")
    req = (n.filter("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("session_id"))
           .unionByName(n.filter("n_regionkey = 1").select(F.concat(F.lit("gone-"), F.col("n_nationkey").cast("string"))
                                                          .alias("session_id"))))
    report, _ = S.delete_sessions(st.mapping(now), st.sessions(now), req)
    return report


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + S7 + S8: active sessions after deleting one region's nations, at
    the write time and after the TTL has run out."""
    st, _, now = _two_batches(spark, sf_dir)
    n = read_table(spark, sf_dir, "nation")
    req = n.filter("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("session_id"))
    _, (m2, s2, _) = S.delete_sessions(st.mapping(now), st.sessions(now), req)
    later = F.expr(f"{NOW} + INTERVAL {SETTINGS.mapping_ttl + 1} SECONDS")
    a = S.stats(s2, now).select(F.lit("at_write").alias("moment"), F.col("active_sessions").cast("long").alias("active_sessions"))
    b = S.stats(s2, later).select(F.lit("after_ttl").alias("moment"), F.col("active_sessions").cast("long").alias("active_sessions"))
    return a.unionByName(b)


def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + A10: canonical types found in documents, with counts."""
    p = prepare(_spread(_docs(spark, sf_dir)), SETTINGS)
    return (explode_rows(p, [], "spans").groupBy(F.col("x.ctype").alias("ctype"))
             .agg(F.count(F.lit(1)).alias("n")))


def type_counts_requisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + A10 over the customers' carrier texts, whose entities are known."""
    p = prepare(_requisite_texts(spark, sf_dir), SETTINGS)
    return (explode_rows(p, [], "spans").groupBy(F.col("x.ctype").alias("ctype"))
             .agg(F.count(F.lit(1)).alias("n")))


def language_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 + B6 over ``documents.lang``: every row comes back; a language without detectors of its own takes the English
    set, or is refused with its reason where the settings say so."""
    d = read_table(spark, sf_dir, "documents")
    t = _spread(texts_from(d, "doc_id", "text", language=F.col("lang"), session=F.col("doc_id").cast("string")))
    m = mask(t, SETTINGS, registry=_patterns("EMAIL"))
    strict = mask(t, SETTINGS.with_(other_languages=None), registry=_patterns("EMAIL")).select(
        F.col("seq").alias("doc_id"), F.lit("strict").alias("setting"), "reason", F.col("masked_text").isNull().alias("refused"))
    return m.select(F.col("seq").alias("doc_id"), F.lit("default").alias("setting"), "reason", F.col("masked_text").isNull().alias("refused")).unionByName(strict)


def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 + U2: a customer's text, an hour later (past the TTL) another one: the marker is issued anew and only the
    second original lives under it."""
    c = read_table(spark, sf_dir, "customer")
    m, s = S.empty_mapping(spark), S.empty_sessions(spark)
    for hour, name in ((0, "Иванов И. И."), (1, "Петров П. П.")):
        now = F.expr(f"{NOW} + INTERVAL {hour} HOURS")
        t = c.select(F.col("c_custkey").cast("string").alias("session_id"), F.lit(hour).cast("long").alias("seq"),
                     F.lit(f"пришёл {name} сюда").alias("text"), F.lit("ru").alias("language"))
        r = mask_sessions(t, SETTINGS, mapping=m, sessions=s, now=now)
        st = _store(spark, "expiry")
        st.write(*S.merge(m, s, r.entries, r.touched, now, SETTINGS.mapping_ttl))
        m, s = st.mapping(), st.sessions()
    return m.select("session_id", "out", "original")


def ner_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, F7, F8, F12, J1 with injected NER spans (X4 input shape): an ORG
    span running over a line break is clipped, a single all-caps word and a
    LOC span are dropped; the pattern hit next to it survives."""
    s = read_table(spark, sf_dir, "supplier")
    t = s.select(F.col("s_suppkey").cast("string").alias("session_id"), F.col("s_suppkey").alias("seq"),
                 F.expr("'ООО ' || s_name || ' \n БИК 04' || lpad(CAST(s_suppkey AS STRING), 7, '0') || ' ДОГОВОР'")
                 .alias("text"), F.lit("ru").alias("language"),
                 F.expr("length('ООО ' || s_name || ' \n БИК')").cast("int").alias("_org_end"))
    ner = (t.select("session_id", "seq", F.lit(0).alias("start"), F.col("_org_end").alias("end"),
                    F.lit("ORG").alias("entity_type"), F.lit(0).alias("idx"))
           .unionByName(t.select("session_id", "seq", (F.length("text") - 7).cast("int").alias("start"),
                                 F.length("text").cast("int").alias("end"), F.lit("PER").alias("entity_type"),
                                 F.lit(1).alias("idx")))
           .unionByName(t.select("session_id", "seq", F.lit(0).alias("start"), F.lit(3).alias("end"),
                                 F.lit("LOC").alias("entity_type"), F.lit(2).alias("idx"))))
    p = prepare(t.drop("_org_end"), SETTINGS, ner_spans=ner)
    return (explode_rows(p, [F.col("seq").alias("s_suppkey")], "spans")
            .select("s_suppkey", F.col("x.ctype").alias("ctype"), F.col("x.original").alias("original"),
                     F.col("x.start").alias("start"), F.col("x.end").alias("end")))


def _scratch(spark, name):
    ensure_checkpoint_dir(spark)
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


def stream_unmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5, S6, ST1-ST4, T6: masked documents cut into chunks and streamed through
    the chunk unmask; the chunks of each session concatenate to the original document, and no reply is left open."""
    base, store = _scratch(spark, "streams"), _store(spark, "stream")
    m = saved(mask(_spread(_docs(spark, sf_dir)), SETTINGS).select("session_id", "seq", "language", "masked_text", "entries"), "streams/masked")
    now = F.expr(NOW)
    store.add(entries_view(m), m.select("session_id", "language"), now, SETTINGS.mapping_ttl)
    cut_chunks(m.select("session_id", F.col("masked_text").alias("text"))).write.option("compression", "zstd").parquet(f"{base}/chunks")
    run_stream_unmask(spark, f"{base}/chunks", store, f"{base}/out", f"{base}/ckpt", SETTINGS, now=lambda epoch: F.expr(NOW))
    out = assemble(spark.read.parquet(f"{base}/out"))
    return out.join(m.select("session_id", _still_clear(m).alias("still_clear")), "session_id").crossJoin(F.broadcast(store.replies().agg(F.count("*").alias("open_replies")))).select(
        F.col("session_id").cast("long").alias("doc_id"), F.col("unmasked_text").alias("text"), "still_clear", "open_replies")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, S8, ST3, ST6, F11: a reply per customer in two chunks that cut a marker.  Between them a third of the sessions
    are deleted by delete events and another third expire: their second chunk comes back with a reason, and nothing stays held."""
    base, store = _scratch(spark, "streams"), _store(spark, "stream-sessions")
    c = _customers(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("session_id"), F.col("c_custkey").alias("k"))
    entries = c.select("session_id", F.lit("ru").alias("language"), F.lit("[Имя 1]").alias("out"), F.expr(carriers.surname("k")).alias("original"), F.lit("PERSON").alias("type"),
                       F.lit("marker").alias("kind"), F.lit(1).alias("index"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("ord"))
    for third, age in ((0, 0), (1, 10), (2, 0)):             # the second third was written earlier and expires first
        mine = c.where(F.col("k") % 3 == third).select("session_id", F.lit("ru").alias("language"))
        store.add(entries.join(mine.select("session_id"), "session_id", "left_semi"), mine, F.expr(f"{NOW} - INTERVAL {age} SECONDS"), SETTINGS.mapping_ttl)
    for seq, text in ((0, "Договор с [Им"), (1, "я 1] готов")):    # a micro-batch each, of all the files there are by then
        c.select("session_id", F.lit("r").alias("reply_id"), F.lit(seq).cast("long").alias("seq"), F.lit(text).alias("text"), F.lit(seq == 1).alias("is_final")).write.parquet(f"{base}/chunks/{seq}")
        c.where((F.col("k") % 3 == 0) & F.lit(seq == 1)).select("session_id").write.parquet(f"{base}/deletes/{seq}")
        at = F.expr(f"{NOW} + INTERVAL {seq and SETTINGS.mapping_ttl - 5} SECONDS")
        run_stream_unmask(spark, f"{base}/chunks/*", store, f"{base}/out", f"{base}/ckpt", SETTINGS, deletes_path=f"{base}/deletes/*",
                          now=lambda epoch, seq=seq, at=at: F.expr(f"{NOW} + INTERVAL 1 DAY") if epoch > 1 and seq else at)
    out = spark.read.schema("session_id string, reply_id string, seq long, unmasked_text string, reason string, epoch int").parquet(f"{base}/out")
    return out.crossJoin(F.broadcast(store.replies().agg(F.count("*").alias("open_replies")))).select(
        F.col("session_id").cast("long").alias("c_custkey"), "seq", "unmasked_text", "reason", "open_replies")


def stream_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, S2, S3: turns of conversations masked in two micro-batches (session = conversation): the second continues the first's
    entries; unmasked against the store, and the number of outs of each session."""
    base, store = _scratch(spark, "streams"), _store(spark, "stream-mask")
    c = read_table(spark, sf_dir, "conversations")
    t = c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("seq"), F.expr(carriers.turn_text_sql()).alias("text"), F.lit("en").alias("language"),
                 F.lit(False).alias("prepend_hint"))
    half = t.groupBy("session_id").agg(F.min("seq").alias("first"))
    t = t.join(half, "session_id")
    t = t.repartition(2 * spark.sparkContext.defaultParallelism, "session_id", "seq") if t.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else t
    for i in (0, 1):                                         # each conversation's first turn, then the others: a micro-batch each, of all the files there are by then
        t.where((F.col("seq") == F.col("first")) == F.lit(i == 0)).drop("first").write.parquet(f"{base}/texts/{i}")
        run_stream_mask(spark, f"{base}/texts/*", store, f"{base}/out", f"{base}/ckpt", SETTINGS, now=lambda epoch: F.expr(NOW))
    masked = spark.read.parquet(f"{base}/out/masked")
    mapping = store.mapping(F.expr(NOW)).checkpoint()
    u = unmask(masked.select("session_id", "seq", F.col("masked_text").alias("text")), mapping, SETTINGS)
    u = u.join(masked.select("session_id", "seq", _still_clear(masked).alias("still_clear")), ["session_id", "seq"]).join(
        mapping.groupBy("session_id").agg(F.count(F.lit(1)).alias("outs")), "session_id")
    return u.select(F.col("session_id").cast("long").alias("conv_id"), F.col("seq").alias("turn"), F.col("unmasked_text").alias("text"), "still_clear", "outs")


def unmask_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions imported from JSON with outs of other shapes (eight digits, free text, a marker under another label);
    replies are restored, and a text that holds such an out is refused."""
    c = _customers(spark, sf_dir).select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("session_id"))
    docs = c.select("session_id", F.expr(carriers.imported_json_sql("k")).alias("json"))
    store = _store(spark, "import")
    store.write(*S.import_json(docs, F.expr(NOW), SETTINGS.mapping_ttl))
    now = F.expr(NOW)
    replies = c.select("session_id", F.lit(0).cast("long").alias("seq"), F.expr(carriers.imported_reply_sql("k")).alias("text"))
    u = unmask(replies, store.mapping(now), SETTINGS)
    again = c.select("session_id", F.col("k").alias("seq"), F.expr("CASE WHEN k % 2 = 0 THEN concat('see ', lpad(CAST(k AS STRING), 8, '7')) ELSE 'nothing' END").alias("text"), F.lit("en").alias("language"))
    refused = mask_sessions(again, SETTINGS, mapping=store.mapping(now), sessions=store.sessions(now), now=now).rejected
    return u.join(refused.select("session_id", "reason"), "session_id", "left").select(F.col("session_id").cast("long").alias("c_custkey"), F.col("unmasked_text").alias("text"), "tokens_replaced", "reason")


def store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after two appends, an append that is run again, a delete, a renewed life and a compaction."""
    st = _store(spark, "log")
    n = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("session_id"), F.col("c_custkey").alias("k"))
    touched = n.select("session_id", F.lit("ru").alias("language")).distinct()

    def entries(of, rest):
        return of.where(F.col("k") % 2 == rest).select("session_id", F.lit("ru").alias("language"), F.concat(F.lit("out-"), F.col("k").cast("string")).alias("out"), F.col("k").cast("string").alias("original"),
                                                       F.lit("INN").alias("type"), F.lit("surrogate").alias("kind"), F.lit(None).cast("int").alias("index"), F.col("k").alias("seq"), F.lit(0).alias("ord"))

    def at(seconds):
        return F.expr(f"{NOW} + INTERVAL {seconds} SECONDS")

    st.add(entries(n, 0), touched, at(0), SETTINGS.mapping_ttl, key="first")
    for _ in range(2):                                       # run again: the same rows
        st.add(entries(n, 1), touched.where("session_id < '2'"), at(100), SETTINGS.mapping_ttl, key="second")
    gone = read_table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("session_id"))
    st.delete(gone, at(100))
    back = gone.select("session_id", F.lit("en").alias("language"))
    st.add(entries(n.join(gone, "session_id", "left_semi"), 1), back, at(150), SETTINGS.mapping_ttl)
    st.compact(at(150))
    summary = S.session_summary(st.mapping(at(350)))
    return st.sessions(at(350)).join(summary, "session_id", "left").select("session_id", "language", F.coalesce("tokens_total", F.lit(0)).cast("long").alias("tokens_total"),
                                                                          F.coalesce("outs", F.lit(0)).cast("long").alias("outs"))


def detect_phone_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """International phone numbers in documents."""
    t = _docs(spark, sf_dir)
    d = detect_spans(t, SETTINGS, keys=("seq",), registry=_patterns("PHONE_NUMBER"))
    return d.select(F.col("seq").alias("doc_id"), "start", "end", "original")


def context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: the same 10-digit shape scores 0.75 as INN without a context word
    in the 5 words to its left and 1.0 with one; PASSPORT_NOSPACE stays 0.70."""
    c = _customers(spark, sf_dir)
    t = c.select(F.col("c_custkey").cast("string").alias("session_id"), F.col("c_custkey").alias("seq"),
                 F.expr(carriers.text_sql(carriers.BOOST_SEGMENTS)).alias("text"), F.lit("ru").alias("language"))
    d = detect_spans(t, SETTINGS)
    return d.select(F.col("seq").alias("c_custkey"), "pattern", "start", F.col("score").cast("double").alias("score"))


def masked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 + W3: offsets of every out in the masked carrier text."""
    m = mask(_requisite_texts(spark, sf_dir), SETTINGS)
    return (explode_rows(m, [F.col("seq").alias("c_custkey")], "masked_spans")
            .select("c_custkey", F.col("x.type").alias("type"), F.col("x.start").alias("start"),
                     F.col("x.end").alias("end")))


def unmask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: a reply quoting the masked text twice restores both copies and
    counts every occurrence (24 = 12 entities x 2)."""
    m = mask(_requisite_texts(spark, sf_dir), SETTINGS)
    reply = m.withColumn("masked_text", F.concat("masked_text", F.lit(" / "), "masked_text"))
    u = unmask_with_entries(reply, SETTINGS)
    return u.select(F.col("seq").alias("c_custkey"), F.col("unmasked_text").alias("text"), "tokens_replaced")


def mask_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 + T8 + F15: a hint only when a marker was written; prepended (with
    shifted spans) when asked."""
    c = _customers(spark, sf_dir)
    t = c.select(F.col("c_custkey").cast("string").alias("session_id"), F.col("c_custkey").alias("seq"),
                 F.expr(carriers.hint_text_sql("c_custkey")).alias("text"), F.lit("ru").alias("language"),
                 F.expr("c_custkey % 4 = 0").alias("prepend_hint"))
    m = mask(t, SETTINGS)
    first = F.col("masked_spans")[0]
    return m.select(F.col("seq").alias("c_custkey"), "hint",
                    F.substring("masked_text", first["start"] + 1, first["end"] - first["start"]).alias("first_out"),
                    first["start"].alias("first_start"))


def _named_texts(spark, sf_dir, language="ru"):
    """A text per order: its customer, a supplier and this one's nation."""
    sup = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n = read_table(spark, sf_dir, "supplier").agg(F.max("s_suppkey") + 1).first()[0]
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = (orders.withColumn("s_suppkey", F.col("o_orderkey") % n).join(sup, "s_suppkey")
            .join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")))
    rows = _dealt(rows.select("o_orderkey", "s_name", "n_name", "c_name"), "o_orderkey", like=orders)
    return rows.select(F.col("o_orderkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("seq"), F.expr(carriers.text_sql(carriers.NAME_SEGMENTS)).alias("text"),
                       F.lit(language).alias("language"))


def _names(spark, sf_dir):
    """The gazetteer: suppliers, customers and nations."""
    parts = [read_table(spark, sf_dir, t).select(F.col(c).alias("name"), F.lit(kind).alias("entity_type"))
             for t, c, kind in (("supplier", "s_name", "ORG"), ("customer", "c_name", "PER"), ("nation", "n_name", "LOC"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def gazetteer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers, customers and nations in texts, by joins on first words and on names."""
    hits = gazetteer_spans(_named_texts(spark, sf_dir), _names(spark, sf_dir))
    return hits.select(F.col("seq").alias("o_orderkey"), F.col("entity_type").alias("ctype"), "original", "start", "end")


def tagged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence model learnt from the gazetteer's spans in the texts of even customers finds the names in all texts."""
    t = _named_texts(spark, sf_dir)
    some = t.join(read_table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("seq")), "seq", "left_semi")
    found = tagged_spans(t, train(some, gazetteer_spans(some, _names(spark, sf_dir))))
    return found.select(F.col("seq").alias("o_orderkey"), F.col("entity_type").alias("ctype"), "start", "end")


def mask_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 + D15 + D16 + F12: the gazetteer's spans go through masking as NER spans; LOC is not masked."""
    t = _named_texts(spark, sf_dir)
    m = mask(t, SETTINGS, ner_spans=gazetteer_spans(t, _names(spark, sf_dir)), ner="both")
    return m.select(F.col("seq").alias("o_orderkey"), "masked_text")


def detect_phone_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of ten calling codes found by the numbering plan, without the digits after them; unknown codes and wrong lengths are none."""
    c = _customers(spark, sf_dir)
    t = c.select(F.col("c_custkey").cast("string").alias("session_id"), F.col("c_custkey").alias("seq"), F.expr(carriers.text_sql(carriers.PLAN_SEGMENTS)).alias("text"),
                 F.lit("en").alias("language"))
    d = detect_spans(t, SETTINGS, registry=_patterns("PHONE_PLAN"))
    return d.select(F.col("seq").alias("c_custkey"), "start", "end", "original")


def context_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: context words in another form, and terms of several words, raise a hit's score as the listed form does."""
    c = _customers(spark, sf_dir)
    t = c.select(F.col("c_custkey").cast("string").alias("session_id"), F.col("c_custkey").alias("seq"), F.expr(carriers.text_sql(carriers.FORM_SEGMENTS)).alias("text"),
                 F.lit("ru").alias("language"))
    d = detect_spans(t, SETTINGS, registry=_patterns("VIN"))
    return d.select(F.col("seq").alias("c_custkey"), "start", F.col("score").cast("double").alias("score"))


def type_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: e-mail and card hits in documents by language and type, by language and in all (grouping sets)."""
    d = read_table(spark, sf_dir, "documents")
    t = _spread(texts_from(d, "doc_id", "text", language=F.lit("en"), session=F.col("lang")))
    hits = detect_spans(t, SETTINGS, registry=_patterns("EMAIL", "CARD_SPACED", "CARD_AMEX", "CARD_PLAIN"))
    return type_counts_by(hits.select(F.col("session_id").alias("lang"), canonical(F.col("entity_type")).alias("ctype")), "lang", "ctype")


def _tuned(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {
    "detect_email": detect_email,
    "detect_card_luhn": detect_card_luhn,
    "detect_requisites": detect_requisites,
    "mask_requisites": mask_requisites,
    "surrogate_values": surrogate_values,
    "roundtrip_documents": roundtrip_documents,
    "roundtrip_pages": roundtrip_pages,
    "roundtrip_conversations": roundtrip_conversations,
    "unmask_sessions": unmask_sessions,
    "marker_numbering": marker_numbering,
    "guard_rejections": guard_rejections,
    "session_delete": session_delete,
    "session_stats": session_stats,
    "type_counts": type_counts,
    "type_counts_requisites": type_counts_requisites,
    "language_routing": language_routing,
    "session_expiry": session_expiry,
    "ner_clip": ner_clip,
    "stream_unmask": stream_unmask,
    "detect_phone_number": detect_phone_number,
    "context_boost": context_boost,
    "masked_spans": masked_spans,
    "unmask_counts": unmask_counts,
    "mask_hint": mask_hint,
    "gazetteer_hits": gazetteer_hits,
    "mask_gazetteer": mask_gazetteer,
    "tagged_names": tagged_names,
    "detect_phone_plan": detect_phone_plan,
    "context_forms": context_forms,
    "type_rollup": type_rollup,
    "stream_sessions": stream_sessions,
    "stream_mask": stream_mask,
    "unmask_imported": unmask_imported,
    "store_log": store_log,
}
QUERIES = {k: _tuned(v) for k, v in QUERIES.items()}
