"""Benchmark: headline de-identification queries at $BENCH_SF_DIR on
local[$BENCH_CPUS]; prints one JSON line.

Each query is forced with a ``noop`` write (full computation, no collect).
Throughput of the text work is reported next to the times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from shroud.operators.mask import mask, prepare  # noqa: E402
from shroud.operators.sessions import mask_sessions  # noqa: E402
from shroud.operators.unmask import unmask, unmask_with_entries  # noqa: E402
from shroud.plans.queries import NOW, SETTINGS, _docs, _requisite_texts  # noqa: E402
from shroud.session import local_session  # noqa: E402
from shroud.sources.texts import read_table, texts_from  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16)
    parts = max(16, 4 * (int(cpus) if cpus.isdigit() else 8))

    def docs():
        # documents.parquet is one row group: spread the texts before detection
        return _docs(spark, sf_dir).repartition(parts, "seq")

    def pages():
        p = read_table(spark, sf_dir, "pages")
        return texts_from(p, "page_id", "html", language=F.lit("en"),
                          session=F.col("page_id").cast("string")).repartition(parts, "seq")

    def q_detect():
        return prepare(docs(), SETTINGS).select("seq", F.size("spans").alias("n"))

    def q_mask():
        return mask(docs(), SETTINGS).select("seq", "masked_text", "masked_spans", "entries")

    def q_roundtrip():
        return unmask_with_entries(mask(docs(), SETTINGS), SETTINGS).select("seq", "unmasked_text")

    def q_mask_pages():
        return mask(pages(), SETTINGS).select("seq", "masked_text")

    def q_sessions_unmask():
        d = read_table(spark, sf_dir, "documents")
        t = d.select(F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), "text",
                     F.lit("en").alias("language")).repartition(parts, "seq")
        r = mask_sessions(t, SETTINGS, now=F.expr(NOW))
        masked = r.masked.select("session_id", "seq", F.col("masked_text").alias("text"))
        return unmask(masked, r.entries, SETTINGS)

    def q_mask_ru():
        # the Russian path, the reference's default: carrier texts with every requisite
        t = _requisite_texts(spark, sf_dir)
        return mask(t.repartition(parts, "seq"), SETTINGS).select("seq", "masked_text", "entries")

    queries = {
        "detect_documents": q_detect,
        "mask_documents": q_mask,
        "roundtrip_documents": q_roundtrip,
        "mask_pages": q_mask_pages,
        "mask_requisites_ru": q_mask_ru,
        "mask_sessions_unmask": q_sessions_unmask,
    }
    chars = read_table(spark, sf_dir, "documents").agg(F.sum(F.length("text"))).collect()[0][0]
    times, builds = {}, {}
    for name, fn in queries.items():
        t0 = time.time()
        df = fn()
        builds[name] = round(time.time() - t0, 3)     # part of the time: making the DataFrame, before any output
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "build": builds,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": cpus, "document_chars": int(chars),
        "mask_chars_per_sec": int(chars / times["mask_documents"]) if times["mask_documents"] else None,
    }))


if __name__ == "__main__":
    main()
