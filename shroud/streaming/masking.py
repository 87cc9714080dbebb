"""ST5: stateful masking of a stream of texts.

Each micro-batch is masked with :func:`shroud.operators.sessions.mask_sessions`
against the entries of its own sessions in the store (so successive texts of a session
reuse outs and continue the marker counters); the masked rows and rejections are
written to the epoch's own folder, and the new entries are appended to the store - all
inside ``foreachBatch``.  A batch has one time for all it does.  An epoch that is run again
after a failure replaces its folder; if the store already has its entries, it has been done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from .. import config as C
from ..operators.mask import masked_view
from ..operators.sessions import mask_sessions
from ..sources.store import Store
from ..sources.texts import TEXTS_SCHEMA
from .chunks import this_moment


def mask_batch(batch: DataFrame, store: Store, s: C.Settings, out_path: str, now: Column | None = None, epoch: int = 0, key: str | None = None, **kw) -> None:
    if key is not None and store.committed(key):
        return
    now = now if now is not None else this_moment()
    seen = store.latest() or 0
    r = mask_sessions(batch, s, mapping=store.mapping(now, of=batch), sessions=store.sessions(now, of=batch), now=now, **kw)
    entries, touched = r.entries.checkpoint(), r.touched.checkpoint()
    masked_view(r.masked).write.mode("overwrite").parquet(f"{out_path}/masked/epoch={epoch}")
    r.rejected.write.mode("overwrite").parquet(f"{out_path}/rejected/epoch={epoch}")
    store.add(entries, touched, now, s.mapping_ttl, key=key, seen=seen)


def run_stream_mask(spark: SparkSession, texts_path: str, store: Store, out_path: str, checkpoint_path: str,
                    s: C.Settings, files_per_trigger: int | None = None, now: Callable[[int], Column] | None = None) -> None:
    reader = spark.readStream.schema(TEXTS_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(texts_path)
    q = (stream.writeStream.foreachBatch(lambda df, epoch: mask_batch(df, store, s, out_path, now(epoch) if now else None, epoch, key=f"{checkpoint_path}#{epoch}"))
         .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
    q.awaitTermination()
