"""Continuous ingest (K1–K4).

``readStream`` of request files -> ``foreachBatch(write_batch)``. Each
micro-batch is validated, flattened and appended exactly like a batch job
(same function), metadata first. There is no watermark: any non-zero
timestamp is accepted however late, and late points land in their own day
(dropping them would lose data the reference keeps). Metadata state does not
live in the stream either; it is appended per batch and merged on read (E2),
with periodic compaction (H15) — so no state store grows with the series.

Every epoch is a batch whose id, kept below the store until the next epoch, is the
same when Spark replays it: the replay writes the same generation again, in place
of whatever a failed attempt left, down to part of one table's commit. So each
point lands once, and the audit log counts each epoch once. The ids are kept by
an id that lies in the stream's own checkpoint folder: two streams, or one stream
restarted on a new checkpoint, never share any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from metricmart.plans.catalog import MetricStore
from metricmart.plans.generations import Epochs
from metricmart.plans.ingest import new_batch_id, write_batch
from metricmart.session import checkpoint_root
from metricmart.sources.requests import in_line_order, read_request_stream


def epoch_batch(store: MetricStore, batch: DataFrame, epoch_id: int, epochs: Epochs,
                on_commit: Callable[[str], None] | None = None, **options) -> dict:
    """One micro-batch, replay-safe: a replay replaces what the epoch has written."""
    batch_id, at = epochs.batch(epoch_id, lambda: new_batch_id(store))
    return write_batch(store, in_line_order(batch), batch_id, writer=f"stream:{epoch_id}", at=at, on_commit=on_commit, **options)


def start_ingest(store: MetricStore, source: str | DataFrame, fmt: str = "json",
                 checkpoint: str | None = None, max_files_per_trigger: int | None = 1000,
                 processing_time: str | None = None, available_now: bool = False,
                 query_name: str | None = None) -> StreamingQuery:
    """K1: start the ingest stream. ``max_files_per_trigger`` / ``processing_time``
    size the micro-batches (K2: many small requests become one larger write);
    the default file cap keeps a backlog from landing in one micro-batch.

    ``checkpoint`` is a shared folder of this stream alone; it may be left out
    only for a named query, which then has one below ``spark.checkpoint.dir``."""
    if not checkpoint and not query_name:
        raise ValueError("an unnamed stream needs a checkpoint folder of its own")
    spark = store.spark
    stream = source if isinstance(source, DataFrame) else \
        read_request_stream(spark, source, fmt, max_files_per_trigger)
    ckpt = checkpoint or f"{checkpoint_root(spark)}/streams/{query_name}"
    epochs = Epochs(store, ckpt)

    def run(batch: DataFrame, epoch_id: int) -> None:
        epoch_batch(store, batch, epoch_id, epochs)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
