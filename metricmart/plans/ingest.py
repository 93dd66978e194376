"""Batch write of export requests into the store.

One function serves batch jobs and streaming ``foreachBatch`` alike:

1. validate (whole requests are accepted or rejected, B6) and flatten in one
   pass over the requests into a staging folder below ``spark.checkpoint.dir``,
   by kind (points of every stored type, rejected requests, dropped metrics); the
   received, dropped and rejected counts are observed in that pass (E6, B9);
2. write metadata FIRST (and the attribute table from it), then facts (S19: no
   point without metadata), then rejects, all from the staged rows; an empty table is not written (B10);
3. record the writes in the audit log, once per batch (E8/E9), and what was
   received and dropped with them.

A batch writes sub-partitions of its own generation, named by its id, and adds
them to the catalog when their files are all there: a batch written again under
its id replaces itself, in the facts as in the logs.

Facts are range-partitioned by (day, time) from sampled bounds and sorted within
each task by (dt, time, hash) (H11): the files that a batch writes for one day do
not overlap in time. A batch's metadata is merged before it is written: its winners
are found on narrow rows, and only they are joined to their maps and texts.
"""

from __future__ import annotations

import datetime as _dt
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from metricmart.operators.extensions import attribute_rows
from metricmart.operators.flatten import (DROPPED, GAUGE, OTHER_TABLE, REJECTED, SUM, flatten_batch,
                                          gauge_rows, other_rows, sum_rows)
from metricmart.operators.metadata import batch_metadata, metadata_rows
from metricmart.operators.validate import with_validation
from metricmart.plans.catalog import HASH_BLOOM_NDV, MetricStore, bloom_options, delete_path
from metricmart.plans.generations import add_partitions, batch_generation, partitions
from metricmart.schemas import AUDIT, GENERATION, METADATA, TABLES
from metricmart.session import checkpoint_root

# Audit rows beside those of tables: points received in accepted requests, and
# points of types that are not stored.
RECEIVED, DROPPED_POINTS = "received_points", "dropped_points"
# A table's points of one batch up to this number are written by one task, in order, as they are.
ONE_TASK_ROWS = 200_000


def new_batch_id(store: MetricStore | None = None) -> int:
    """Monotonic across runs, so that later batches win the metadata merge: the
    clock, or one more than the greatest id in the audit log if that is later
    (a clock that was set back, another driver's clock)."""
    now = time.time_ns() // 1000
    if store is None:
        return now
    days = [s["day"] for s in partitions(store, "ingest_audit")]    # names; only the last day is read
    if not days:
        return now
    last = store.table("ingest_audit").where(F.col("day") == F.lit(max(days)).cast("date")).agg(F.max("batch_id")).first()[0]
    return now if last is None else max(now, last + 1)


def _write(store: MetricStore, table: str, rows: DataFrame, generation: str) -> int:
    """Write one table's rows as sub-partitions of a generation, in place of those it has already."""
    schema, (key,) = TABLES[table]
    obs = Observation(f"{table}_{uuid.uuid4().hex}")
    observed = rows.observe(obs, F.count(F.lit(1)).alias("rows"), F.collect_set(F.col(key).cast("string")).alias("values"))
    options = bloom_options(HASH_BLOOM_NDV) if "metric_hash" in schema.fieldNames() else {}
    (observed.withColumn(GENERATION, F.lit(generation)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .options(**options).partitionBy(key, GENERATION).parquet(store.path(table)))
    found = obs.get
    add_partitions(store, table, [{key: v, GENERATION: generation} for v in sorted(found.get("values") or [])])
    return int(found.get("rows", 0) or 0)


def _record(store: MetricStore, rows: list, at: _dt.datetime, generation: str) -> None:
    full = [(*r, at, at.date()) for r in rows]
    _write(store, "ingest_audit", store.spark.createDataFrame(full, AUDIT).coalesce(1), generation)


def _append(store: MetricStore, table: str, df: DataFrame, batch_id: int, writer: str,
            pending: list, at: _dt.datetime) -> int:
    """Write one table and queue its audit row; a failed write is recorded at once, and stays
    recorded when the batch is written again."""
    t0 = time.perf_counter()
    try:
        rows = _write(store, table, df, batch_generation(batch_id))
    except Exception:
        row = (batch_id, table, "error", 0, (time.perf_counter() - t0) * 1000.0, writer)
        _record(store, [row], at, f"e{uuid.uuid4().hex}")
        raise
    pending.append((batch_id, table, "ok", rows, (time.perf_counter() - t0) * 1000.0, writer))
    return rows


def write_batch(store: MetricStore, requests: DataFrame, batch_id: int | None = None,
                rebalance: bool = True, store_other_types: bool = False,
                premerge_metadata: bool = True, writer: str = "batch",
                at: float | None = None, one_task_rows: int = ONE_TASK_ROWS, on_commit: Callable[[str], None] | None = None) -> dict:
    """Ingest one batch of requests. Returns row counts per table.

    ``batch_id`` names the batch: written again under the same id, it replaces its
    own rows (so different batches need different ids; None takes a new one).
    ``at`` (seconds) is the time of the batch's first attempt, for its log rows.

    ``rebalance`` range-partitions facts by day and time: Spark samples the bounds,
    and adaptive execution merges small partitions, so a day gets as many
    files as its size asks for and they do not overlap in time. Up to ``one_task_rows``
    points of a table need no bounds: one task sorts and writes them. Turn it off for
    micro-batches that fit a few files as they are.

    ``premerge_metadata`` merges the batch's keep-first metadata rows (E2)
    before appending: the merge is a max over the insertion order, which is
    associative, so merged reads are unchanged while the metadata log grows
    by one row per series-day per batch instead of per request.

    ``writer`` tags the audit rows; ``on_commit`` is told each table as it is written.

    ``store_other_types`` (extension X2–X4, off by default as in the
    reference) also stores histogram, exponential-histogram and summary points
    and their metadata, from the same pass.
    """
    spark = store.spark
    batch_id = new_batch_id(store) if batch_id is None else batch_id
    began = _dt.datetime.fromtimestamp(time.time() if at is None else at, _dt.timezone.utc)
    staging = f"{checkpoint_root(spark)}/ingest/{uuid.uuid4().hex}"
    t0 = time.perf_counter()
    others = list(OTHER_TABLE) if store_other_types else []
    stored = [GAUGE, SUM, *others]
    flat = flatten_batch(with_validation(requests), batch_id, others)
    seen = Observation(f"flatten_{batch_id}")
    flat.observe(seen, *[F.count_if(F.col("kind") == k).alias(k) for k in (*stored, REJECTED)],
                 F.sum("dropped").alias(DROPPED)).write.partitionBy("kind").parquet(staging)
    n = {k: int(v or 0) for k, v in seen.get.items()}
    took = (time.perf_counter() - t0) * 1000.0
    received = sum(n.get(k, 0) for k in stored)
    pending: list = [(batch_id, name, "ok", rows, took, writer)
                     for name, rows in ((RECEIVED, received), (DROPPED_POINTS, n.get(DROPPED, 0))) if rows]
    counts = dict.fromkeys(["series_metadata", "metrics_gauge", "metrics_sum"], 0)

    def put(table: str, rows: DataFrame) -> None:
        counts[table] = _append(store, table, rows, batch_id, writer, pending, began)
        if on_commit:
            on_commit(table)

    def by_time(rows: DataFrame, number: int) -> DataFrame:
        if rebalance:
            rows = rows.coalesce(1) if number <= one_task_rows else rows.repartitionByRange("dt", "time_unix_nano")
        return rows.sortWithinPartitions("dt", "time_unix_nano", "metric_hash")

    def keep(winners: DataFrame) -> DataFrame:
        winners.write.parquet(f"{staging}-winners")
        return spark.read.schema(winners.schema).parquet(f"{staging}-winners")

    try:
        staged = spark.read.schema(flat.schema).parquet(staging) if sum(n.values()) else flat.limit(0)
        points = staged.where(F.col("kind").isin(stored))
        if received:
            meta = batch_metadata(points, keep) if premerge_metadata else metadata_rows(points)
            meta = meta.select(*METADATA.fieldNames())
            if rebalance:
                meta = meta.hint("rebalance", "month")
            put("series_metadata", meta.sortWithinPartitions("dt", "metric_name", "metric_hash"))  # H12
            own = F.col(GENERATION) == batch_generation(batch_id)
            written = spark.table(store.name("series_metadata")).where(own)
            _write(store, "series_attributes", attribute_rows(written).sortWithinPartitions(
                "level", "attr_key", "attr_value", "dt"), batch_generation(batch_id))
        for kind, table, rows_of in ((GAUGE, "metrics_gauge", gauge_rows), (SUM, "metrics_sum", sum_rows)):
            if n.get(kind):
                put(table, by_time(rows_of(points.where(F.col("kind") == kind)), n[kind]))
        for mtype in others:
            if n.get(mtype):
                put(OTHER_TABLE[mtype], by_time(other_rows(points.where(F.col("kind") == mtype), mtype), n[mtype]))
            else:
                counts[OTHER_TABLE[mtype]] = 0
        counts["rejected_requests"] = 0
        if n.get(REJECTED):
            put("rejected_requests", staged.where(F.col("kind") == REJECTED)
                .select("batch_id", "request_seq", "request_part", "error", F.lit(began.date()).alias("day")))
        if pending:
            _record(store, pending, began, batch_generation(batch_id))
    finally:
        for folder in (staging, f"{staging}-winners"):
            delete_path(spark, folder)
    return counts
