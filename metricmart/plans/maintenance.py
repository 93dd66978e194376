"""Table maintenance: retention expiry (H13, H14, H16), metadata compaction
(H15), fact-day and log compaction.

Expiry works on whole partitions only: the partition list comes from the
catalog (names, never row data), expired ones are dropped from the catalog and
their folders deleted. Compaction merges a partition's write generations into
one and swaps them in the catalog; runs on one partition exclude each other,
runs on others and appends go on beside it (``generations``).
"""

from __future__ import annotations

import contextlib
import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.operators.metadata import series_current
from metricmart.operators.retention import cutoff_date
from metricmart.plans.catalog import HASH_BLOOM_NDV, MetricStore, bloom_options
from metricmart.plans.generations import (PartitionBusy, drop_partitions, lease, open_generations, partitions,
                                          recover, replace)
from metricmart.schemas import TABLES

FACT_TABLES = ("metrics_gauge", "metrics_sum", "metrics_histogram",
               "metrics_exponential_histogram", "metrics_summary")


def list_partitions(store: MetricStore, table: str) -> list[dict]:
    """Days (or months) of a table, one entry each."""
    (key,) = TABLES[table][1]
    return [{key: v} for v in sorted({s[key] for s in partitions(store, table)})]


def _drop_values(store: MetricStore, table: str, key: str, values: list[str]) -> int:
    """Drop partitions with all their generations, but those that a compaction holds now."""
    if not values:
        return 0
    with contextlib.ExitStack() as held:
        free = set()
        for value in values:
            with contextlib.suppress(PartitionBusy):
                held.enter_context(lease(store, table, f"{key}={value}", "expiry"))
                free.add(value)
        drop_partitions(store, table, [s for s in partitions(store, table) if s[key] in free])
    return len(free)


def expire(store: MetricStore, today=None, retention_days: int | None = None) -> dict:
    """Drop fact days with dt < today - N, and metadata months that end before
    the cutoff (the boundary month is cut on read, and by compaction)."""
    today = today or _dt.datetime.now(_dt.timezone.utc).date()   # days are UTC everywhere
    days = store.retention_days if retention_days is None else retention_days
    cut = cutoff_date(today, days)
    dropped = {}
    for table in FACT_TABLES:
        dropped[table] = _drop_values(store, table, "dt", [s["dt"] for s in list_partitions(store, table)
                                                           if _dt.date.fromisoformat(s["dt"]) < cut])
    cut_month = cut.year * 100 + cut.month
    for table in ("series_metadata", "series_attributes"):
        dropped[table] = _drop_values(store, table, "month", [
            s["month"] for s in list_partitions(store, table) if int(s["month"]) < cut_month])
    return dropped


def recover_compactions(store: MetricStore, table: str) -> int:
    """Complete the runs of a table that died after they added their generation, and undo the
    other dead ones. How many were completed."""
    return recover(store, table)


def compact_metadata(store: MetricStore, month: int, today=None, retention_days: int | None = None,
                     after_staging=None) -> int:
    """Rewrite one month of metadata as one merged row per (dt, name, hash).

    ``after_staging`` is called once the rewritten rows are staged (tests append
    or fail there)."""
    columns = store.table("series_metadata").columns

    def merge(meta: DataFrame) -> DataFrame:
        if today is not None:
            days = store.retention_days if retention_days is None else retention_days
            meta = meta.where(F.col("dt") >= F.lit(cutoff_date(today, days)))
        merged = series_current(meta).withColumn("month", F.lit(month))
        return merged.select(*columns).sortWithinPartitions("dt", "metric_name", "metric_hash")

    return replace(store, "series_metadata", month, merge, bloom_options(HASH_BLOOM_NDV), open_generations(store), after_staging)


def compact_attributes(store: MetricStore, month: int, after_staging=None) -> int:
    """Rewrite one month of the attribute table without the repeats of several batches, sorted by attribute."""
    def merge(rows: DataFrame) -> DataFrame:
        order = ("level", "attr_key", "attr_value", "dt")
        return rows.distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    return replace(store, "series_attributes", month, merge, bloom_options(HASH_BLOOM_NDV), open_generations(store), after_staging)


def compact_day(store: MetricStore, table: str, day: str, after_staging=None) -> int:
    """Rewrite one fact day as a few large files sorted by (time, hash).

    Streaming ingest appends small files per micro-batch; this is the
    counterpart of background part merges. The day is range-partitioned on
    time, so the new files do not overlap in time and a range inside the day
    skips whole files."""
    return replace(store, table, day,
                   lambda facts: facts.repartitionByRange("time_unix_nano")
                   .sortWithinPartitions("time_unix_nano", "metric_hash"),
                   bloom_options(HASH_BLOOM_NDV), open_generations(store), after_staging)


def compact_log(store: MetricStore, table: str, today=None, retention_days: int | None = None,
                after_staging=None) -> int:
    """Drop the days of ``ingest_audit`` or ``rejected_requests`` before the retention cutoff (by
    the time of each row's batch, not its id) and merge the generations of each other day that
    has several. Returns the rows of the merged days."""
    today = today or _dt.datetime.now(_dt.timezone.utc).date()
    days = store.retention_days if retention_days is None else retention_days
    cut = cutoff_date(today, days)
    listed = [s["day"] for s in list_partitions(store, table)]
    _drop_values(store, table, "day", [d for d in listed if _dt.date.fromisoformat(d) < cut])
    rows = 0
    for day in listed:
        if _dt.date.fromisoformat(day) >= cut:
            rows += replace(store, table, day, lambda log: log.repartitionByRange("batch_id").sortWithinPartitions("batch_id"), {},
                            open_generations(store), after_staging, least=2)
    return rows
