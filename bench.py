"""Benchmark: ingest and headline queries on the stored tables.

  1. source prep (timed separately, not in the total): the events table is
     bridged into nested OTLP export requests, written once as Parquet;
  2. ingest: read requests -> validate -> flatten -> keep-first metadata ->
     append metadata, gauge, sum (points/s reported);
  3. reads on the stored, partitioned tables: one-day enriched range, latest
     20 gauge / sum, merged series listing, series lookup by hash, name in
     range, hash-only enrichment of every gauge point, ingest stats,
     retention expiry + metadata compaction.
Also reported: bytes a one-day query scans against the whole gauge table.

Prints ONE JSON line. Env: BENCH_SF_DIR (default /root/testdata/sf0.1),
BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from metricmart.operators import query as Q  # noqa: E402
from metricmart.operators import stats as S  # noqa: E402
from metricmart.operators.metadata import series_current  # noqa: E402
from metricmart.plans.catalog import create_tables, latest_points_recent  # noqa: E402
from metricmart.plans.ingest import write_batch  # noqa: E402
from metricmart.plans.maintenance import compact_metadata, expire  # noqa: E402
from metricmart.session import build_session, checkpoint_root  # noqa: E402
from metricmart.sources.events_bridge import bridge_requests  # noqa: E402
from metricmart.sources.requests import read_requests, write_requests  # noqa: E402

DAY = ("2024-01-15T00:00:00", 1705363199999999000)          # one UTC day, inclusive
TWO_DAYS = (1705708800000000000, 1705881599999999000)       # 2024-01-20 .. 2024-01-21
NAME_RANGE = (1704844800000000000, 1705060800000000000)


def _timed(fn, repeat=2):
    best, out = None, None
    for _ in range(repeat):
        t0 = time.perf_counter()
        out = fn()
        dt = time.perf_counter() - t0
        best = dt if best is None else min(best, dt)
    return round(best, 3), out


def _dir_bytes(path: str) -> int:
    total = 0
    for d, _, files in os.walk(path):
        total += sum(os.path.getsize(os.path.join(d, f)) for f in files if f.endswith(".parquet"))
    return total


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(2, cpus),
                          extra={"spark.driver.memory": "16g"})
    work = tempfile.mkdtemp(prefix="metricmart-bench-")
    checkpoint_root(spark)          # the session's checkpoint folder; a scratch one only if unset

    t0 = time.perf_counter()
    write_requests(bridge_requests(spark, sf_dir).repartition(cpus * 2), f"{work}/requests",
                   fmt="parquet")
    prep = round(time.perf_counter() - t0, 3)

    requests = read_requests(spark, f"{work}/requests", fmt="parquet")
    # first ingest warms the JVM (JIT, codegen); the second one is timed
    t0 = time.perf_counter()
    write_batch(create_tables(spark, f"{work}/warmup", database="bench_warmup"), requests, 1)
    ingest_cold = round(time.perf_counter() - t0, 3)
    store = create_tables(spark, f"{work}/tables", database="bench")
    t0 = time.perf_counter()
    counts = write_batch(store, requests, batch_id=1)
    ingest = round(time.perf_counter() - t0, 3)
    points = counts["metrics_gauge"] + counts["metrics_sum"]

    t = store.tables()
    h = t.gauge.select("metric_hash").first()[0]
    q = {"ingest": ingest}
    q["range_1day_enriched"], n_day = _timed(
        lambda: len(Q.points_in_range(t.gauge, t.metadata, *DAY).collect()))
    q["range_2day_sum_enriched"], _ = _timed(
        lambda: len(Q.points_in_range(t.sum, t.metadata, *TWO_DAYS).collect()))
    q["latest_gauge_20"], _ = _timed(lambda: Q.latest_points(t.gauge, t.metadata, 20).collect())
    q["latest_sum_20"], _ = _timed(lambda: Q.latest_points(t.sum, t.metadata, 20).collect())
    q["latest_gauge_20_newest_days"], _ = _timed(
        lambda: latest_points_recent(store, "gauge", 20).collect())
    q["series_listing"], _ = _timed(
        lambda: Q.series_listing(series_current(t.metadata)).collect())
    q["series_lookup"], _ = _timed(lambda: Q.series_points(t.gauge, t.metadata, h).collect())
    q["name_in_range"], _ = _timed(lambda: Q.points_in_range(
        t.gauge, t.metadata, *NAME_RANGE, metric_name="events.view").collect())
    q["any_join_all_gauge"], _ = _timed(
        # consumes dimension columns, else the optimizer drops the left join
        lambda: Q.enrich_any(t.gauge, t.metadata).agg(
            F.sum("value"), F.sum(F.length("metric_description")), F.sum(F.size("attributes"))).collect())
    q["series_count_by_name"], _ = _timed(
        lambda: S.series_count_by_name(series_current(t.metadata)).collect())
    q["orphan_audit"], _ = _timed(lambda: Q.orphan_points(t.gauge, t.metadata).count())
    t0 = time.perf_counter()
    expire(store, "2024-03-15", 60)
    compact_metadata(store, 202401, today="2024-03-15", retention_days=60)
    q["expire_and_compact"] = round(time.perf_counter() - t0, 3)

    day_bytes = _dir_bytes(f"{store.path('metrics_gauge')}/dt=2024-01-15")
    total = round(sum(q.values()), 3)
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": q,
        "sf": os.path.basename(sf_dir).replace("sf", ""), "cpus": cpus,
        "ingest_points": points, "ingest_points_per_sec": round(points / ingest, 1),
        "ingest_cold_sec": ingest_cold, "source_prep_sec": prep, "one_day_rows": n_day,
        "one_day_bytes_scanned": day_bytes,
        "whole_gauge_bytes": _dir_bytes(store.path("metrics_gauge")),
    }))


if __name__ == "__main__":
    main()
