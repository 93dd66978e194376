"""Print the physical plans of the engine's main operations on a stored copy
of the bridged test data (default sf0.01), for review.

Usage: python scripts/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from metricmart.operators import query as Q  # noqa: E402
from metricmart.operators.flatten import flatten_points, gauge_rows  # noqa: E402
from metricmart.operators.metadata import metadata_rows  # noqa: E402
from metricmart.operators.validate import split_valid  # noqa: E402
from metricmart.plans.catalog import create_tables  # noqa: E402
from metricmart.plans.ingest import write_batch  # noqa: E402
from metricmart.session import build_session  # noqa: E402
from metricmart.sources.events_bridge import bridge_requests  # noqa: E402
from metricmart.sources.requests import read_requests, write_requests  # noqa: E402


def show(title, df, mode="formatted"):
    print(f"\n######## {title}\n")
    df.explain(mode)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    work = tempfile.mkdtemp(prefix="metricmart-plans-")
    write_requests(bridge_requests(spark, sf_dir), f"{work}/requests", fmt="parquet")
    req = read_requests(spark, f"{work}/requests", fmt="parquet")
    accepted, _ = split_valid(req)
    pts = flatten_points(accepted, 1)
    show("ingest: keep-first metadata (E1)", metadata_rows(pts), "simple")
    show("ingest: gauge facts as written (C3, H11)",
         gauge_rows(pts).hint("rebalance", "dt")
         .sortWithinPartitions("dt", "time_unix_nano", "metric_hash"), "simple")
    store = create_tables(spark, f"{work}/tables", database="plans")
    write_batch(store, req, batch_id=1)
    t = store.tables()
    show("one-day enriched range (B11, F3, G5)",
         Q.points_in_range(t.gauge, t.metadata, "2024-01-15", 1705363199999999000))
    show("latest 20 (G1)", Q.latest_points(t.gauge, t.metadata, 20))
    h = t.gauge.first().metric_hash
    show("series lookup (B12, F4)", Q.series_points(t.gauge, t.metadata, h))


if __name__ == "__main__":
    main()
