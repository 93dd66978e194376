"""Storage, ingest, retention, compaction and streaming on the sf0.001 bridge."""

import pytest
from pyspark.sql import functions as F

from metricmart.functions import map_text
from metricmart.operators import query as Q
from metricmart.operators.metadata import series_current
from metricmart.plans.catalog import create_tables
from metricmart.plans.ingest import write_batch
from metricmart.plans.maintenance import compact_metadata, expire, list_partitions
from metricmart.plans.store import MetricTables
from metricmart.sources.events_bridge import bridge_requests
from metricmart.sources.requests import read_requests, write_requests
from metricmart.streaming.ingest_stream import start_ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    write_requests(bridge_requests(spark, SF), f"{root}/requests")
    req = read_requests(spark, f"{root}/requests")
    store = create_tables(spark, f"{root}/tables", database="t_store")
    counts = write_batch(store, req, batch_id=1)
    return root, store, counts, MetricTables.from_requests(req, batch_id=1)


def test_tables_created(stored, spark):
    _, store, _, _ = stored
    for t in ("series_metadata", "metrics_gauge", "metrics_sum", "metrics_histogram",
              "metrics_exponential_histogram", "metrics_summary"):
        assert store.exists(t)
    assert store.table("metrics_histogram").count() == 0


def test_stored_equals_lineage(stored):
    _, store, counts, lin = stored
    t = store.tables()
    assert counts["metrics_gauge"] == t.gauge.count() == lin.gauge.count()
    assert counts["metrics_sum"] == t.sum.count() == lin.sum.count()
    # the batch's metadata is pre-merged before it is appended
    assert counts["series_metadata"] == t.metadata.count() == series_current(lin.metadata).count()
    assert lin.metadata.count() > t.metadata.count()
    def comparable(df):
        return series_current(df).select(
            "dt", "metric_hash", "metric_description", "scope_version", "ord",
            map_text("resource_attributes").alias("r"), map_text("attributes").alias("a"))
    assert comparable(t.metadata).exceptAll(comparable(lin.metadata)).count() == 0
    assert comparable(lin.metadata).exceptAll(comparable(t.metadata)).count() == 0
    assert Q.orphan_points(t.gauge, t.metadata).count() == 0       # F5 invariant


def test_audit_log(stored, spark):
    _, store, counts, _ = stored
    audit = {r.table: r for r in store.table("ingest_audit").collect()}
    assert audit["metrics_gauge"].rows == counts["metrics_gauge"]
    assert audit["series_metadata"].status == "ok"
    assert "rejected_requests" not in audit                          # empty write skipped


def test_range_query_prunes_partitions(stored):
    _, store, _, lin = stored
    t = store.tables()
    lo, hi = 1704412800000000000, 1704585599999999000
    q = Q.points_in_range(t.gauge, t.metadata, lo, hi)
    formatted = q._jdf.queryExecution().explainString(
        q._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(dt" in formatted              # facts pruned by day
    assert "PartitionFilters: [isnotnull(month" in formatted           # metadata by month
    expected = Q.points_in_range(lin.gauge, lin.metadata, lo, hi)
    assert q.count() == expected.count() > 0


def test_latest_is_top_k_and_bounded_broadcast(stored):
    _, store, _, _ = stored
    t = store.tables()
    top = Q.top_k(t.gauge, 20)
    formatted = top._jdf.queryExecution().explainString(
        top._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "TakeOrderedAndProject" in formatted
    q = Q.latest_points(t.gauge, t.metadata, 20)
    formatted = q._jdf.queryExecution().explainString(
        q._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LocalTableScan" not in formatted
    rows = q.collect()
    final = q._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("TakeOrderedAndProject(limit=20, orderBy=[time_unix_nano") == 1 and "ReusedExchange" in final
    assert final.count("FileScan parquet spark_catalog.t_store.metrics_gauge") == 1
    assert len(rows) == 20
    times = [r.time_unix_nano for r in rows]
    assert times == sorted(times, reverse=True)
    assert all(r.metric_name for r in rows)


def test_hash_lookup_pushed_down(stored):
    _, store, _, _ = stored
    t = store.tables()
    h = t.gauge.first().metric_hash
    q = Q.series_points(t.gauge, t.metadata, h)
    formatted = q._jdf.queryExecution().explainString(
        q._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert f"EqualTo(metric_hash,{h})" in formatted
    assert q.where(F.col("metric_hash") != h).count() == 0


def test_expire_and_compact(spark, tmp_path):
    root = str(tmp_path)
    store = create_tables(spark, f"{root}/tables", database="t_expire")
    write_batch(store, bridge_requests(spark, SF), batch_id=1)
    before = store.table("metrics_gauge").count()
    merged_before = series_current(store.table("series_metadata")).count()
    dropped = expire(store, "2024-02-20", 30)                       # cutoff 2024-01-21
    assert dropped["metrics_gauge"] == 20 and dropped["series_metadata"] == 0
    days = sorted(p["dt"] for p in list_partitions(store, "metrics_gauge"))
    assert days[0] == "2024-01-21"
    assert 0 < store.table("metrics_gauge").count() < before
    n = compact_metadata(store, 202401)
    assert n == merged_before == store.table("series_metadata").count()
    assert series_current(store.table("series_metadata")).count() == merged_before


def test_stream_equals_batch(spark, stored, tmp_path):
    root, _, counts, _ = stored
    store = create_tables(spark, f"{tmp_path}/tables", database="t_stream")
    q = start_ingest(store, f"{root}/requests", available_now=True, max_files_per_trigger=1,
                     checkpoint=f"{tmp_path}/ckpt")
    q.awaitTermination(300)
    t = store.tables()
    assert t.gauge.count() == counts["metrics_gauge"]
    assert t.sum.count() == counts["metrics_sum"]
    # several micro-batches: the log holds more rows, the merged view is the same
    batch_meta = create_tables(spark, f"{root}/tables", database="t_store").table("series_metadata")
    cols = ["dt", "metric_hash", "metric_description", "scope_version", "ord.request_seq"]
    merged_stream = series_current(t.metadata).select(*cols)
    merged_batch = series_current(batch_meta).select(*cols)
    assert merged_stream.count() == merged_batch.count() == counts["series_metadata"]
    assert merged_stream.exceptAll(merged_batch).count() == 0


def test_latest_recent_equals_full_topk(stored):
    from metricmart.plans.catalog import latest_points_recent
    _, store, _, _ = stored
    t = store.tables()
    for kind in ("gauge", "sum"):
        full = [(r.time_unix_nano, r.metric_hash, r.scope_version)
                for r in Q.latest_points(t.facts(kind), t.metadata, 20).collect()]
        recent = [(r.time_unix_nano, r.metric_hash, r.scope_version)
                  for r in latest_points_recent(store, kind, 20).collect()]
        assert recent == full and len(full) == 20


def test_store_other_types_extension(spark, tmp_path, reqs):
    from metricmart.sources.samples import NOW, gauge, histogram, kv, point, request, s
    doc = request([gauge("g", [point(NOW, 7.0)]), histogram("h", NOW, 10, 100.0)],
                  [kv("service.name", s("svc"))])
    store = create_tables(spark, f"{tmp_path}/tables", database="t_other")
    off = write_batch(store, reqs(doc), batch_id=1)
    assert "metrics_histogram" not in off and store.table("metrics_histogram").count() == 0
    on = write_batch(store, reqs(doc), batch_id=2, store_other_types=True)
    h = store.table("metrics_histogram").collect()
    assert on["metrics_histogram"] == 1 and (h[0]["count"], h[0]["sum"]) == (10, 100.0)
    types = {r.metric_type for r in series_current(store.table("series_metadata")).collect()}
    assert types == {"Gauge", "Histogram"}


def test_compact_day_keeps_rows(spark, tmp_path):
    from metricmart.plans.maintenance import compact_day
    store = create_tables(spark, f"{tmp_path}/tables", database="t_compact_day")
    req = bridge_requests(spark, SF)
    write_batch(store, req, batch_id=1, rebalance=False)
    write_batch(store, req, batch_id=2, rebalance=False)     # at-least-once duplicates
    day = store.table("metrics_gauge").where("dt = '2024-01-10'")
    before = sorted(tuple(r) for r in day.select("metric_hash", "time_unix_nano", "value").collect())
    files_before = len(day.inputFiles())
    assert compact_day(store, "metrics_gauge", "2024-01-10") == len(before)
    day = store.table("metrics_gauge").where("dt = '2024-01-10'")
    after = sorted(tuple(r) for r in day.select("metric_hash", "time_unix_nano", "value").collect())
    assert after == before and len(day.inputFiles()) <= files_before
    assert store.table("metrics_gauge").where("dt = '2024-01-11'").count() > 0


def test_audit_summary_and_observe(stored, spark):
    from pyspark.sql import Observation
    from metricmart.operators.stats import audit_summary, observe_received
    _, store, counts, lin = stored
    s = {r.table: r for r in audit_summary(store.table("ingest_audit")).collect()}
    assert s["metrics_gauge"].writes == 1 and s["metrics_gauge"].rows == counts["metrics_gauge"]
    assert len(s["metrics_sum"].p50_p95_p99_ms) == 3 and s["metrics_sum"].max_ms >= 0
    got = observe_received(lin.points, "recv").count()
    assert got == counts["metrics_gauge"] + counts["metrics_sum"]
    o = Observation("recv2")
    lin.points.observe(o, F.count(F.lit(1)).alias("n")).count()
    assert o.get["n"] == got


def test_rejects_stored_and_empty_batch(spark, tmp_path, reqs):
    from metricmart.operators.validate import split_valid
    store = create_tables(spark, f"{tmp_path}/tables", database="t_rejects")
    faulty = bridge_requests(spark, SF, "faulty")
    expected = split_valid(faulty)[1].count()
    counts = write_batch(store, faulty, batch_id=1)
    rej = store.table("rejected_requests")
    assert counts["rejected_requests"] == rej.count() == expected > 0
    assert rej.where(F.col("batch_id") != 1).count() == 0
    # accepted requests only: no rejected request contributes points
    bad = rej.select("request_seq", "request_part")
    assert MetricTables.from_requests(faulty.join(bad, ["request_seq", "request_part"], "left_semi"),
                                      1).rejected.count() == expected
    empty = write_batch(store, reqs({"request_seq": 99, "request_part": 0, "resourceMetrics": []}),
                        batch_id=2)
    assert empty == {"series_metadata": 0, "metrics_gauge": 0, "metrics_sum": 0,
                     "rejected_requests": 0}
    assert store.table("ingest_audit").where("batch_id = 2").count() == 0


def test_replayed_epoch_replaces_itself(spark, tmp_path):
    from metricmart.plans.generations import Epochs, open_generations
    from metricmart.plans.maintenance import compact_day
    from metricmart.streaming.ingest_stream import epoch_batch
    store = create_tables(spark, f"{tmp_path}/tables", database="t_replay")
    epochs, other = (Epochs(store, f"{tmp_path}/{c}") for c in ("a", "b"))
    req = bridge_requests(spark, SF)
    audit = lambda: {r.table: r["sum(rows)"] for r in store.table("ingest_audit").groupBy("table").sum("rows").collect()}

    def stop(table):
        if table == "metrics_gauge":
            raise RuntimeError("stopped")
    with pytest.raises(RuntimeError):
        epoch_batch(store, req, 7, epochs, stop)
    # a commit that got through part of its days
    day = list_partitions(store, "metrics_gauge")[0]["dt"]
    gen = open_generations(store).pop()
    from metricmart.plans.generations import drop_partitions
    drop_partitions(store, "metrics_gauge", [{"dt": day, "gen": gen}])
    first = epoch_batch(store, req, 7, epochs)
    n = first["metrics_gauge"]
    assert store.table("metrics_gauge").count() == n and audit()["metrics_gauge"] == n
    # what may be replayed stays out of compactions
    assert compact_day(store, "metrics_gauge", day) == 0
    again = epoch_batch(store, req, 7, epochs)
    assert again == first and store.table("metrics_gauge").count() == n
    assert audit()["received_points"] == n + first["metrics_sum"]
    assert store.table("ingest_audit").where("status <> 'ok'").count() == 0
    epoch_batch(store, req, 8, epochs)                         # a new epoch is a batch of its own
    assert store.table("metrics_gauge").count() == 2 * n
    assert compact_day(store, "metrics_gauge", day) > 0        # epoch 7 is closed now
    # the same epoch of another stream, or of a new checkpoint, is its own
    epoch_batch(store, req, 7, other)
    assert store.table("metrics_gauge").count() == 3 * n
    assert Epochs(store, f"{tmp_path}/a").root == epochs.root


def test_failed_write_is_recorded(spark, tmp_path, monkeypatch):
    from metricmart.plans import ingest as I
    store = create_tables(spark, f"{tmp_path}/tables", database="t_failed")
    real, once = I.add_partitions, []

    def fail(store, table, specs):
        if table == "metrics_sum" and not once:
            once.append(1)
            raise OSError("no catalog")
        real(store, table, specs)
    monkeypatch.setattr(I, "add_partitions", fail)
    with pytest.raises(OSError):
        write_batch(store, bridge_requests(spark, SF), batch_id=3)
    counts = write_batch(store, bridge_requests(spark, SF), batch_id=3)
    assert store.table("metrics_sum").count() == counts["metrics_sum"]
    assert store.table("metrics_gauge").count() == counts["metrics_gauge"]
    audit = {(r.table, r.status): r.rows for r in store.table("ingest_audit").collect()}
    assert audit["metrics_sum", "error"] == 0 and audit["metrics_sum", "ok"] == counts["metrics_sum"]


def test_shuffled_join_path_matches_broadcast(stored, spark):
    _, store, _, _ = stored
    t = store.tables()
    lo, hi = 1704412800000000000, 1705881599999999000

    def run():
        q = Q.points_in_range(t.gauge, t.metadata, lo, hi)
        plan = q._jdf.queryExecution().explainString(
            q._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        rows = sorted((r.time_unix_nano, r.metric_hash, r.metric_name, r.scope_version)
                      for r in q.collect())
        a = sorted((r.time_unix_nano, r.metric_name)
                   for r in Q.enrich_any(t.gauge, t.metadata).collect())
        return plan, rows, a
    plan_b, rows_b, any_b = run()
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        plan_s, rows_s, any_s = run()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan_s and "BroadcastHashJoin" not in plan_s
    assert rows_s == rows_b and len(rows_b) > 0 and any_s == any_b


def test_series_current_sql_view(stored, spark):
    _, store, _, _ = stored
    view = spark.sql("SELECT * FROM t_store.series_current")
    assert view.count() == series_current(store.table("series_metadata")).count()
    q = spark.sql("SELECT metric_name, metric_description FROM t_store.series_current "
                  "WHERE month = 202401 AND dt = DATE'2024-01-15'")
    plan = q._jdf.queryExecution().explainString(
        q._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(month" in plan
    assert q.count() == series_current(store.table("series_metadata")) \
        .where("dt = DATE'2024-01-15'").count() > 0


def test_retention_cut_on_read(stored):
    _, store, _, _ = stored
    t = store.tables(as_of="2024-04-15")                    # 90 days -> keep dt >= 2024-01-16
    days = {r.dt.isoformat() for r in t.gauge.select("dt").distinct().collect()}
    assert min(days) == "2024-01-16"
    meta_days = {r.dt.isoformat() for r in t.metadata.select("dt").distinct().collect()}
    assert min(meta_days) == "2024-01-16"
    assert store.tables().gauge.count() > t.gauge.count() > 0


def test_exp_histogram_and_summary_extension(spark, tmp_path, reqs):
    from metricmart.operators.flatten import dropped_points
    from metricmart.sources.samples import NOW, kv, request, s
    exp = {"name": "e", "exponentialHistogram": {"aggregationTemporality": 1, "dataPoints": [
        {"timeUnixNano": str(NOW), "count": "5", "sum": 2.5, "scale": 3, "zeroCount": "1",
         "positive": {"offset": 2, "bucketCounts": ["1", "3"]},
         "negative": {"offset": -1, "bucketCounts": ["0"]}, "min": 0.1, "max": 9.0}]}}
    summ = {"name": "q", "summary": {"dataPoints": [
        {"timeUnixNano": str(NOW), "count": "4", "sum": 10.0,
         "quantileValues": [{"quantile": 0.5, "value": 2.0}, {"quantile": 0.99, "value": 7.5}]}]}}
    doc = request([exp, summ], [kv("service.name", s("svc"))])
    d = {r.metric_type: r.points for r in dropped_points(reqs(doc)).collect()}
    assert d == {"ExpHistogram": 1, "Summary": 1}
    store = create_tables(spark, f"{tmp_path}/tables", database="t_other2")
    c = write_batch(store, reqs(doc), batch_id=1, store_other_types=True)
    assert c["metrics_exponential_histogram"] == 1 and c["metrics_summary"] == 1
    e = store.table("metrics_exponential_histogram").first()
    assert (e["count"], e["scale"], e["zero_count"], e["positive_offset"],
            e["positive_bucket_counts"], e["negative_bucket_counts"], e["aggregation_temporality"]) \
        == (5, 3, 1, 2, [1, 3], [0], 1)
    q = store.table("metrics_summary").first()
    assert q["count"] == 4 and [(v.quantile, v.value) for v in q["value_at_quantiles"]] == \
        [(0.5, 2.0), (0.99, 7.5)]
    types = {r.metric_type for r in series_current(store.table("series_metadata")).collect()}
    assert types == {"ExpHistogram", "Summary"}


def test_compact_metadata_drops_expired_days(spark, tmp_path):
    store = create_tables(spark, f"{tmp_path}/tables", database="t_compact_ret")
    write_batch(store, bridge_requests(spark, SF), batch_id=1)
    n = compact_metadata(store, 202401, today="2024-02-20", retention_days=30)  # keep >= 01-21
    meta = store.table("series_metadata")
    assert n == meta.count() > 0
    assert min(r.dt for r in meta.select("dt").distinct().collect()).isoformat() == "2024-01-21"


def test_hot_series_is_split_in_lookup_joins(spark):
    n = 40_000
    day = F.lit("2024-01-10").cast("date")
    facts = spark.range(n).select(
        F.when(F.col("id") % 10 < 9, F.lit(7)).otherwise(F.col("id")).cast("bigint").alias("metric_hash"),
        F.col("id").alias("time_unix_nano"), F.repeat(F.lit("x"), 50).alias("pad"), day.alias("dt"))
    facts = facts.repartition(8)
    none = F.create_map().cast("map<string,string>")
    text = ("metric_name", "metric_description", "metric_unit", "metric_type", "service_name", "scope_name",
            "scope_version")
    meta = spark.range(n).select(
        day.alias("dt"), F.col("id").alias("metric_hash"), *[F.lit("m").alias(c) for c in text],
        *[none.alias(c) for c in ("resource_attributes", "scope_attributes", "attributes")],
        F.struct(F.lit(1).alias("batch_id")).alias("ord"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for q in (Q.enrich_by_day(facts, meta), Q.enrich_any(facts, meta)):
            assert q.collect()[0].metric_name == "m" and q.count() == n
            q.collect()
            assert "skew=true" in q._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stopped_compaction_is_completed_or_undone(spark, tmp_path, monkeypatch):
    from metricmart.plans import generations as G
    from metricmart.plans import maintenance as M
    store = create_tables(spark, f"{tmp_path}/tables", database="t_compact_stop")
    for batch in (1, 2):
        write_batch(store, bridge_requests(spark, SF), batch_id=batch)
    total = store.table("metrics_gauge").count()
    day = list_partitions(store, "metrics_gauge")[0]["dt"]

    def stop_at(name, real):
        def stopped(*args):
            raise OSError(f"stopped in {name}")
        monkeypatch.setattr(G, name, stopped)
        with pytest.raises(OSError):
            M.compact_day(store, "metrics_gauge", day)
        monkeypatch.setattr(G, name, real)
        # a reader at this point sees every row once
        assert store.table("metrics_gauge").count() == total
    for name, completed in (("rename", 0), ("add_partitions", 0), ("drop_partitions", 1)):
        stop_at(name, getattr(G, name))
        assert M.recover_compactions(store, "metrics_gauge") == completed
        assert store.table("metrics_gauge").count() == total
        assert G.list_names(spark, f"{store.path('metrics_gauge')}/_replaced") == []
        assert G.list_names(spark, f"{store.path('metrics_gauge')}/_compaction") == []
    # stopped before its note: nothing has changed
    with pytest.raises(ZeroDivisionError):
        M.compact_day(store, "metrics_gauge", day, after_staging=lambda: 1 / 0)
    assert M.recover_compactions(store, "metrics_gauge") == 0
    assert store.table("metrics_gauge").count() == total
    assert M.compact_day(store, "metrics_gauge", day) > 0 and store.table("metrics_gauge").count() == total
    assert len([p for p in G.partitions(store, "metrics_gauge") if p["dt"] == day]) == 1


def test_rename_that_fails_silently_loses_nothing(spark, tmp_path):
    import os

    from metricmart.plans import maintenance as M
    store = create_tables(spark, f"{tmp_path}/tables", database="t_rename")
    write_batch(store, bridge_requests(spark, SF), batch_id=1)
    total = store.table("metrics_gauge").count()
    day = list_partitions(store, "metrics_gauge")[0]["dt"]

    def block():    # staged files go away, so that the file system's rename has nothing to move
        for d, _, names in os.walk(f"{store.path('metrics_gauge')}/_compaction"):
            for n in names:
                os.remove(f"{d}/{n}")
    with pytest.raises(Exception):
        M.compact_day(store, "metrics_gauge", day, after_staging=block)
    assert store.table("metrics_gauge").count() == total
    assert M.compact_day(store, "metrics_gauge", day) > 0 and store.table("metrics_gauge").count() == total


def test_lease_keeps_two_runs_off_one_partition(spark, tmp_path):
    from metricmart.plans import generations as G
    store = create_tables(spark, f"{tmp_path}/tables", database="t_lease")
    with G.lease(store, "metrics_gauge", "dt=2024-01-01", "a") as held:
        with pytest.raises(G.PartitionBusy):
            with G.lease(store, "metrics_gauge", "dt=2024-01-01", "b"):
                pass
        with G.lease(store, "metrics_gauge", "dt=2024-01-02", "b"):
            assert G.live_runs(store, "metrics_gauge") == {"a", "b"}
        held()
    assert G.live_runs(store, "metrics_gauge") == set()
    with G.lease(store, "metrics_gauge", "dt=2024-01-01", "a", seconds=-1) as held:
        with G.lease(store, "metrics_gauge", "dt=2024-01-01", "b"):    # takes over a dead one
            with pytest.raises(G.PartitionBusy):
                held()


def test_view_fills_defaults_and_prunes_months(stored, spark):
    _, store, _, _ = stored
    q = spark.sql("SELECT * FROM t_store.gauge_enriched WHERE month = 202401 AND dt = DATE'2024-01-15'")
    plan = q._jdf.queryExecution().explainString(
        q._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(dt" in plan and "PartitionFilters: [isnotnull(month" in plan
    frame = Q.points_in_range(store.tables().gauge, store.tables().metadata, "2024-01-15", "2024-01-15T23:59:59.999999")
    cols = ["metric_hash", "time_unix_nano", "value", "metric_name", "metric_description"]
    assert q.select(*cols).exceptAll(frame.select(*cols)).count() == 0 and q.count() == frame.count() > 0


def test_other_types_are_read_in_one_pass(spark, tmp_path, monkeypatch):
    from metricmart.plans import ingest as I
    store = create_tables(spark, f"{tmp_path}/tables", database="t_one_pass")
    write_requests(bridge_requests(spark, SF, "types"), f"{tmp_path}/in", "parquet")
    req = read_requests(spark, f"{tmp_path}/in", "parquet")
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(1)
            yield r
    counted = spark.createDataFrame(req.rdd.mapPartitions(count), req.schema)
    counts = write_batch(store, counted, batch_id=1, store_other_types=True)
    assert seen.value == req.count()
    assert counts["metrics_histogram"] > 0 and counts["metrics_summary"] > 0


def test_cluster_needs_a_checkpoint_folder():
    from types import SimpleNamespace

    from metricmart.session import checkpoint_root

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return SimpleNamespace(get=lambda k, d=None: d)
    with pytest.raises(ValueError, match="checkpoint"):
        checkpoint_root(SimpleNamespace(sparkContext=Context()))


def test_unnamed_stream_needs_a_checkpoint(stored):
    _, store, _, _ = stored
    with pytest.raises(ValueError, match="checkpoint"):
        start_ingest(store, "/nowhere")


def test_compact_log_merges_and_expires(spark, tmp_path):
    import datetime

    from metricmart.plans import ingest as I
    from metricmart.plans.maintenance import compact_log
    store = create_tables(spark, f"{tmp_path}/tables", database="t_log")

    def log(day, batch):
        at = datetime.datetime(2024, 1, day, 12, tzinfo=datetime.timezone.utc)
        I._record(store, [(batch, "metrics_gauge", "ok", 1, 1.0, "batch")], at, f"b{batch}")
    for day, batch in ((1, 11), (2, 12), (20, 7), (20, 8), (21, 9)):   # ids say nothing of the time
        log(day, batch)
    assert compact_log(store, "ingest_audit", today="2024-01-25", retention_days=10, after_staging=lambda: log(20, 10)) == 2
    assert sorted(r.batch_id for r in store.table("ingest_audit").collect()) == [7, 8, 9, 10]
    assert [p["day"] for p in list_partitions(store, "ingest_audit")] == ["2024-01-20", "2024-01-21"]


def test_new_batch_id_reads_one_day(spark, tmp_path):
    import datetime

    from metricmart.plans import ingest as I
    store = create_tables(spark, f"{tmp_path}/tables", database="t_ids")
    late = 10**17
    for day, batch in ((1, 5), (2, late)):
        at = datetime.datetime(2124, 1, day, tzinfo=datetime.timezone.utc)
        I._record(store, [(batch, "x", "ok", 1, 1.0, "b")], at, f"b{batch}")
    assert I.new_batch_id(store) == late + 1


def test_arrival_time_orders_requests_without_numbers(spark, tmp_path):
    import json
    import os

    from metricmart.sources.samples import NOW, gauge, kv, point, request, s
    for i, description in ((1, "first"), (2, "second"), (3, "third")):
        doc = request([{**gauge("g", [point(NOW)]), "description": description}], [kv("service.name", s("a"))])
        del doc["request_seq"]
        path = f"{tmp_path}/in/{9 - i}.json"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(json.dumps(doc) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    t = MetricTables.from_requests(read_requests(spark, f"{tmp_path}/in"))
    assert t.metadata.count() == 3
    assert [r.metric_description for r in t.current().collect()] == ["third"]
    store = create_tables(spark, f"{tmp_path}/tables", database="t_arrival")
    write_batch(store, read_requests(spark, f"{tmp_path}/in"), batch_id=1)
    assert [r.metric_description for r in store.tables().current().collect()] == ["third"]


def test_closed_days_are_read_without_merging(spark, tmp_path):
    store = create_tables(spark, f"{tmp_path}/tables", database="t_closed")
    req = bridge_requests(spark, SF)
    write_batch(store, req, batch_id=1)
    compact_metadata(store, 202401)
    plan = store.current()._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan                            # every day is closed
    write_batch(store, req.where(F.col("request_seq") == 473573), batch_id=2)
    found, want = store.current(), series_current(store.table("series_metadata"))
    cols = ["dt", "metric_hash", "metric_description", "scope_version", "ord"]
    assert "LeftAnti" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == want.count() and found.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert found.where("ord.batch_id = 2").count() > 0


def test_batch_metadata_equals_two_steps(spark):
    from metricmart.operators.flatten import flatten_points
    from metricmart.operators.metadata import batch_metadata, metadata_rows
    points = flatten_points(bridge_requests(spark, SF), 3)
    cols = ["dt", "metric_name", "metric_hash", "metric_description", "scope_version", "ord"]
    one, two = batch_metadata(points).select(*cols), series_current(metadata_rows(points)).select(*cols)
    assert one.count() == two.count() > 0 and one.exceptAll(two).count() == 0


def test_lines_of_one_file_keep_their_order(spark, tmp_path):
    import json

    from metricmart.sources.samples import NOW, gauge, kv, point, request, s
    docs = []
    for i in range(400):
        doc = request([{**gauge("g", [point(NOW)]), "description": f"line {i}"}], [kv("service.name", s("a"))])
        del doc["request_seq"], doc["request_part"]
        docs.append(json.dumps(doc) + " " * (i % 7))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(docs) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")      # several tasks read the file
    try:
        read = read_requests(spark, f"{tmp_path}/in")
        assert read.rdd.getNumPartitions() > 3
        t = MetricTables.from_requests(read)
        assert t.metadata.count() == 400
        assert [r.metric_description for r in t.current().collect()] == ["line 399"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_kafka_like_records_are_ordered_by_time(spark):
    import json

    from metricmart.sources.requests import parse_requests
    from metricmart.sources.samples import NOW, gauge, kv, point, request, s
    rows = []
    for t, offset, partition in ((3, 1, 0), (2, 900, 1), (1, 5000, 2), (3, 0, 1)):
        doc = request([{**gauge("g", [point(NOW)]), "description": f"{t} {offset}"}], [kv("service.name", s("a"))])
        rows.append((json.dumps({"resourceMetrics": doc["resourceMetrics"]}), t, offset, partition))
    raw = spark.createDataFrame(rows, "value string, t long, offset long, partition int").withColumn("timestamp", F.timestamp_seconds("t"))
    req = parse_requests(raw, "value", received_at="timestamp", line_order=F.col("offset") * (1 << 16) + F.col("partition"))
    assert [r.metric_description for r in MetricTables.from_requests(req).current().collect()] == ["3 1"]


def test_attribute_table_prunes_days_and_row_groups(spark, tmp_path):
    from metricmart.operators import extensions as X
    from metricmart.plans.maintenance import compact_attributes
    store = create_tables(spark, f"{tmp_path}/tables", database="t_attr")
    req = bridge_requests(spark, SF)
    for batch in (1, 2):
        write_batch(store, req, batch_id=batch)
    span = ("2024-01-01", "2024-01-31T23:59:59")
    t = store.tables()

    def found():
        return X.points_with_attribute(t.gauge, store.table("series_attributes"), *span, level="resource", key="host.name", value="host-2")
    meta = X.with_attribute_value(series_current(t.metadata), "host.name", "host-2", "resource")
    want = t.gauge.join(meta.select("metric_hash", "dt"), ["metric_hash", "dt"], "left_semi")
    n = want.count()
    assert found().count() == n > 0 and found().exceptAll(want).count() == 0
    plan = lambda q: q._jdf.queryExecution().explainString(
        q._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "dynamicpruning" in plan(found()) and "EqualTo(attr_value,host-2)" in plan(found())
    named = Q.points_in_range(t.gauge, t.metadata, *span, metric_name="events.view")      # B15
    assert "dynamicpruning" in plan(named) and named.count() > 0
    before = store.table("series_attributes").count()
    assert compact_attributes(store, 202401) == store.table("series_attributes").count() == before // 2
    assert found().count() == n
    assert expire(store, "2024-06-01", 30)["series_attributes"] == 1 and store.table("series_attributes").count() == 0


def test_ordered_files_are_read_in_the_order_of_the_sort(spark, tmp_path):
    from metricmart.sources.requests import requests_from_json, write_ordered_requests
    from metricmart.sources.samples import NOW, gauge, kv, point, request, s
    docs = [{**request([{**gauge("g", [point(NOW)]), "description": f"line {i}"}], [kv("service.name", s("a"))]),
             "request_seq": i, "request_part": 0} for i in range(60)]
    lines = requests_from_json(spark, docs).repartitionByRange(5, "request_seq").sortWithinPartitions(F.col("request_seq").desc())
    write_ordered_requests(lines.select("resourceMetrics"), f"{tmp_path}/in")
    assert len(list((tmp_path / "in").glob("part-*.json"))) > 1
    t = MetricTables.from_requests(read_requests(spark, f"{tmp_path}/in"))
    assert t.metadata.count() == 60
    # the last line of the last file: the least number of the last range
    parts = lines.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("request_seq").alias("n")).orderBy("p").collect()
    assert [r.metric_description for r in t.current().collect()] == [f"line {parts[-1].n}"]


def test_unnumbered_lines_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from metricmart.plans import named_queries as N
    from metricmart.sources import requests as R
    written, write = [], R.write_requests

    def noted(df, path, *args):
        write(df, path, *args)
        written.append(len(list(Path(path.removeprefix("file:")).glob("part-*.json"))))
    monkeypatch.setattr(R, "write_requests", noted)
    monkeypatch.setattr(N, "write_requests", noted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert N.unnumbered_lines(spark, SF).count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert written[0] > 1


def test_requests_of_several_batches_are_nested_once(spark, monkeypatch):
    from metricmart.plans import named_queries as N
    taken, write = [], N.write_batch

    def noted(store, requests, *args, **options):
        taken.append(requests._jdf.queryExecution().optimizedPlan().toString())
        return write(store, requests, *args, **options)
    monkeypatch.setattr(N, "write_batch", noted)
    assert N.compact_with_append(spark, SF).count() == 4
    assert len(taken) == 3 and not any("Aggregate" in plan for plan in taken)
