"""Registered queries over the driver's tables.

Each query takes (spark, sf_dir), bridges the whole ``events`` table into
export requests (sources.events_bridge) and runs the engine's operators on
them. Outputs avoid MAP and TIMESTAMP columns: attribute maps are shown as
sorted ``k=v`` text, days as ISO text, and series are identified by
``series_key`` = md5 of the identity text, which an SQL engine without
xxHash64 can also compute. The 64-bit ``metric_hash`` itself is checked
against golden values in the tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmart.functions import (identity_text, identity_text_from_maps, metric_hash,
                                  series_key)
from metricmart.operators import extensions as X
from metricmart.operators import query as Q
from metricmart.operators import stats as S
from metricmart.operators.flatten import dropped_points, flatten_other_points, flatten_points
from metricmart.operators.retention import cutoff_date
from metricmart.operators.validate import with_validation
from metricmart.plans.catalog import create_tables, latest_points_recent
from metricmart.plans.generations import Epochs, PartitionBusy, replace
from metricmart.plans.ingest import write_batch
from metricmart.plans.maintenance import compact_day, compact_log, compact_metadata, expire
from metricmart.plans.store import MetricTables
from metricmart.session import checkpoint_root
from metricmart.sources.events_bridge import bridge_requests
from metricmart.sources.requests import parse_requests, read_requests, write_ordered_requests, write_requests
from metricmart.streaming.ingest_stream import epoch_batch, start_ingest

# Fixed query parameters (inclusive nanosecond ranges, UTC).
GAUGE_RANGE = (1704412800000000000, 1704585599999999000)   # 2024-01-05 .. 2024-01-06
SUM_RANGE = (1705708800000000000, 1705881599999999000)     # 2024-01-20 .. 2024-01-21
NAME_RANGE = (1704844800000000000, 1705060800000000000)    # 2024-01-10 00:00 .. 2024-01-12 12:00
NAME_FILTER = "events.view"
LOOKUP_SERIES = ("events.click", "svc-0", {"service.name": "svc-0", "host.name": "host-0"},
                 {}, {"bucket": "0", "odd": "false"})
ORPHAN_DAY, NEXT_DAY = "2024-01-10", "2024-01-11"
AGAIN_HOUR = 473573                                        # 2024-01-10 05:00
RETENTION_TODAY, RETENTION_DAYS = "2024-04-15", 90
LATEST_N = 20


def _tables(spark: SparkSession, sf_dir: str, variant: str = "clean") -> MetricTables:
    return MetricTables.from_requests(bridge_requests(spark, sf_dir, variant))


def attrs_display(m: Column) -> Column:
    """Sorted ``k=v`` text of a map, joined with commas (display only)."""
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                               lambda e: F.concat(e["key"], F.lit("="), e["value"])),
                                   ","), F.lit(""))


def _key_from_meta() -> Column:
    return series_key(identity_text_from_maps("metric_name", "service_name", "resource_attributes",
                                              "scope_attributes", "attributes"))


def _dt_text(c: str = "dt") -> Column:
    return F.col(c).cast("string").alias(c)


# ---------------------------------------------------------------- flatten
def flatten_gauge_points(spark, sf_dir):
    """Requests re-read from their JSON bodies,
    flattened; the gauge facts."""
    req = bridge_requests(spark, sf_dir)
    bodies = req.select("request_seq",
                        F.to_json(F.struct("resourceMetrics")).alias("value"))
    pts = flatten_points(parse_requests(bodies, "value", "request_seq"))
    return pts.where(F.col("metric_type") == "Gauge").select(
        series_key(F.col("canonical")).alias("series_key"), "metric_name",
        "start_time_unix_nano", "time_unix_nano", _dt_text(), "value", "flags")


def flatten_sum_points(spark, sf_dir):
    """C2, C4, B8."""
    pts = _tables(spark, sf_dir).points
    return pts.where(F.col("metric_type") == "Sum").select(
        series_key(F.col("canonical")).alias("series_key"), "metric_name",
        "start_time_unix_nano", "time_unix_nano", _dt_text(), "value", "flags",
        F.col("aggregation_temporality").cast("bigint").alias("aggregation_temporality"),
        "is_monotonic")


def dropped_points_by_type(spark, sf_dir):
    """Points of unimplemented types are counted, never stored."""
    d = dropped_points(bridge_requests(spark, sf_dir))
    return d.groupBy("metric_type").agg(
        F.countDistinct("request_seq", "request_part").alias("requests"),
        F.sum("points").cast("bigint").alias("dropped_points"))


# ---------------------------------------------------------------- validation
def validation_errors(spark, sf_dir):
    """First violation per rejected request (faulty variant)."""
    v = with_validation(bridge_requests(spark, sf_dir, "faulty"))
    return v.where(F.col("error").isNotNull()).select("request_seq", "request_part", "error")


def accepted_rejected_counts(spark, sf_dir):
    """Whole requests are kept or rejected; points per outcome."""
    req = with_validation(bridge_requests(spark, sf_dir, "faulty"))
    status = F.when(F.col("error").isNull(), F.lit("accepted")).otherwise(F.lit("rejected"))
    pts = flatten_points(req.withColumn("status", status))
    per = pts.groupBy("request_seq", "request_part").agg(
        F.count_if(F.col("metric_type") == "Gauge").alias("g"),
        F.count_if(F.col("metric_type") == "Sum").alias("s"))
    return (req.select("request_seq", "request_part", status.alias("status"))
            .join(per, ["request_seq", "request_part"], "left")
            .groupBy("status")
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.coalesce(F.sum("g"), F.lit(0)).cast("bigint").alias("gauge_points"),
                 F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("sum_points")))


# ---------------------------------------------------------------- scalar functions
def service_names(spark, sf_dir):
    """Service per resource, with the points it sent."""
    pts = _tables(spark, sf_dir).points
    return pts.groupBy("service_name", Q.map_value(F.col("resource_attributes"), "host.name")
                       .alias("host_name")).agg(F.count(F.lit(1)).alias("points"))


def attribute_text(spark, sf_dir):
    """Attribute lists as text maps (typed values rendered as text)."""
    pts = _tables(spark, sf_dir).points
    res = pts.select(F.lit("resource").alias("level"), F.explode("resource_attributes"))
    pnt = pts.select(F.lit("point").alias("level"), F.explode("attributes"))
    return (res.unionByName(pnt).groupBy("level", F.col("key").alias("attr_key"),
                                         F.col("value").alias("attr_value"))
            .agg(F.count(F.lit(1)).alias("points")))


def point_values(spark, sf_dir):
    """D5 (S10): values per series and day."""
    pts = _tables(spark, sf_dir).points
    return (pts.groupBy(series_key(F.col("canonical")).alias("series_key"), "dt")
            .agg(F.count(F.lit(1)).alias("points"),
                 F.round(F.sum("value"), 6).alias("sum_value"),
                 F.min("value").alias("min_value"), F.max("value").alias("max_value"))
            .select("series_key", _dt_text(), "points", "sum_value", "min_value", "max_value"))


def series_keys(spark, sf_dir):
    """One identity text -> one hash, per series."""
    pts = _tables(spark, sf_dir).points
    return (pts.groupBy("metric_name", "service_name",
                        series_key(F.col("canonical")).alias("series_key"))
            .agg(F.count(F.lit(1)).alias("points"),
                 (F.countDistinct("metric_hash") == 1).alias("hash_unique"),
                 F.max(F.length("canonical")).cast("bigint").alias("identity_bytes")))


# ---------------------------------------------------------------- metadata
def metadata_first_per_request(spark, sf_dir):
    """Keep-first metadata per (request, type, hash, day)."""
    meta = _tables(spark, sf_dir).metadata
    return meta.select(F.col("ord.request_seq").alias("request_seq"),
                       F.col("ord.request_part").alias("request_part"), "metric_type",
                       _key_from_meta().alias("series_key"), _dt_text(), "metric_description",
                       "metric_unit", "scope_name", "scope_version", "service_name")


def _current_out(cur: DataFrame) -> DataFrame:
    return cur.select(_dt_text(), "metric_name", _key_from_meta().alias("series_key"),
                      "metric_description", "metric_unit", "metric_type", "service_name",
                      "scope_name", "scope_version",
                      attrs_display(F.col("resource_attributes")).alias("resource_attrs"),
                      attrs_display(F.col("attributes")).alias("point_attrs"),
                      F.col("ord.request_seq").alias("last_request_seq"))


def series_current_q(spark, sf_dir):
    """Merged metadata, last inserted value wins."""
    return _current_out(_tables(spark, sf_dir).current())


def series_listing(spark, sf_dir):
    """Series listing sorted by name."""
    cur = _tables(spark, sf_dir).current()
    return (Q.series_listing(cur.withColumn("sk", _key_from_meta()))
            .select("metric_name", "service_name", "metric_type",
                    attrs_display(F.col("attributes")).alias("point_attrs"), _dt_text()))


def series_count_by_name(spark, sf_dir):
    """E5, E10, B13."""
    return S.series_count_by_name(_tables(spark, sf_dir).current())


def host_attribute(spark, sf_dir):
    """A map element of the merged metadata."""
    cur = _tables(spark, sf_dir).current()
    return (cur.groupBy(Q.map_value(F.col("resource_attributes"), "host.name").alias("host_name"))
            .agg(F.count(F.lit(1)).alias("series_days"),
                 F.countDistinct("metric_hash").alias("distinct_series")))


# ---------------------------------------------------------------- range and joins
def _enriched_out(df: DataFrame) -> DataFrame:
    return df.select("time_unix_nano", _key_from_meta().alias("series_key"), "metric_name",
                     "service_name", attrs_display(F.col("attributes")).alias("point_attrs"),
                     "metric_description", "scope_version", "value")


def gauge_range_enriched(spark, sf_dir):
    """Gauge values for a time range, enriched, by time."""
    t = _tables(spark, sf_dir)
    return _enriched_out(Q.points_in_range(t.gauge, t.metadata, *GAUGE_RANGE))


def sum_range_enriched(spark, sf_dir):
    """B11, F2/F3 for sums."""
    t = _tables(spark, sf_dir)
    return _sum_out(Q.points_in_range(t.sum, t.metadata, *SUM_RANGE))


def _sum_out(out: DataFrame) -> DataFrame:
    return out.select("time_unix_nano", _key_from_meta().alias("series_key"), "metric_name",
                      "service_name", attrs_display(F.col("attributes")).alias("point_attrs"),
                      "metric_description", "scope_version", "value",
                      F.col("aggregation_temporality").cast("bigint")
                       .alias("aggregation_temporality"), "is_monotonic")


def _any_join(kind: str):
    def run(spark, sf_dir):
        t = _tables(spark, sf_dir)
        out = Q.enrich_any(t.facts(kind), t.metadata)
        return out.select("time_unix_nano", _key_from_meta().alias("series_key"), "value",
                          "metric_name", "metric_description", "scope_version",
                          _dt_text("meta_dt"))
    run.__doc__ = f"F1/F2, S26, S27: every {kind} point, LEFT ANY JOIN on the hash alone."
    return run


def _latest(kind: str):
    def run(spark, sf_dir):
        t = _tables(spark, sf_dir)
        return _enriched_out(Q.latest_points(t.facts(kind), t.metadata, LATEST_N))
    run.__doc__ = f"G1/G2: latest {LATEST_N} {kind} points, enriched."
    return run


def series_point_lookup(spark, sf_dir):
    """One series by its hash (computed from its identity), then its metadata."""
    name, svc, res, scope, attrs = LOOKUP_SERIES

    def text(m):
        return "\x01".join(f"{k}\x02{v}" for k, v in sorted(m.items()))
    h = metric_hash(identity_text(F.lit(name), F.lit(svc), F.lit(text(res)), F.lit(text(scope)),
                                  F.lit(text(attrs))))
    t = _tables(spark, sf_dir)
    return _enriched_out(Q.series_points(t.gauge, t.metadata, h))


def name_in_range(spark, sf_dir):
    """A time range combined with a name filter."""
    t = _tables(spark, sf_dir)
    return _enriched_out(Q.points_in_range(t.gauge, t.metadata, *NAME_RANGE,
                                           metric_name=NAME_FILTER))


def orphan_points(spark, sf_dir):
    """facts without metadata, after one day of metadata is withheld."""
    t = _tables(spark, sf_dir)
    meta = t.metadata.where(F.col("dt") != F.lit(ORPHAN_DAY).cast("date"))
    return (Q.orphan_points(t.gauge, meta).groupBy("dt")
            .agg(F.count(F.lit(1)).alias("orphan_points")).select(_dt_text(), "orphan_points"))


# ---------------------------------------------------------------- stats, retention
def received_counts(spark, sf_dir):
    """E6, E7."""
    return S.received_counts(_tables(spark, sf_dir).points)


def write_audit_summary(spark, sf_dir):
    """Writes and rows per table as the ingest performs them."""
    t = _tables(spark, sf_dir)
    return S.write_plan_audit(t.points, t.metadata)


def table_row_counts(spark, sf_dir):
    """Raw and merged row counts."""
    t = _tables(spark, sf_dir)
    return S.table_row_counts(metrics_gauge=t.gauge, metrics_sum=t.sum,
                              series_metadata=t.metadata, series_current=t.current(),
                              rejected_requests=t.rejected)


def retention_keep(spark, sf_dir):
    """Rows and days kept / expired under a fixed 'today'."""
    t = _tables(spark, sf_dir)
    cut = F.lit(cutoff_date(RETENTION_TODAY, RETENTION_DAYS))

    def summarize(name, df):
        return (df.groupBy(F.when(F.col("dt") >= cut, F.lit("kept")).otherwise(F.lit("expired"))
                           .alias("state"))
                .agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("dt").alias("days"))
                .select(F.lit(name).alias("table"), "state", "rows", "days"))
    return (summarize("metrics_gauge", t.gauge).unionByName(summarize("metrics_sum", t.sum))
            .unionByName(summarize("series_metadata", t.metadata)))


# ---------------------------------------------------------------- extensions
def no_recorded_value(spark, sf_dir):
    """Value NULL when flag bit 1 is set."""
    t = _tables(spark, sf_dir)
    g = X.null_unrecorded(t.gauge).withColumn("kind", F.lit("gauge"))
    s = X.null_unrecorded(t.sum).select(*g.columns[:-1]).withColumn("kind", F.lit("sum"))
    return (g.unionByName(s).groupBy("kind")
            .agg(F.count(F.lit(1)).alias("points"),
                 F.count_if(F.col("value").isNull()).alias("no_value_points")))


def filter_service(spark, sf_dir):
    """X5."""
    cur = _tables(spark, sf_dir).current()
    return (X.by_service(cur, "svc-1").groupBy("metric_name")
            .agg(F.count(F.lit(1)).alias("series_days")))


def filter_attr_key(spark, sf_dir):
    """Series having a key, per attribute level."""
    cur = _tables(spark, sf_dir).current()
    parts = []
    for where, key in (("resource", "host.name"), ("scope", "host.name"), ("point", "odd")):
        parts.append(X.with_attribute_key(cur, key, where)
                     .agg(F.countDistinct("metric_hash").alias("series"))
                     .select(F.lit(where).alias("level"), F.lit(key).alias("attr_key"), "series"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def filter_attr_value(spark, sf_dir):
    """Series with given attribute values."""
    cur = _tables(spark, sf_dir).current()
    hit = X.with_attribute_value(X.with_attribute_value(cur, "odd", "true", "point"),
                                 "host.name", "host-2", "resource")
    return hit.select(_dt_text(), "metric_name", _key_from_meta().alias("series_key"))


def histogram_points(spark, sf_dir):
    """Histogram points flattened like gauge and sum points (extension)."""
    pts = flatten_other_points(bridge_requests(spark, sf_dir), "Histogram")
    return pts.select(series_key(F.col("canonical")).alias("series_key"), "metric_name",
                      "time_unix_nano", _dt_text(), "count", "sum",
                      F.col("aggregation_temporality").cast("bigint")
                       .alias("aggregation_temporality"))


def variety_series(spark, sf_dir):
    """D1, D2, D3, D7, D8 on attribute edge cases (variety variant): missing,
    non-string and duplicate service.name, double attributes as Go %g text."""
    pts = _tables(spark, sf_dir, "variety").points
    return (pts.groupBy("metric_name", "service_name",
                        attrs_display(F.col("resource_attributes")).alias("resource_attrs"),
                        series_key(F.col("canonical")).alias("series_key"))
            .agg(F.count(F.lit(1)).alias("points")))


def variety_attribute_text(spark, sf_dir):
    """Resource attribute values as text, last duplicate key kept."""
    pts = _tables(spark, sf_dir, "variety").points
    return (pts.select(F.explode("resource_attributes"))
            .groupBy(F.col("key").alias("attr_key"), F.col("value").alias("attr_value"))
            .agg(F.count(F.lit(1)).alias("points")))


# ---------------------------------------------------------------- stored path
def _fresh_store(spark: SparkSession):
    """An empty store of its own below the checkpoint folder."""
    tag = uuid.uuid4().hex[:12]
    return create_tables(spark, f"{checkpoint_root(spark)}/registered/{tag}", database=f"mm_{tag}")


_SHARED: dict[tuple[str, str], object] = {}


def _stored(spark: SparkSession, sf_dir: str):
    """The bridged requests ingested once a session and ``sf_dir`` (DDL, validation,
    flatten, metadata-first appends); for queries that only read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED:
        store = _fresh_store(spark)
        write_batch(store, bridge_requests(spark, sf_dir), batch_id=1)
        _SHARED[key] = store
    return _SHARED[key]


def stored_gauge_range(spark, sf_dir):
    """H1–H12 + B11/F3/G5: the range query on stored, partitioned tables."""
    t = _stored(spark, sf_dir).tables()
    return _enriched_out(Q.points_in_range(t.gauge, t.metadata, *GAUGE_RANGE))


def stored_latest_gauge_20(spark, sf_dir):
    """G1 on stored tables, newest day partitions first."""
    return _enriched_out(latest_points_recent(_stored(spark, sf_dir), "gauge", LATEST_N))


def stored_series_current(spark, sf_dir):
    """A5/E2 through the catalog view ``series_current``."""
    store = _stored(spark, sf_dir)
    return _current_out(spark.sql(f"SELECT * FROM {store.name('series_current')}"))


def stored_sum_range(spark, sf_dir):
    """The sum range query on stored tables."""
    t = _stored(spark, sf_dir).tables()
    return _sum_out(Q.points_in_range(t.sum, t.metadata, *SUM_RANGE))


def stored_sql_range(spark, sf_dir):
    """G5 through the SQL view ``gauge_enriched``."""
    lo, hi = GAUGE_RANGE
    return _enriched_out(spark.sql(
        f"SELECT * FROM {_stored(spark, sf_dir).name('gauge_enriched')} "
        f"WHERE month = 202401 AND dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-06' "
        f"AND time_unix_nano BETWEEN {lo} AND {hi}"))


def stored_reinsert(spark, sf_dir):
    """The same requests inserted twice merge to the same series."""
    store = _fresh_store(spark)
    for batch in (1, 2):
        write_batch(store, bridge_requests(spark, sf_dir), batch_id=batch)
    return _current_out(store.tables().current())


def _lookup_hash():
    name, svc, res, scope, attrs = LOOKUP_SERIES

    def text(m):
        return "\x01".join(f"{k}\x02{v}" for k, v in sorted(m.items()))
    return metric_hash(identity_text(F.lit(name), F.lit(svc), F.lit(text(res)), F.lit(text(scope)),
                                     F.lit(text(attrs))))


def range_by_hash(spark, sf_dir):
    """A time range of one series, by its hash."""
    t = _tables(spark, sf_dir)
    return _enriched_out(Q.points_in_range(t.gauge, t.metadata, *GAUGE_RANGE, metric_hash=_lookup_hash()))


def hash_only_points(spark, sf_dir):
    """One series by its hash alone, without metadata."""
    name, svc, res, scope, attrs = LOOKUP_SERIES
    hit = X.by_hash(_tables(spark, sf_dir).gauge, _lookup_hash())
    key = series_key(identity_text(*[F.lit(x) for x in (name, svc)], *[
        F.lit("\x01".join(f"{k}\x02{v}" for k, v in sorted(m.items()))) for m in (res, scope, attrs)]))
    return hit.select(key.alias("series_key"), "time_unix_nano", "value")


def time_forms(spark, sf_dir):
    """A time outside unsigned 64 bits rejects its request (times variant)."""
    v = with_validation(bridge_requests(spark, sf_dir, "times"))
    return v.where(F.col("error").isNotNull()).select("request_seq", "request_part", "error")


def rejected_bodies(spark, sf_dir):
    """A1-A3: undecodable and missing bodies are stored as rejects, the good ones of the batch as points."""
    req = bridge_requests(spark, sf_dir)
    seq = F.pmod("request_seq", F.lit(10))
    body = F.when(seq == 3, F.lit("{broken")).when(seq != 7, F.to_json(F.struct("resourceMetrics")))
    store = _fresh_store(spark)
    write_batch(store, parse_requests(req.select("request_seq", body.alias("value")), "value", "request_seq"), batch_id=1)
    rejects = store.table("rejected_requests").groupBy(F.col("error").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    count = lambda table, name: store.table(table).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("outcome"), "n")
    return rejects.unionByName(count("metrics_gauge", "gauge points")).unionByName(count("metrics_sum", "sum points"))


def ingest_audit_counts(spark, sf_dir):
    """What the audit log of a stored batch says."""
    audit = _stored(spark, sf_dir).table("ingest_audit").where("batch_id = 1")
    return S.audit_summary(audit).select("table", "status", "writes", "rows", (F.col("min_ms") > 0).alias("timed"))


def _kept(requests):
    """Requests that several batches take, nested once and read back."""
    spark = requests.sparkSession
    path = f"{checkpoint_root(spark)}/requests/{uuid.uuid4().hex}"
    write_requests(requests, path, "parquet")
    return spark.read.schema(requests.schema).parquet(path)


def _rows_of(store, *tables):
    return S.table_row_counts(**{t: store.table(t) for t in tables})


def expire_counts(spark, sf_dir):
    """Rows left after expiry of whole days and months."""
    store = _fresh_store(spark)
    write_batch(store, bridge_requests(spark, sf_dir), batch_id=1)
    expire(store, RETENTION_TODAY, RETENTION_DAYS)
    return _rows_of(store, "metrics_gauge", "metrics_sum", "series_metadata")


def compact_with_append(spark, sf_dir):
    """Batches appended while a day and a month are compacted stay, also after a failed run."""
    requests = _kept(bridge_requests(spark, sf_dir))
    store = _fresh_store(spark)
    write_batch(store, requests, batch_id=1)

    def fail():
        raise RuntimeError("stopped")
    try:
        compact_day(store, "metrics_gauge", ORPHAN_DAY, after_staging=fail)
    except RuntimeError:
        pass
    compact_day(store, "metrics_gauge", ORPHAN_DAY, after_staging=lambda: write_batch(store, requests, batch_id=2))
    compact_metadata(store, 202401, after_staging=lambda: write_batch(store, requests, batch_id=3))
    return _rows_of(store, "metrics_gauge", "metrics_sum", "series_metadata", "series_current")


def stream_two_sources(spark, sf_dir):
    """A2, K1-K4: two unnamed streams into one store, then one again on a new checkpoint."""
    store = _fresh_store(spark)
    requests = bridge_requests(spark, sf_dir)
    for i in (0, 1):
        write_requests(requests.where(F.pmod("request_seq", F.lit(2)) == i), f"{store.root}/in{i}")
    for i, checkpoint in ((0, "a"), (1, "b"), (0, "c")):
        start_ingest(store, f"{store.root}/in{i}", checkpoint=f"{store.root}/checkpoint-{checkpoint}",
                     available_now=True).awaitTermination()
    return _rows_of(store, "metrics_gauge", "metrics_sum", "series_current")


def stored_other_types(spark, sf_dir):
    """Histogram, exponential-histogram and summary points stored and read back."""
    store = _fresh_store(spark)
    write_batch(store, bridge_requests(spark, sf_dir, "types"), batch_id=1, store_other_types=True)
    double = lambda c: F.col(c).cast("double")
    shown = {
        "metrics_histogram": [F.concat_ws(",", F.col("bucket_counts").cast("array<string>")), double("max"),
                              F.col("explicit_bounds")[0], F.col("aggregation_temporality")],
        "metrics_exponential_histogram": [
            F.concat_ws(",", "scale", "zero_count", "positive_offset", F.col("positive_bucket_counts").cast("array<string>"),
                        "negative_offset", F.col("negative_bucket_counts").cast("array<string>")),
            double("max"), F.lit(0.0), F.col("aggregation_temporality")],
        "metrics_summary": [F.size("value_at_quantiles").cast("string"), F.col("value_at_quantiles")[1]["value"],
                            F.col("value_at_quantiles")[1]["quantile"], F.lit(0)],
    }
    out = None
    for name, (buckets, top, bound, temporality) in shown.items():
        rows = Q.enrich_by_day(store.table(name), store.table("series_metadata")).select(
            F.lit(name).alias("table"), _key_from_meta().alias("series_key"), "time_unix_nano", _dt_text(), "count", "sum",
            buckets.alias("buckets"), top.alias("top"), bound.alias("bound"), temporality.cast("bigint").alias("temporality"))
        out = rows if out is None else out.unionByName(rows)
    return out


def compact_two_days_at_once(spark, sf_dir):
    """A day compacted, and a batch appended, while another day of the table is compacted;
    a second run on the same day is refused."""
    requests = _kept(bridge_requests(spark, sf_dir))
    store = _fresh_store(spark)
    write_batch(store, requests, batch_id=1)

    def meanwhile():
        compact_day(store, "metrics_gauge", NEXT_DAY)
        write_batch(store, requests, batch_id=2)
        try:
            compact_day(store, "metrics_gauge", ORPHAN_DAY)
            raise AssertionError("two runs on one day")
        except PartitionBusy:
            pass
    compact_day(store, "metrics_gauge", ORPHAN_DAY, after_staging=meanwhile)
    compact_day(store, "metrics_gauge", NEXT_DAY)
    return store.table("metrics_gauge").groupBy("dt").agg(F.count(F.lit(1)).alias("points"), F.sum("value").alias("total")) \
        .select(_dt_text(), "points", F.round("total", 3).alias("total"))


def replayed_epoch(spark, sf_dir):
    """Epochs that fail after the facts of one table, and in its midst, are replayed once more;
    rows of every table and of the audit log."""
    requests = bridge_requests(spark, sf_dir)
    store = _fresh_store(spark)
    epochs = Epochs(store, f"{store.root}/checkpoint")

    def fail(table):
        def on_commit(done):
            if done == table:
                raise RuntimeError("stopped")
        return on_commit
    half = [_kept(requests.where(F.pmod("request_seq", F.lit(2)) == i)) for i in (0, 1)]
    for epoch, stop in ((0, "series_metadata"), (0, "metrics_gauge"), (0, None), (1, "metrics_sum"), (1, None)):
        try:
            epoch_batch(store, half[epoch], epoch, epochs, fail(stop))
        except RuntimeError:
            pass
    rows = _rows_of(store, "metrics_gauge", "metrics_sum", "series_current")
    audit = store.table("ingest_audit").groupBy("table").agg(F.sum("rows").alias("rows"))
    return rows.unionByName(audit.where(F.col("table") != "series_metadata").select(F.concat(F.lit("audit "), "table").alias("table"), "rows"))


def audit_other_types(spark, sf_dir):
    """What the audit log says where all types are stored, and its merged days."""
    store = _fresh_store(spark)
    requests = _kept(bridge_requests(spark, sf_dir, "types"))
    write_batch(store, requests, batch_id=7, store_other_types=True)
    write_batch(store, requests, batch_id=8)
    compact_log(store, "ingest_audit")
    return store.table("ingest_audit").where(F.col("table") != "series_metadata").select("batch_id", "table", "status", "rows")


def stored_view_unmatched(spark, sf_dir):
    """The SQL view on days of which one has no metadata."""
    store = _fresh_store(spark)
    write_batch(store, bridge_requests(spark, sf_dir), batch_id=1)
    replace(store, "series_metadata", 202401, lambda m: m.where(F.col("dt") != F.lit(ORPHAN_DAY).cast("date")), {})
    rows = spark.sql(f"SELECT * FROM {store.name('gauge_enriched')} WHERE month = 202401 "
                     f"AND dt BETWEEN DATE '{ORPHAN_DAY}' AND DATE '{NEXT_DAY}'")
    return _enriched_out(rows)


def file_time_order(spark, sf_dir):
    """Files of a day, as written by several tasks, whose times overlap those of another of its files."""
    store = _fresh_store(spark)
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")    # several files even of small days
    try:
        write_batch(store, bridge_requests(spark, sf_dir), batch_id=1, one_task_rows=0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    facts = store.table("metrics_gauge")
    files = facts.groupBy("dt", F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("points"), F.min("time_unix_nano").alias("least"), F.max("time_unix_nano").alias("most"))
    before = "OVER (PARTITION BY dt ORDER BY least, most ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    files = files.withColumn("overlaps", F.expr(f"coalesce(least < max(most) {before}, false)"))
    return files.groupBy("dt").agg(F.sum("points").alias("points"), F.count_if("overlaps").alias("overlapping_files")) \
        .select(_dt_text(), "points", "overlapping_files")


def stored_tables(spark, sf_dir):
    """Which tables there are, and the rows of those."""
    store = _stored(spark, sf_dir)
    names = ("metrics_gauge", "metrics_sum", "metrics_histogram", "series_metadata", "series_current", "metrics_other")
    found = {t: store.exists(t) for t in names}
    rows = _rows_of(store, *[t for t in names if found[t]])
    return spark.createDataFrame(list(found.items()), "table string, found boolean").join(rows, "table", "left")


def stream_batches(spark, sf_dir):
    """One stream takes a file a micro-batch, another three; batches and points of each."""
    out = arrived = None
    for files in (1, 3):
        store = _fresh_store(spark)
        if not arrived:
            arrived = f"{store.root}/in"
            write_requests(bridge_requests(spark, sf_dir).repartition(6, "request_seq"), arrived)
        start_ingest(store, arrived, checkpoint=f"{store.root}/checkpoint", max_files_per_trigger=files,
                     available_now=True).awaitTermination()
        rows = store.table("ingest_audit").where(F.col("table") == "received_points").agg(
            F.countDistinct("batch_id").alias("batches"), F.sum("rows").alias("received"))
        points = store.table("metrics_gauge").agg(F.count(F.lit(1)).alias("gauge_points"))
        rows = rows.join(points).select(F.lit(files).cast("bigint").alias("files_a_batch"), "batches", "received", "gauge_points")
        out = rows if out is None else out.unionByName(rows)
    return out


def stored_points_by_attribute(spark, sf_dir):
    """Points of a range by service, by an attribute's value under a key and under any key, and by
    a key alone, through the attribute table."""
    store = _stored(spark, sf_dir)
    index, facts = store.table("series_attributes"), store.table("metrics_gauge")
    asked = {"service": ("service", "", "svc-1"), "host": ("resource", "host.name", "host-2"),
             "any key": ("point", None, "true"), "key alone": ("point", "odd", None), "none": ("scope", "host.name", None)}
    out = None
    for name, (level, key, value) in asked.items():
        hit = X.points_with_attribute(facts, index, *NAME_RANGE, level=level, key=key, value=value)
        rows = hit.groupBy("dt").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 3).alias("total")) \
            .select(F.lit(name).alias("asked"), _dt_text(), "points", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


def unnumbered_lines(spark, sf_dir):
    """A1, A2: requests without arrival numbers, in the order in which their files arrived and of the lines in
    a file; the last line wins. Each hour's requests stand by falling request_part, so the first part of an
    hour comes last. The files follow on one another like one file cut at line ends, each written by a task."""
    store = _fresh_store(spark)
    requests = bridge_requests(spark, sf_dir)
    lines = requests.orderBy("request_seq", F.col("request_part").desc())
    write_ordered_requests(lines.select("resourceMetrics"), f"{store.root}/in")
    write_batch(store, read_requests(spark, f"{store.root}/in"), batch_id=1)
    return _current_out(store.tables().current()).drop("last_request_seq")


def stored_closed_days(spark, sf_dir):
    """Merged metadata of a compacted month, after one hour's requests came again."""
    requests = bridge_requests(spark, sf_dir)
    store = _fresh_store(spark)
    write_batch(store, requests, batch_id=1)
    compact_metadata(store, 202401)
    write_batch(store, requests.where(F.col("request_seq") == AGAIN_HOUR), batch_id=2)
    return _current_out(store.current())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flatten_gauge_points": flatten_gauge_points,
    "flatten_sum_points": flatten_sum_points,
    "dropped_points_by_type": dropped_points_by_type,
    "validation_errors": validation_errors,
    "accepted_rejected_counts": accepted_rejected_counts,
    "service_names": service_names,
    "attribute_text": attribute_text,
    "point_values": point_values,
    "series_keys": series_keys,
    "metadata_first_per_request": metadata_first_per_request,
    "series_current": series_current_q,
    "series_listing": series_listing,
    "series_count_by_name": series_count_by_name,
    "host_attribute": host_attribute,
    "gauge_range_enriched": gauge_range_enriched,
    "sum_range_enriched": sum_range_enriched,
    "gauge_any_join": _any_join("gauge"),
    "sum_any_join": _any_join("sum"),
    "latest_gauge_20": _latest("gauge"),
    "latest_sum_20": _latest("sum"),
    "series_point_lookup": series_point_lookup,
    "name_in_range": name_in_range,
    "orphan_points": orphan_points,
    "received_counts": received_counts,
    "write_audit_summary": write_audit_summary,
    "table_row_counts": table_row_counts,
    "retention_keep": retention_keep,
    "no_recorded_value": no_recorded_value,
    "filter_service": filter_service,
    "filter_attr_key": filter_attr_key,
    "filter_attr_value": filter_attr_value,
    "histogram_points": histogram_points,
    "variety_series": variety_series,
    "variety_attribute_text": variety_attribute_text,
    "stored_gauge_range": stored_gauge_range,
    "stored_latest_gauge_20": stored_latest_gauge_20,
    "stored_series_current": stored_series_current,
    "stored_sum_range": stored_sum_range,
    "stored_sql_range": stored_sql_range,
    "stored_reinsert": stored_reinsert,
    "range_by_hash": range_by_hash,
    "hash_only_points": hash_only_points,
    "time_forms": time_forms,
    "rejected_bodies": rejected_bodies,
    "ingest_audit_counts": ingest_audit_counts,
    "expire_counts": expire_counts,
    "compact_with_append": compact_with_append,
    "stream_two_sources": stream_two_sources,
    "stored_other_types": stored_other_types,
    "compact_two_days_at_once": compact_two_days_at_once,
    "replayed_epoch": replayed_epoch,
    "audit_other_types": audit_other_types,
    "stored_view_unmatched": stored_view_unmatched,
    "file_time_order": file_time_order,
    "stored_tables": stored_tables,
    "stream_batches": stream_batches,
    "stored_closed_days": stored_closed_days,
    "unnumbered_lines": unnumbered_lines,
    "stored_points_by_attribute": stored_points_by_attribute,
}
