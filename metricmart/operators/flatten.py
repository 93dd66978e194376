"""Flatten requests into points.

Requests are exploded level by level (resource -> scope -> metric -> point)
with ``posexplode`` so every point keeps its position, which later decides
"first in request" (E1) and "last inserted" (E2). Resource- and scope-level
text (service name, attribute maps, canonical text) is computed once per
resource / scope, not once per point. What a level gives to its elements is taken
out of it before its explode, so that no element is copied along with the whole
level. Everything is a narrow transformation: the points of one request stay in the
task that read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.functions import (attribute_entries, entries_text, entries_to_map,
                                  identity_text, metric_hash, nanos_to_date,
                                  nanos_to_timestamp, point_value, service_name,
                                  unsigned_nanos)

# Metric type names as stored, and the tie rank that decides
# which of two same-identity rows of one request wins the merge.
GAUGE, SUM = "Gauge", "Sum"
HISTOGRAM, EXP_HISTOGRAM, SUMMARY = "Histogram", "ExpHistogram", "Summary"
TYPE_RANK = {GAUGE: 0, SUM: 1, HISTOGRAM: 2, EXP_HISTOGRAM: 3, SUMMARY: 4}

META_COLS = ["metric_name", "metric_description", "metric_unit", "metric_type", "service_name",
             "resource_attributes", "scope_attributes", "attributes", "scope_name",
             "scope_version"]
REQUEST = ["batch_id", "request_seq", "request_line", "request_part"]
ORD_COLS = [*REQUEST, "type_rank", "r_pos", "s_pos", "m_pos", "p_pos"]


def _metric_type(m):
    return (F.when(m["gauge"].isNotNull(), F.lit(GAUGE))
             .when(m["sum"].isNotNull(), F.lit(SUM))
             .when(m["histogram"].isNotNull(), F.lit(HISTOGRAM))
             .when(m["exponentialHistogram"].isNotNull(), F.lit(EXP_HISTOGRAM))
             .when(m["summary"].isNotNull(), F.lit(SUMMARY)))


def request_key(requests: DataFrame) -> tuple:
    """(request_seq, request_line, request_part) columns that identify and order requests.

    A request without an arrival number is ordered by its arrival time
    (``received_at``), then by its place in what arrived then (``line_order``, e.g. the
    line of its file), where the source knows them, and told apart by a hash of its
    content; without either, the hash is all there is. Distinct requests stay
    distinct for keep-first (identical ones collapse, which is harmless: they
    carry identical metadata)."""
    seq, content = F.col("request_seq").cast("bigint"), F.xxhash64("resourceMetrics")
    part = F.col("request_part")
    line = F.coalesce("line_order", F.lit(0)) if "line_order" in requests.columns else F.lit(0)
    if "received_at" not in requests.columns:
        return F.coalesce(seq, content), line.cast("bigint"), F.coalesce(part, F.lit(0)).cast("bigint")
    arrived = F.unix_micros("received_at")
    unnumbered = seq.isNull() & arrived.isNotNull()
    return (F.coalesce(seq, arrived, content), F.when(unnumbered, line).otherwise(0).cast("bigint"),
            F.coalesce(part, F.when(unnumbered, content), F.lit(0)).cast("bigint"))


def explode_metrics(requests: DataFrame, batch_id: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per metric, carrying request/resource/scope context (C1–C2 upper levels).

    With ``carry`` (request columns taken along) a level without elements keeps
    one row of NULLs, so that no request disappears."""
    explode = F.posexplode_outer if carry else F.posexplode
    seq, line, part = map(F.col, REQUEST[1:]) if carry else request_key(requests)
    req = requests.select(
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        seq.alias("request_seq"), line.alias("request_line"), part.alias("request_part"), *carry,
        explode("resourceMetrics").alias("r_pos", "rm"))
    res = req.select(
        *REQUEST, *carry, "r_pos",
        service_name("rm.resource.attributes").alias("service_name"),
        attribute_entries("rm.resource.attributes").alias("res_entries"),
        F.col("rm.scopeMetrics").alias("scopes"))
    res = res.select(
        *REQUEST, *carry, "r_pos", "service_name",
        entries_to_map("res_entries").alias("resource_attributes"),
        entries_text("res_entries").alias("res_text"),
        explode("scopes").alias("s_pos", "sm"))
    own = ["service_name", "resource_attributes", "res_text"]
    scope = res.select(
        *REQUEST, *carry, "r_pos", *own, "s_pos",
        F.coalesce(F.col("sm.scope.name"), F.lit("")).alias("scope_name"),
        F.coalesce(F.col("sm.scope.version"), F.lit("")).alias("scope_version"),
        attribute_entries("sm.scope.attributes").alias("scope_entries"),
        F.col("sm.metrics").alias("metrics"))
    scope = scope.select(
        *REQUEST, *carry, "r_pos", *own, "s_pos", "scope_name", "scope_version",
        entries_to_map("scope_entries").alias("scope_attributes"),
        entries_text("scope_entries").alias("scope_text"),
        explode("metrics").alias("m_pos", "m"))
    return scope.select(
        *REQUEST, *carry, "r_pos", "s_pos", "m_pos",
        *own, "scope_name", "scope_version", "scope_attributes", "scope_text",
        F.coalesce(F.col("m.name"), F.lit("")).alias("metric_name"),
        F.coalesce(F.col("m.description"), F.lit("")).alias("metric_description"),
        F.coalesce(F.col("m.unit"), F.lit("")).alias("metric_unit"),
        _metric_type(F.col("m")).alias("metric_type"),
        "m")


def _with_identity(pts: DataFrame, type_rank, **own) -> DataFrame:
    """Per-point identity, times and partition day for a frame with a point
    struct ``p`` (shared by every point type); ``own``: further columns of ``p``."""
    base = pts.select(
        *[c for c in pts.columns if c != "p"],
        attribute_entries("p.attributes").alias("attr_entries"),
        unsigned_nanos(F.col("p.startTimeUnixNano")).alias("start_time_unix_nano"),
        unsigned_nanos(F.col("p.timeUnixNano")).alias("time_unix_nano"),
        F.coalesce(F.col("p.flags"), F.lit(0)).cast("bigint").alias("flags"),
        *[c.alias(name) for name, c in own.items()])
    canonical = identity_text(F.col("metric_name"), F.col("service_name"), F.col("res_text"),
                              F.col("scope_text"), entries_text("attr_entries"))
    out = base.select(
        "*",
        entries_to_map("attr_entries").alias("attributes"),
        canonical.alias("canonical"),
        type_rank.alias("type_rank"),
        nanos_to_timestamp(F.col("time_unix_nano")).alias("ts"),
        nanos_to_date(F.col("time_unix_nano")).alias("dt"))
    return out.withColumn("metric_hash", metric_hash(F.col("canonical"))) \
              .drop("attr_entries", "res_text", "scope_text")


def flatten_points(requests: DataFrame, batch_id: int = 0) -> DataFrame:
    """Gauge and Sum points with identity, times and value.

    Other metric types produce no rows here (S22, B9); see ``dropped_points``.
    """
    metrics = explode_metrics(requests, batch_id).where(F.col("metric_type").isin(GAUGE, SUM))
    return _points(metrics, F.posexplode)


REJECTED, DROPPED = "Rejected", "Dropped"


def flatten_batch(validated: DataFrame, batch_id: int = 0, others: list[str] | tuple = ()) -> DataFrame:
    """Everything that ingest stores or counts, from one pass over validated requests.

    ``kind`` tells the rows apart: Gauge and Sum points as in ``flatten_points``, and
    points of the types in ``others``, with the columns of those types; Rejected, one
    row per rejected request with its ``error``; Dropped, one row per metric of any
    other type with its number of points in ``dropped``."""
    seq, line, part = request_key(validated)
    good = F.col("error").isNull()
    accepted = validated.select(
        F.when(good, seq).otherwise(F.col("request_seq")).cast("bigint").alias("request_seq"),
        line.alias("request_line"), F.when(good, part).otherwise(F.coalesce("request_part", F.lit(0))).cast("bigint").alias("request_part"),
        "error", F.when(good, F.col("resourceMetrics")).alias("resourceMetrics"))
    metrics = explode_metrics(accepted, batch_id, carry=("error",))
    size = F.coalesce(*[F.when(F.col("metric_type") == t, F.size(F.col(f"m.{field}.dataPoints")))
                        for t, field in _OTHER.items() if t not in others], F.lit(0))
    metrics = metrics.withColumn("dropped", F.greatest(size, F.lit(0)).cast("bigint"))
    rows = _all_points(metrics, others) if others else _points(metrics, F.posexplode_outer)
    kind = (F.when(F.col("error").isNotNull(), F.lit(REJECTED))
            .when(F.col("dropped") > 0, F.lit(DROPPED))
            .when(F.col("p_pos").isNotNull(), F.col("metric_type")))
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).drop("canonical")


def _points(metrics: DataFrame, explode) -> DataFrame:
    is_sum = F.col("metric_type") == SUM
    whole = metrics.select(
        *[c for c in metrics.columns if c != "m"],
        F.when(is_sum, F.col("m.sum.aggregationTemporality")).cast("int")
         .alias("aggregation_temporality"),
        F.when(is_sum, F.coalesce(F.col("m.sum.isMonotonic"), F.lit(False)))
         .alias("is_monotonic"),
        F.when(is_sum, F.col("m.sum.dataPoints"))
         .otherwise(F.col("m.gauge.dataPoints")).alias("points"))
    rank = F.when(is_sum, F.lit(TYPE_RANK[SUM])).otherwise(F.lit(TYPE_RANK[GAUGE]))
    out = _with_identity(_each_point(whole, explode), rank, value=point_value(F.col("p")))
    return out.select(*[c for c in out.columns if c != "value"], "value")


def _each_point(metrics: DataFrame, explode) -> DataFrame:
    """A row per element ``p`` of ``points``, with the other columns."""
    return metrics.select(*[c for c in metrics.columns if c != "points"], explode("points").alias("p_pos", "p"))


def _all_points(metrics: DataFrame, others: list[str] | tuple) -> DataFrame:
    """Points of gauges, sums and the types in ``others``, one explode for all: a
    metric's points take a common form first, with NULL for other types' columns."""
    fields = {GAUGE: "gauge", SUM: "sum", **{t: _OTHER[t] for t in others}}
    kinds = {name: kind for t in others for name, kind, _ in _other_columns(t)}

    def common(metric_type: str):
        own = {name: make for name, _, make in _other_columns(metric_type)} if metric_type in others else {}

        def form(p):
            taken = {n: make(p) for n, make in own.items()}
            return F.struct(
                p["attributes"].alias("attributes"), p["startTimeUnixNano"].alias("startTimeUnixNano"),
                p["timeUnixNano"].alias("timeUnixNano"), p["flags"].alias("flags"),
                (point_value(p) if metric_type in (GAUGE, SUM) else F.lit(None).cast("double")).alias("value"),
                *[taken.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()])
        return F.transform(F.col(f"m.{fields[metric_type]}.dataPoints"), form)

    of = lambda t: F.col("metric_type") == t
    temporality = F.coalesce(*[F.when(of(t), F.col(f"m.{f}.aggregationTemporality")).cast("int")
                               for t, f in fields.items() if t not in (GAUGE, SUMMARY)])
    points = F.coalesce(*[F.when(of(t), common(t)) for t in fields])
    whole = metrics.select(
        *[c for c in metrics.columns if c != "m"], temporality.alias("aggregation_temporality"),
        F.when(of(SUM), F.coalesce(F.col("m.sum.isMonotonic"), F.lit(False))).alias("is_monotonic"),
        points.alias("points"))
    rank = F.coalesce(*[F.when(of(t), F.lit(r)) for t, r in TYPE_RANK.items()], F.lit(0))
    names = ("value", *kinds)
    out = _with_identity(_each_point(whole, F.posexplode_outer), rank, **{n: F.col(f"p.{n}") for n in names})
    return out.select(*[c for c in out.columns if c not in names], *names)


def gauge_rows(points: DataFrame) -> DataFrame:
    """Slim gauge facts."""
    return points.where(F.col("metric_type") == GAUGE).select(
        "metric_hash", "start_time_unix_nano", "time_unix_nano", "ts", "value", "flags", "dt")


def sum_rows(points: DataFrame) -> DataFrame:
    """C4: slim sum facts."""
    return points.where(F.col("metric_type") == SUM).select(
        "metric_hash", "start_time_unix_nano", "time_unix_nano", "ts", "value", "flags",
        "aggregation_temporality", "is_monotonic", "dt")


def dropped_points(requests: DataFrame, batch_id: int = 0) -> DataFrame:
    """Points of types without insert logic, counted per request and type
    (they are never stored, S22/S23). Counts come from array sizes, no explode."""
    m = explode_metrics(requests, batch_id).where(
        F.col("metric_type").isin(HISTOGRAM, EXP_HISTOGRAM, SUMMARY))
    n = (F.when(F.col("metric_type") == HISTOGRAM, F.size(F.col("m.histogram.dataPoints")))
          .when(F.col("metric_type") == EXP_HISTOGRAM,
                F.size(F.col("m.exponentialHistogram.dataPoints")))
          .otherwise(F.size(F.col("m.summary.dataPoints"))))
    return m.select("batch_id", "request_seq", "request_part", "metric_type",
                    F.greatest(n, F.lit(0)).cast("bigint").alias("points"))


# ---- extensions X2–X4: points of the other three types (off by default) ----
_OTHER = {HISTOGRAM: "histogram", EXP_HISTOGRAM: "exponentialHistogram", SUMMARY: "summary"}


def _u64_array(c):
    return F.transform(c, lambda x: x.try_cast("bigint"))


def flatten_other_points(requests: DataFrame, metric_type: str, batch_id: int = 0) -> DataFrame:
    """Histogram / exponential-histogram / summary points with the same
    identity and metadata columns as gauge and sum points."""
    field = _OTHER[metric_type]
    metrics = explode_metrics(requests, batch_id).where(F.col("metric_type") == metric_type)
    temporality = (F.col(f"m.{field}.aggregationTemporality").cast("int")
                   if metric_type != SUMMARY else F.lit(None).cast("int"))
    whole = metrics.select(*[c for c in metrics.columns if c != "m"],
                           temporality.alias("aggregation_temporality"), F.col(f"m.{field}.dataPoints").alias("points"))
    own = {name: make(F.col("p")) for name, _, make in _other_columns(metric_type)}
    out = _with_identity(_each_point(whole, F.posexplode), F.lit(TYPE_RANK[metric_type]), **own)
    return out.select(*[c for c in out.columns if c not in own], *own)


def _other_columns(metric_type: str) -> list[tuple]:
    """(column, type, its expression of a point) of an extension type's own columns."""
    whole, counts = "bigint", "array<bigint>"
    columns = [("count", whole, lambda p: p["count"].try_cast("bigint")), ("sum", "double", lambda p: p["sum"])]
    if metric_type == SUMMARY:
        columns += [("value_at_quantiles", "array<struct<quantile:double,value:double>>", lambda p: p["quantileValues"])]
    else:
        columns += [("min", "double", lambda p: p["min"]), ("max", "double", lambda p: p["max"])]
    if metric_type == HISTOGRAM:
        columns += [("bucket_counts", counts, lambda p: _u64_array(p["bucketCounts"])),
                    ("explicit_bounds", "array<double>", lambda p: p["explicitBounds"])]
    elif metric_type == EXP_HISTOGRAM:
        columns += [("scale", "int", lambda p: p["scale"]),
                    ("zero_count", whole, lambda p: p["zeroCount"].try_cast("bigint")),
                    ("positive_offset", "int", lambda p: p["positive"]["offset"]),
                    ("positive_bucket_counts", counts, lambda p: _u64_array(p["positive"]["bucketCounts"])),
                    ("negative_offset", "int", lambda p: p["negative"]["offset"]),
                    ("negative_bucket_counts", counts, lambda p: _u64_array(p["negative"]["bucketCounts"]))]
    return columns


OTHER_COLUMNS = {
    "metrics_histogram": ["metric_hash", "start_time_unix_nano", "time_unix_nano", "count", "sum",
                          "bucket_counts", "explicit_bounds", "min", "max", "flags",
                          "aggregation_temporality", "dt"],
    "metrics_exponential_histogram": [
        "metric_hash", "start_time_unix_nano", "time_unix_nano", "count", "sum", "scale",
        "zero_count", "positive_offset", "positive_bucket_counts", "negative_offset",
        "negative_bucket_counts", "min", "max", "flags", "aggregation_temporality", "dt"],
    "metrics_summary": ["metric_hash", "start_time_unix_nano", "time_unix_nano", "count", "sum",
                        "value_at_quantiles", "flags", "dt"],
}
OTHER_TABLE = {HISTOGRAM: "metrics_histogram", EXP_HISTOGRAM: "metrics_exponential_histogram",
               SUMMARY: "metrics_summary"}


def other_rows(points: DataFrame, metric_type: str) -> DataFrame:
    """Fact rows of one extension table, in table column order."""
    return points.select(*OTHER_COLUMNS[OTHER_TABLE[metric_type]])
