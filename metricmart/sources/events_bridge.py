"""Bridge: the driver's ``events`` table as a stream of OTLP export requests.

Each event becomes one metric point; points are nested back into requests
(request -> resource per host -> scope -> metric per event type -> points),
exactly the shape the ingest path reads from JSON or nested Parquet.

Mapping (both engines compute it; see the oracle SQL):

* time_unix_nano = event ts (UTC) in nanoseconds; request_seq = hour index;
  dt = UTC day.
* request_part = event_id div REQUEST_PART_EVENTS. A request is the pair
  (request_seq, request_part), so no request row holds more than
  REQUEST_PART_EVENTS points however large an hour gets (the reference caps a
  request at 16 MiB); at every test scale some hours have several parts.
* metric name 'events.<type>'; click, view -> Gauge; purchase, signup -> Sum;
  error -> Histogram (dropped at ingest).
* resource per host = user_id % 4, attributes [service.name = svc-(user_id % 2),
  host.name = host-(user_id % 4)]; two scopes per resource named 'events',
  scope index event_id % 2, version '<scope>.<request_seq % 2>'.
* point attributes bucket = k % 2 (int), odd = k % 2 = 1 (bool), k = props.k;
  value unset for k < 5, asInt floor(value) for k < 10, else asDouble value;
  flags 1 when k % 10 = 0; start time = start of the hour.
* sums: purchase temporality 2 monotonic, signup temporality 1 not monotonic.
* description 'desc <request_seq % 3>', unit '{<type>}'.

``variant="faulty"`` injects validation faults: time 0 where event_id % 97 = 0,
empty name for the signup metric where request_seq % 5 = 0, temporality 0 for
purchase where request_seq % 7 = 0.

``variant="times"`` gives event_id % 97 = 0 a time of 20 nines, outside 64 bits.

``variant="types"`` spreads error points over three types by res = user_id % 4: 1 ->
exponential histogram (scale 3, zero count 4, positive offset 2 with counts 1, 2, negative
offset -1 with count 7, max = value); 2 -> summary (quantiles 0.5 -> value, 0.99 ->
2 * value); else histogram (counts 1, 0 around the bound 0.5, max = value).

``variant="variety"`` exercises attribute edge cases: one resource per
user_id % 20 = r, host.name = host-(r % 4), and by r % 5: 0 -> no service.name;
1 -> service.name as an int (r % 2); 2 -> service.name 'svc-a', host.name,
service.name svc-(r % 2) (first wins for the service, last for the map);
3 -> svc-(r % 2), host.name, and doubles weight = r / 8, scale = r * 1e5,
tiny = r / 1e6; 4 -> as clean.

The nesting is four aggregations over one shuffle by request, each keyed by a
bounded group (one metric's points within one request part at the finest
level).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from metricmart.schemas import (ANY_VALUE, ATTRS, HISTOGRAM_POINT, METRIC, NUMBER_POINT,
                                RESOURCE_METRICS, SCOPE_METRICS)

# Fixed values of the bridge.
REQUEST_PART_EVENTS = 100
RESOURCES = {"clean": 4, "faulty": 4, "times": 4, "types": 4, "variety": 20}     # resource index = user_id % this
HOUR_NANOS = 3_600_000_000_000
GAUGE_EVENTS = ("click", "view")
SUM_EVENTS = ("purchase", "signup")
HISTOGRAM_EVENTS = ("error",)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def keyed_events(events: DataFrame) -> DataFrame:
    """One row per event with its time and the request it goes to (flat, no shuffle)."""
    nanos = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                   "cast(ts as timestamp_ntz))") * F.lit(1000)
    df = events.select("event_id", "user_id", "event_type", "value", "props", nanos.alias("time_unix_nano"))
    return df.select(
        "*", F.call_function("div", F.col("time_unix_nano"), F.lit(HOUR_NANOS)).alias("request_seq"),
        F.call_function("div", F.col("event_id"), F.lit(REQUEST_PART_EVENTS)).alias("request_part"))


def event_points(events: DataFrame, variant: str = "clean") -> DataFrame:
    """One row per event with every derived bridge column (flat, no shuffle)."""
    return points_of(keyed_events(events), variant)


def points_of(keyed: DataFrame, variant: str = "clean") -> DataFrame:
    """``event_points`` of events that have their keys."""
    faulty = variant == "faulty"
    df = keyed.select(
        "event_id", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), "time_unix_nano", "request_seq", "request_part",
        F.pmod("user_id", F.lit(RESOURCES[variant])).alias("res_idx"),
        F.pmod("event_id", F.lit(2)).alias("scope_idx"))
    t = F.col("event_type")
    bad_time = (F.pmod("event_id", F.lit(97)) == 0) if variant in ("faulty", "times") else F.lit(False)
    time_text = F.when(bad_time, F.lit("0" if faulty else "9" * 20)).otherwise(F.col("time_unix_nano").cast("string"))
    start_text = (F.col("request_seq") * F.lit(HOUR_NANOS)).cast("string")
    kv = F.col("k")
    attrs = F.array(
        _kv("bucket", int_value=F.pmod(kv, F.lit(2)).cast("string")),
        _kv("odd", bool_value=F.pmod(kv, F.lit(2)) == 1))
    num_point = F.struct(
        attrs.alias("attributes"), start_text.alias("startTimeUnixNano"),
        time_text.alias("timeUnixNano"),
        F.when(kv >= 10, F.col("value")).cast("double").alias("asDouble"),
        F.when((kv >= 5) & (kv < 10), F.floor("value").cast("bigint").cast("string")).alias("asInt"),
        F.when(F.pmod(kv, F.lit(10)) == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("flags"),
    ).cast(NUMBER_POINT)
    hist_point = F.struct(
        attrs.alias("attributes"), start_text.alias("startTimeUnixNano"),
        time_text.alias("timeUnixNano"), F.lit("1").alias("count"),
        F.col("value").alias("sum"), F.lit(None).cast("array<string>").alias("bucketCounts"),
        F.lit(None).cast("array<double>").alias("explicitBounds"),
        F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
        F.lit(0).cast("bigint").alias("flags"),
    ).cast(HISTOGRAM_POINT)
    return df.select(
        "*",
        F.when(t.isin(*HISTOGRAM_EVENTS), F.lit(None)).otherwise(num_point).alias("num_point"),
        F.when(t.isin(*HISTOGRAM_EVENTS), hist_point).alias("hist_point"))


def _resource_attributes(res: Column, variant: str) -> Column:
    """Resource attribute list of resource index ``res`` (see module doc)."""
    svc = _kv("service.name", string_value=F.concat(F.lit("svc-"), F.pmod(res, F.lit(2)).cast("string")))
    host = _kv("host.name", string_value=F.concat(F.lit("host-"), F.pmod(res, F.lit(4)).cast("string")))
    if variant != "variety":
        return F.array(svc, host)
    kind = F.pmod(res, F.lit(5))
    d = res.cast("double")
    return (F.when(kind == 0, F.array(host))
             .when(kind == 1, F.array(_kv("service.name", int_value=F.pmod(res, F.lit(2)).cast("string")),
                                      host))
             .when(kind == 2, F.array(_kv("service.name", string_value=F.lit("svc-a")), host, svc))
             .when(kind == 3, F.array(svc, host,
                                      _kv("weight", double_value=d / F.lit(8.0)),
                                      _kv("scale", double_value=d * F.lit(100000.0)),
                                      _kv("tiny", double_value=d / F.lit(1000000.0))))
             .otherwise(F.array(svc, host)))


def _kv(key: str, string_value: Column | None = None, int_value: Column | None = None,
        bool_value: Column | None = None, double_value: Column | None = None) -> Column:
    none = F.lit(None)
    val = F.struct(
        (string_value if string_value is not None else none.cast("string")).alias("stringValue"),
        (int_value if int_value is not None else none.cast("string")).alias("intValue"),
        (double_value if double_value is not None else none.cast("double")).alias("doubleValue"),
        (bool_value if bool_value is not None else none.cast("boolean")).alias("boolValue"),
        none.cast("string").alias("bytesValue"), none.cast("string").alias("arrayValue"),
        none.cast("string").alias("kvlistValue")).cast(ANY_VALUE)
    return F.struct(F.lit(key).alias("key"), val.alias("value"))


def _exponential(p: Column) -> Column:
    def buckets(offset, *counts):
        return F.struct(F.lit(offset).alias("offset"), F.array(*[F.lit(c) for c in counts]).alias("bucketCounts"))
    return F.struct(
        *[p[c].alias(c) for c in ("attributes", "startTimeUnixNano", "timeUnixNano", "count", "sum")],
        F.lit(3).alias("scale"), F.lit("4").alias("zeroCount"), buckets(2, "1", "2").alias("positive"),
        buckets(-1, "7").alias("negative"), p["min"].alias("min"), p["max"].alias("max"), p["flags"].alias("flags"))


def _summary(p: Column) -> Column:
    def quantile(q, value):
        return F.struct(F.lit(q).alias("quantile"), value.alias("value"))
    return F.struct(
        *[p[c].alias(c) for c in ("attributes", "startTimeUnixNano", "timeUnixNano", "count", "sum")],
        F.array(quantile(0.5, p["sum"]), quantile(0.99, p["sum"] * 2)).alias("quantileValues"), p["flags"].alias("flags"))


def _sorted_payload(order: Column, payload: Column) -> Column:
    """collect_list sorted by a unique order key, order key dropped."""
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), payload.alias("p"))))
    return F.transform(items, lambda x: x["p"])


def requests_from_events(events: DataFrame, variant: str = "clean") -> DataFrame:
    """Nest bridged events into export requests (one row per request)."""
    faulty = variant == "faulty"
    req = ["request_seq", "request_part"]
    # One shuffle: every later grouping key starts with the request, so this
    # clustering satisfies all four nesting aggregations without new exchanges.
    # The narrow events are shuffled and their points made behind it, by all tasks,
    # however few row groups (hence reading tasks) the table has.
    pts = points_of(keyed_events(events).repartition(*req), variant)

    # level 1: one metric (event type) of one scope of one resource
    m = (pts.groupBy(*req, "res_idx", "scope_idx", "event_type")
         .agg(_sorted_payload(F.col("event_id"), F.col("num_point")).alias("num_points"),
              _sorted_payload(F.col("event_id"), F.col("hist_point")).alias("hist_points")))
    t = F.col("event_type")
    rs = F.col("request_seq")
    name = F.concat(F.lit("events."), t)
    if faulty:
        name = F.when((t == "signup") & (F.pmod(rs, F.lit(5)) == 0), F.lit("")).otherwise(name)
    temporality = F.when(t == "purchase", F.lit(2)).otherwise(F.lit(1))
    if faulty:
        temporality = F.when((t == "purchase") & (F.pmod(rs, F.lit(7)) == 0), F.lit(0)) \
            .otherwise(temporality)
    none = F.lit(None)
    error, points = t.isin(*HISTOGRAM_EVENTS), F.col("hist_points")
    kind = F.pmod("res_idx", F.lit(4)) if variant == "types" else F.lit(0)
    if variant == "types":
        points = F.transform(points, lambda p: p.withField("bucketCounts", F.array(F.lit("1"), F.lit("0")))
                             .withField("explicitBounds", F.array(F.lit(0.5))).withField("max", p["sum"]))
    metric = F.struct(
        name.alias("name"),
        F.concat(F.lit("desc "), F.pmod(rs, F.lit(3)).cast("string")).alias("description"),
        F.concat(F.lit("{"), t, F.lit("}")).alias("unit"),
        F.when(t.isin(*GAUGE_EVENTS), F.struct(F.col("num_points").alias("dataPoints")))
         .alias("gauge"),
        F.when(t.isin(*SUM_EVENTS), F.struct(temporality.alias("aggregationTemporality"),
                                            (t == "purchase").alias("isMonotonic"),
                                            F.col("num_points").alias("dataPoints")))
         .alias("sum"),
        F.when(error & ~kind.isin(1, 2), F.struct(F.lit(2).alias("aggregationTemporality"),
                                                  points.alias("dataPoints")))
         .alias("histogram"),
        F.when(error & (kind == 1), F.struct(F.lit(1).alias("aggregationTemporality"),
                                             F.transform(points, _exponential).alias("dataPoints")))
         .alias("exponentialHistogram"),
        F.when(error & (kind == 2), F.struct(F.transform(points, _summary).alias("dataPoints")))
         .alias("summary"),
    ).cast(METRIC)

    # level 2: scope
    s = (m.groupBy(*req, "res_idx", "scope_idx")
         .agg(_sorted_payload(t, metric).alias("metrics")))
    scope = F.struct(
        F.struct(F.lit("events").alias("name"),
                 F.concat(F.col("scope_idx").cast("string"), F.lit("."),
                          F.pmod(rs, F.lit(2)).cast("string")).alias("version"),
                 F.lit(None).cast(ATTRS).alias("attributes")).alias("scope"),
        F.col("metrics").alias("metrics")).cast(SCOPE_METRICS)

    # level 3: resource
    r = (s.groupBy(*req, "res_idx")
         .agg(_sorted_payload(F.col("scope_idx"), scope).alias("scopeMetrics")))
    res = F.col("res_idx")
    resource = F.struct(
        F.struct(_resource_attributes(res, variant).alias("attributes")).alias("resource"),
        F.col("scopeMetrics").alias("scopeMetrics")).cast(RESOURCE_METRICS)

    # level 4: request
    return (r.groupBy(*req)
            .agg(_sorted_payload(res, resource).alias("resourceMetrics"))
            .select("request_seq", "request_part",
                    F.col("resourceMetrics").cast(ArrayType(RESOURCE_METRICS))))


def bridge_requests(spark: SparkSession, sf_dir: str, variant: str = "clean") -> DataFrame:
    return requests_from_events(read_events(spark, sf_dir), variant)
