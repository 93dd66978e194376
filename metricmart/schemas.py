"""Explicit schemas: the export request (input) and the stored tables.

Field names of the request follow the public OTLP/JSON encoding. 64-bit
integers are STRING because OTLP/JSON quotes them; `arrayValue`/`kvlistValue`
keep raw JSON text because AnyValue is recursive.
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DateType, DoubleType,
                               IntegerType, LongType, MapType, StringType,
                               StructField, StructType, TimestampType)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


ANY_VALUE = _s(("stringValue", StringType()), ("intValue", StringType()),
               ("doubleValue", DoubleType()), ("boolValue", BooleanType()),
               ("bytesValue", StringType()), ("arrayValue", StringType()),
               ("kvlistValue", StringType()))
KEY_VALUE = _s(("key", StringType()), ("value", ANY_VALUE))
ATTRS = ArrayType(KEY_VALUE)

NUMBER_POINT = _s(("attributes", ATTRS), ("startTimeUnixNano", StringType()),
                  ("timeUnixNano", StringType()), ("asDouble", DoubleType()),
                  ("asInt", StringType()), ("flags", LongType()))

HISTOGRAM_POINT = _s(("attributes", ATTRS), ("startTimeUnixNano", StringType()),
                     ("timeUnixNano", StringType()), ("count", StringType()),
                     ("sum", DoubleType()), ("bucketCounts", ArrayType(StringType())),
                     ("explicitBounds", ArrayType(DoubleType())), ("min", DoubleType()),
                     ("max", DoubleType()), ("flags", LongType()))

BUCKETS = _s(("offset", IntegerType()), ("bucketCounts", ArrayType(StringType())))
EXP_HISTOGRAM_POINT = _s(("attributes", ATTRS), ("startTimeUnixNano", StringType()),
                         ("timeUnixNano", StringType()), ("count", StringType()),
                         ("sum", DoubleType()), ("scale", IntegerType()),
                         ("zeroCount", StringType()), ("positive", BUCKETS),
                         ("negative", BUCKETS), ("min", DoubleType()),
                         ("max", DoubleType()), ("flags", LongType()))

QUANTILE = _s(("quantile", DoubleType()), ("value", DoubleType()))
SUMMARY_POINT = _s(("attributes", ATTRS), ("startTimeUnixNano", StringType()),
                   ("timeUnixNano", StringType()), ("count", StringType()),
                   ("sum", DoubleType()), ("quantileValues", ArrayType(QUANTILE)),
                   ("flags", LongType()))

METRIC = _s(
    ("name", StringType()), ("description", StringType()), ("unit", StringType()),
    ("gauge", _s(("dataPoints", ArrayType(NUMBER_POINT)))),
    ("sum", _s(("aggregationTemporality", IntegerType()), ("isMonotonic", BooleanType()),
               ("dataPoints", ArrayType(NUMBER_POINT)))),
    ("histogram", _s(("aggregationTemporality", IntegerType()),
                     ("dataPoints", ArrayType(HISTOGRAM_POINT)))),
    ("exponentialHistogram", _s(("aggregationTemporality", IntegerType()),
                                ("dataPoints", ArrayType(EXP_HISTOGRAM_POINT)))),
    ("summary", _s(("dataPoints", ArrayType(SUMMARY_POINT)))),
)

SCOPE_METRICS = _s(("scope", _s(("name", StringType()), ("version", StringType()),
                                 ("attributes", ATTRS))),
                   ("metrics", ArrayType(METRIC)))
RESOURCE_METRICS = _s(("resource", _s(("attributes", ATTRS))),
                      ("scopeMetrics", ArrayType(SCOPE_METRICS)))

# One row per export request. `request_seq` is the arrival order that decides
# "last wins" across requests; `request_part` distinguishes requests that share
# an arrival slot (0 when there is one).
EXPORT_REQUEST = StructType([
    StructField("request_seq", LongType(), True),
    StructField("request_part", LongType(), True),
    StructField("resourceMetrics", ArrayType(RESOURCE_METRICS), True),
])

# Body only (what a Kafka value / HTTP body carries), for from_json.
EXPORT_BODY = StructType([StructField("resourceMetrics", ArrayType(RESOURCE_METRICS), True)])

STRMAP = MapType(StringType(), StringType())

ORD = _s(("batch_id", LongType()), ("request_seq", LongType()), ("request_line", LongType()),
         ("request_part", LongType()),
         ("type_rank", IntegerType()), ("r_pos", IntegerType()), ("s_pos", IntegerType()),
         ("m_pos", IntegerType()), ("p_pos", IntegerType()))

# ---- stored tables --------------------------------------------------------
GAUGE = StructType([
    StructField("metric_hash", LongType()), StructField("start_time_unix_nano", LongType()),
    StructField("time_unix_nano", LongType()), StructField("ts", TimestampType()),
    StructField("value", DoubleType()), StructField("flags", LongType()),
    StructField("dt", DateType()),
])
SUM = StructType(GAUGE.fields[:-1] + [
    StructField("aggregation_temporality", IntegerType()),
    StructField("is_monotonic", BooleanType()), StructField("dt", DateType()),
])
METADATA = StructType([
    StructField("dt", DateType()), StructField("metric_hash", LongType()),
    StructField("metric_name", StringType()), StructField("metric_description", StringType()),
    StructField("metric_unit", StringType()), StructField("metric_type", StringType()),
    StructField("service_name", StringType()),
    StructField("resource_attributes", STRMAP), StructField("scope_attributes", STRMAP),
    StructField("attributes", STRMAP), StructField("scope_name", StringType()),
    StructField("scope_version", StringType()), StructField("ord", ORD),
    StructField("month", IntegerType()),
])
HISTOGRAM = StructType([
    StructField("metric_hash", LongType()), StructField("start_time_unix_nano", LongType()),
    StructField("time_unix_nano", LongType()), StructField("count", LongType()),
    StructField("sum", DoubleType()), StructField("bucket_counts", ArrayType(LongType())),
    StructField("explicit_bounds", ArrayType(DoubleType())), StructField("min", DoubleType()),
    StructField("max", DoubleType()), StructField("flags", LongType()),
    StructField("aggregation_temporality", IntegerType()), StructField("dt", DateType()),
])
EXP_HISTOGRAM = StructType([
    StructField("metric_hash", LongType()), StructField("start_time_unix_nano", LongType()),
    StructField("time_unix_nano", LongType()), StructField("count", LongType()),
    StructField("sum", DoubleType()), StructField("scale", IntegerType()),
    StructField("zero_count", LongType()), StructField("positive_offset", IntegerType()),
    StructField("positive_bucket_counts", ArrayType(LongType())),
    StructField("negative_offset", IntegerType()),
    StructField("negative_bucket_counts", ArrayType(LongType())),
    StructField("min", DoubleType()), StructField("max", DoubleType()),
    StructField("flags", LongType()), StructField("aggregation_temporality", IntegerType()),
    StructField("dt", DateType()),
])
SUMMARY = StructType([
    StructField("metric_hash", LongType()), StructField("start_time_unix_nano", LongType()),
    StructField("time_unix_nano", LongType()), StructField("count", LongType()),
    StructField("sum", DoubleType()), StructField("value_at_quantiles", ArrayType(QUANTILE)),
    StructField("flags", LongType()), StructField("dt", DateType()),
])
# Which series had an attribute on a day: level is resource, scope or point, or service
# (the key is then empty and the value the service's name).
ATTRIBUTES = StructType([
    StructField("level", StringType()), StructField("attr_key", StringType()),
    StructField("attr_value", StringType()), StructField("dt", DateType()),
    StructField("metric_hash", LongType()), StructField("month", IntegerType()),
])
# A log row's day and time are those of its batch's first attempt.
REJECTED = StructType([
    StructField("batch_id", LongType()), StructField("request_seq", LongType()),
    StructField("request_part", LongType()), StructField("error", StringType()),
    StructField("day", DateType()),
])
AUDIT = StructType([
    StructField("batch_id", LongType()), StructField("table", StringType()),
    StructField("status", StringType()), StructField("rows", LongType()),
    StructField("duration_ms", DoubleType()), StructField("writer", StringType()),
    StructField("at", TimestampType()), StructField("day", DateType()),
])

# Second partition column of every table: the write generation that a row came with.
GENERATION = "gen"

# Logical table name -> (schema, partition columns before the generation)
TABLES = {
    "series_metadata": (METADATA, ["month"]),
    "series_attributes": (ATTRIBUTES, ["month"]),
    "metrics_gauge": (GAUGE, ["dt"]),
    "metrics_sum": (SUM, ["dt"]),
    "metrics_histogram": (HISTOGRAM, ["dt"]),
    "metrics_exponential_histogram": (EXP_HISTOGRAM, ["dt"]),
    "metrics_summary": (SUMMARY, ["dt"]),
    "rejected_requests": (REJECTED, ["day"]),
    "ingest_audit": (AUDIT, ["day"]),
}
