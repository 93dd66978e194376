"""Request validation.

All-or-nothing per request (S1): the first violation in traversal order
(resource, scope, metric, point index — S5) rejects the whole request. The
check is one native expression over the nested arrays of a row, so it runs
map-side with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmart.functions.text import go_quote_sql, let_sql

# The three rejection messages.
MSG_EMPTY_NAME = "metric name must not be empty"
MSG_ZERO_TIME = "metric {name}: data point {index} has time_unix_nano=0 (required by OTLP spec)"
MSG_TEMPORALITY = "sum metric {name}: aggregation_temporality must not be UNSPECIFIED"


# Message of this engine: OTLP/JSON carries times as unsigned 64-bit decimals,
# so any other text makes the request undecodable.
MSG_BAD_TIME = "metric {name}: data point {index} has a time outside unsigned 64 bits"

# An element of a comma-joined list that is not surely good: times from 1 to
# 19 digits without a leading zero; starts may also be missing (N) or empty, or have zeros.
_UNSURE_TIME = "(^|,)(?![1-9][0-9]{0,18}(,|$))"
_UNSURE_START = "(^|,)(?!(N|[0-9]{0,19})(,|$))"


def _bad_sql(t: str) -> str:
    """True where a time text is there but is no unsigned 64-bit decimal."""
    return (f"({t} <> '' AND NOT coalesce({t} RLIKE '^[0-9]+$' AND "
            f"try_cast({t} AS DECIMAL(38,0)) <= 18446744073709551615, false))")


def _zero_time_sql(name: str, points: str) -> str:
    """First point in order whose time is missing or 0, or whose time or start
    time is no unsigned 64-bit decimal."""
    def message(text: str) -> str:
        pre, post = text.split("{name}")
        mid, tail = post.split("{index}")
        return f"concat('{pre}', {go_quote_sql(name)}, '{mid}', CAST(vf.i AS STRING), '{tail}')"

    fault = (f"CASE WHEN {_bad_sql('vp.timeUnixNano')} OR {_bad_sql('vp.startTimeUnixNano')} THEN 'bad' "
             f"WHEN vp.timeUnixNano IS NULL OR vp.timeUnixNano RLIKE '^0*$' THEN 'zero' END")
    first = (f"get(filter(transform(coalesce({points}, array()), (vp, vi) -> "
             f"named_struct('i', vi, 'fault', {fault})), vx -> vx.fault IS NOT NULL), 0)")
    exact = let_sql(first, "vf", f"CASE WHEN vf.fault = 'zero' THEN {message(MSG_ZERO_TIME)} "
                                 f"WHEN vf.fault = 'bad' THEN {message(MSG_BAD_TIME)} END")
    # Two searches over the joined texts settle every metric whose times are all
    # surely good (1..10^19-1, which is below 2^64); the exact check decides the rest.
    unsure = (f"size(coalesce({points}, array())) > 0 AND "
              f"(regexp_like(array_join({points}.timeUnixNano, ',', 'N'), '{_UNSURE_TIME}') OR "
              f"regexp_like(array_join({points}.startTimeUnixNano, ',', 'N'), '{_UNSURE_START}'))")
    return f"CASE WHEN {unsure} THEN {exact} END"


def _metric_error_sql(m: str) -> str:
    name = f"coalesce({m}.name, '')"
    pre, tail = MSG_TEMPORALITY.split("{name}")
    return (f"CASE WHEN {name} = '' THEN '{MSG_EMPTY_NAME}' "                     # B1 first (S2)
            f"WHEN {m}.gauge IS NOT NULL THEN {_zero_time_sql(name, f'{m}.gauge.dataPoints')} "  # B2
            f"WHEN {m}.sum IS NOT NULL THEN "
            f"CASE WHEN coalesce({m}.sum.aggregationTemporality, 0) = 0 "        # B4 before B3 (S4)
            f"THEN concat('{pre}', {go_quote_sql(name)}, '{tail}') "
            f"ELSE {_zero_time_sql(name, f'{m}.sum.dataPoints')} END "
            f"END")                                   # other types: name check only (S3)


def first_error_sql(resource_metrics: str) -> str:
    """First violation in traversal order, or NULL for a valid request."""
    per_metric = (f"flatten(transform(coalesce({resource_metrics}, array()), vr -> "
                  f"flatten(transform(coalesce(vr.scopeMetrics, array()), vs -> "
                  f"transform(coalesce(vs.metrics, array()), vm -> {_metric_error_sql('vm')})))))")
    return f"get(filter({per_metric}, ve -> ve IS NOT NULL), 0)"


def first_error(resource_metrics: str = "resourceMetrics") -> Column:
    return F.expr(first_error_sql(resource_metrics))


def with_validation(requests: DataFrame) -> DataFrame:
    """``error``: why the request is rejected, NULL if it isn't. A body that did
    not decode (``decode_error``, set by the sources) is rejected for that."""
    error = first_error("resourceMetrics")
    if "decode_error" in requests.columns:
        return requests.withColumn("error", F.coalesce("decode_error", error)).drop("decode_error")
    return requests.withColumn("error", error)


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted requests, rejected (request_seq, request_part, error))."""
    v = with_validation(requests)
    accepted = v.where(F.col("error").isNull()).drop("error")
    rejected = v.where(F.col("error").isNotNull()).select("request_seq", "request_part", "error")
    return accepted, rejected
