"""Oracle SQL (DuckDB dialect) for every registered query.

Written independently of the Spark code: it maps ``events`` straight to
points in SQL (the bridge rules in sources/events_bridge.py), with no nesting
and no explode, and derives the series key as md5 of the identity text.
"""

from __future__ import annotations

from metricmart.plans.named_queries import (AGAIN_HOUR, GAUGE_RANGE, NAME_FILTER, NAME_RANGE, NEXT_DAY, ORPHAN_DAY,
                                            SUM_RANGE)

# identity text of a bridged point (columns of the pt CTE)
_CANON = """metric_name || chr(0) || service_name || chr(0)
           || 'host.name' || chr(2) || host_name || chr(1) || 'service.name' || chr(2) || service_name
           || chr(0) || chr(0)
           || 'bucket' || chr(2) || bucket || chr(1) || 'odd' || chr(2) || odd"""

_BASE = """
WITH ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         epoch_us(ts) * 1000 AS time_unix_nano,
         CAST(ts AS DATE) AS dt
  FROM events
), pt AS (
  SELECT ev.*,
         time_unix_nano // 3600000000000 AS request_seq,
         event_id // 100 AS request_part,
         user_id % 4 AS r_pos,
         event_id % 2 AS s_pos,
         'events.' || event_type AS metric_name,
         CASE WHEN event_type IN ('click', 'view') THEN 'Gauge'
              WHEN event_type IN ('purchase', 'signup') THEN 'Sum'
              ELSE 'Histogram' END AS metric_type,
         'svc-' || CAST(user_id % 2 AS VARCHAR) AS service_name,
         'host-' || CAST(user_id % 4 AS VARCHAR) AS host_name,
         CAST(k % 2 AS VARCHAR) AS bucket,
         CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END AS odd,
         CASE WHEN k < 5 THEN CAST(0 AS DOUBLE)
              WHEN k < 10 THEN CAST(CAST(floor(value) AS BIGINT) AS DOUBLE)
              ELSE value END AS pvalue,
         CAST(CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS flags,
         (time_unix_nano // 3600000000000) * 3600000000000 AS start_time_unix_nano,
         'desc ' || CAST((time_unix_nano // 3600000000000) % 3 AS VARCHAR) AS metric_description,
         '{' || event_type || '}' AS metric_unit,
         CAST(event_id % 2 AS VARCHAR) || '.'
           || CAST((time_unix_nano // 3600000000000) % 2 AS VARCHAR) AS scope_version
  FROM ev
), np AS (
  SELECT pt.*,
         __CANON__ AS canonical,
         'host.name=' || host_name || ',service.name=' || service_name AS resource_attrs,
         'bucket=' || bucket || ',odd=' || odd AS point_attrs,
         CAST(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS BIGINT) AS aggregation_temporality,
         event_type = 'purchase' AS is_monotonic
  FROM pt WHERE metric_type IN ('Gauge', 'Sum')
), np2 AS (
  SELECT np.*, md5(canonical) AS series_key FROM np
), meta1 AS (
  SELECT * FROM (
    SELECT np2.*, row_number() OVER (
      PARTITION BY request_seq, request_part, metric_type, series_key, dt
      ORDER BY s_pos, event_id) AS rn1
    FROM np2) WHERE rn1 = 1
), cur AS (
  SELECT * FROM (
    SELECT meta1.*, row_number() OVER (
      PARTITION BY dt, metric_name, series_key
      ORDER BY request_seq DESC, request_part DESC) AS rn2
    FROM meta1) WHERE rn2 = 1
)
"""

_BASE = _BASE.replace("__CANON__", _CANON)

# Faulty variant: first validation error per request.
_FAULTY = """
WITH ev AS (
  SELECT event_id, user_id, event_type,
         epoch_us(ts) * 1000 AS time_unix_nano
  FROM events
), pt AS (
  SELECT ev.*,
         time_unix_nano // 3600000000000 AS request_seq,
         event_id // 100 AS request_part,
         user_id % 4 AS r_pos,
         event_id % 2 AS s_pos,
         CASE WHEN event_type IN ('click', 'view') THEN 'Gauge'
              WHEN event_type IN ('purchase', 'signup') THEN 'Sum'
              ELSE 'Histogram' END AS metric_type,
         row_number() OVER (
           PARTITION BY time_unix_nano // 3600000000000, event_id // 100, user_id % 4,
                        event_id % 2, event_type
           ORDER BY event_id) - 1 AS p_pos
  FROM ev
), mg AS (
  SELECT request_seq, request_part, r_pos, s_pos, event_type,
         min(CASE WHEN event_id % 97 = 0 THEN p_pos END) AS zero_idx
  FROM pt GROUP BY ALL
), me AS (
  SELECT mg.*,
    CASE
      WHEN event_type = 'signup' AND request_seq % 5 = 0 THEN 'metric name must not be empty'
      WHEN event_type = 'purchase' AND request_seq % 7 = 0
        THEN 'sum metric "events.purchase": aggregation_temporality must not be UNSPECIFIED'
      WHEN event_type <> 'error' AND zero_idx IS NOT NULL
        THEN 'metric "events.' || event_type || '": data point ' || CAST(zero_idx AS VARCHAR)
             || ' has time_unix_nano=0 (required by OTLP spec)'
    END AS error
  FROM mg
), firsterr AS (
  SELECT request_seq, request_part, error FROM (
    SELECT me.*, row_number() OVER (
      PARTITION BY request_seq, request_part ORDER BY r_pos, s_pos, event_type) AS rn
    FROM me WHERE error IS NOT NULL) WHERE rn = 1
)
"""

# Times variant: the only fault is a time of 20 nines.
_FIRST_FAULTS = """      WHEN event_type = 'signup' AND request_seq % 5 = 0 THEN 'metric name must not be empty'
      WHEN event_type = 'purchase' AND request_seq % 7 = 0
        THEN 'sum metric "events.purchase": aggregation_temporality must not be UNSPECIFIED'
"""
assert _FIRST_FAULTS in _FAULTY
_TIMES = _FAULTY.replace(_FIRST_FAULTS, "").replace(
    "' has time_unix_nano=0 (required by OTLP spec)'", "' has a time outside unsigned 64 bits'")

# Variety variant: resource attributes with edge cases, Go %g text of doubles
# derived from DuckDB's shortest double text.
_VARIETY = """
WITH ev AS (
  SELECT event_id, user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
), pt AS (
  SELECT ev.*, user_id % 20 AS res, 'events.' || event_type AS metric_name,
         CAST(k % 2 AS VARCHAR) AS bucket,
         CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END AS odd
  FROM ev WHERE event_type <> 'error'
), dv AS (
  SELECT DISTINCT res, 'weight' AS key, CAST(res AS DOUBLE) / 8.0 AS x FROM pt WHERE res % 5 = 3
  UNION ALL SELECT DISTINCT res, 'scale', CAST(res AS DOUBLE) * 100000.0 FROM pt WHERE res % 5 = 3
  UNION ALL SELECT DISTINCT res, 'tiny', CAST(res AS DOUBLE) / 1000000.0 FROM pt WHERE res % 5 = 3
), g1 AS (
  SELECT dv.*, CAST(abs(x) AS VARCHAR) AS s FROM dv
), g2 AS (
  SELECT g1.*, split_part(s, 'e', 1) AS mant,
         CASE WHEN contains(s, 'e') THEN CAST(split_part(s, 'e', 2) AS INTEGER) ELSE 0 END AS e10
  FROM g1
), g3 AS (
  SELECT g2.*, split_part(mant, '.', 1) AS ip,
         CASE WHEN contains(mant, '.') THEN split_part(mant, '.', 2) ELSE '' END AS fp
  FROM g2
), g4 AS (
  SELECT g3.*, ip || fp AS raw, ltrim(ip || fp, '0') AS nl FROM g3
), g5 AS (
  SELECT g4.*, rtrim(nl, '0') AS d, length(ip) + e10 - (length(raw) - length(nl)) AS p FROM g4
), gtxt AS (
  SELECT res, key,
    CASE WHEN x = 0 THEN '0' ELSE
      (CASE WHEN x < 0 THEN '-' ELSE '' END) ||
      CASE WHEN p - 1 < -4 OR p - 1 >= 6
             THEN substr(d, 1, 1) || CASE WHEN length(d) > 1 THEN '.' || substr(d, 2) ELSE '' END
                  || 'e' || CASE WHEN p - 1 < 0 THEN '-' ELSE '+' END
                  || CASE WHEN abs(p - 1) < 10 THEN '0' ELSE '' END || CAST(abs(p - 1) AS VARCHAR)
           WHEN p <= 0 THEN '0.' || repeat('0', -p) || d
           WHEN p >= length(d) THEN d || repeat('0', p - length(d))
           ELSE substr(d, 1, p) || '.' || substr(d, p + 1) END
    END AS val
  FROM g5
), ra AS (
  SELECT DISTINCT res, 'host.name' AS key, 'host-' || CAST(res % 4 AS VARCHAR) AS val FROM pt
  UNION ALL
  SELECT DISTINCT res, 'service.name',
         CASE WHEN res % 5 = 1 THEN CAST(res % 2 AS VARCHAR)
              ELSE 'svc-' || CAST(res % 2 AS VARCHAR) END
  FROM pt WHERE res % 5 <> 0
  UNION ALL SELECT res, key, val FROM gtxt
), rt AS (
  SELECT res, string_agg(key || chr(2) || val, chr(1) ORDER BY key) AS rtext,
         string_agg(key || '=' || val, ',' ORDER BY key) AS rdisp
  FROM ra GROUP BY res
), np AS (
  SELECT pt.*, rt.rtext, rt.rdisp,
         CASE WHEN res % 5 IN (0, 1) THEN '' WHEN res % 5 = 2 THEN 'svc-a'
              ELSE 'svc-' || CAST(res % 2 AS VARCHAR) END AS service_name
  FROM pt JOIN rt USING (res)
)
"""

_ENRICHED = """
SELECT g.time_unix_nano, c.series_key, c.metric_name, c.service_name, c.point_attrs,
       c.metric_description, c.scope_version, g.pvalue AS value{extra}
FROM {facts} g LEFT JOIN cur c ON g.series_key = c.series_key AND g.dt = c.dt
"""


_ANY_JOIN = """
, anyd AS (
  SELECT * FROM (
    SELECT meta1.*, row_number() OVER (
      PARTITION BY series_key ORDER BY dt DESC, request_seq DESC, request_part DESC) AS rn3
    FROM meta1) WHERE rn3 = 1
)
SELECT g.time_unix_nano, a.series_key, g.pvalue AS value, a.metric_name, a.metric_description,
       a.scope_version, CAST(a.dt AS VARCHAR) AS meta_dt
FROM np2 g LEFT JOIN anyd a ON g.series_key = a.series_key
WHERE g.metric_type = '{kind}'"""


def _enriched(facts: str, extra: str = "") -> str:
    return _ENRICHED.format(facts=facts, extra=extra)


ORACLE_SQL: dict[str, str] = {
    "flatten_gauge_points": _BASE + """
SELECT series_key, metric_name, start_time_unix_nano, time_unix_nano,
       CAST(dt AS VARCHAR) AS dt, pvalue AS value, flags
FROM np2 WHERE metric_type = 'Gauge'""",

    "flatten_sum_points": _BASE + """
SELECT series_key, metric_name, start_time_unix_nano, time_unix_nano,
       CAST(dt AS VARCHAR) AS dt, pvalue AS value, flags, aggregation_temporality, is_monotonic
FROM np2 WHERE metric_type = 'Sum'""",

    "dropped_points_by_type": _BASE + """
SELECT metric_type,
       count(DISTINCT CAST(request_seq AS VARCHAR) || ':' || CAST(request_part AS VARCHAR)) AS requests,
       count(*) AS dropped_points
FROM pt WHERE metric_type = 'Histogram' GROUP BY metric_type""",

    "validation_errors": _FAULTY + """
SELECT request_seq, request_part, error FROM firsterr""",

    "accepted_rejected_counts": _FAULTY + """
SELECT CASE WHEN f.error IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
       count(*) AS requests, CAST(sum(r.g) AS BIGINT) AS gauge_points,
       CAST(sum(r.s) AS BIGINT) AS sum_points
FROM (SELECT request_seq, request_part,
             count(*) FILTER (WHERE metric_type = 'Gauge') AS g,
             count(*) FILTER (WHERE metric_type = 'Sum') AS s
      FROM pt GROUP BY request_seq, request_part) r
LEFT JOIN firsterr f USING (request_seq, request_part)
GROUP BY 1""",

    "service_names": _BASE + """
SELECT service_name, host_name, count(*) AS points FROM np2 GROUP BY service_name, host_name""",

    "attribute_text": _BASE + """
SELECT level, attr_key, attr_value, count(*) AS points FROM (
  SELECT 'resource' AS level, 'host.name' AS attr_key, host_name AS attr_value FROM np2
  UNION ALL SELECT 'resource', 'service.name', service_name FROM np2
  UNION ALL SELECT 'point', 'bucket', bucket FROM np2
  UNION ALL SELECT 'point', 'odd', odd FROM np2) a
GROUP BY level, attr_key, attr_value""",

    "point_values": _BASE + """
SELECT series_key, CAST(dt AS VARCHAR) AS dt, count(*) AS points,
       round(sum(pvalue), 6) AS sum_value, min(pvalue) AS min_value, max(pvalue) AS max_value
FROM np2 GROUP BY series_key, dt""",

    "series_keys": _BASE + """
SELECT metric_name, service_name, series_key, count(*) AS points, true AS hash_unique,
       CAST(max(length(canonical)) AS BIGINT) AS identity_bytes
FROM np2 GROUP BY metric_name, service_name, series_key""",

    "metadata_first_per_request": _BASE + """
SELECT request_seq, request_part, metric_type, series_key, CAST(dt AS VARCHAR) AS dt,
       metric_description, metric_unit, 'events' AS scope_name, scope_version, service_name
FROM meta1""",

    "series_current": _BASE + """
SELECT CAST(dt AS VARCHAR) AS dt, metric_name, series_key, metric_description, metric_unit,
       metric_type, service_name, 'events' AS scope_name, scope_version, resource_attrs,
       point_attrs, request_seq AS last_request_seq
FROM cur""",

    "series_listing": _BASE + """
SELECT metric_name, service_name, metric_type, point_attrs, CAST(dt AS VARCHAR) AS dt
FROM cur ORDER BY metric_name""",

    "series_count_by_name": _BASE + """
SELECT metric_name, count(*) AS merged_rows, count(DISTINCT series_key) AS distinct_series
FROM cur GROUP BY metric_name""",

    "host_attribute": _BASE + """
SELECT host_name, count(*) AS series_days, count(DISTINCT series_key) AS distinct_series
FROM cur GROUP BY host_name""",

    "gauge_range_enriched": _BASE + _enriched("np2") + f"""
WHERE g.metric_type = 'Gauge' AND g.time_unix_nano BETWEEN {GAUGE_RANGE[0]} AND {GAUGE_RANGE[1]}
ORDER BY g.time_unix_nano""",

    "sum_range_enriched": _BASE + _enriched("np2", ", g.aggregation_temporality, g.is_monotonic") + f"""
WHERE g.metric_type = 'Sum' AND g.time_unix_nano BETWEEN {SUM_RANGE[0]} AND {SUM_RANGE[1]}
ORDER BY g.time_unix_nano""",

    "gauge_any_join": _BASE + _ANY_JOIN.format(kind="Gauge"),

    "sum_any_join": _BASE + _ANY_JOIN.format(kind="Sum"),

    "latest_gauge_20": _BASE + _enriched(
        "(SELECT * FROM np2 WHERE metric_type = 'Gauge' ORDER BY time_unix_nano DESC LIMIT 20)")
        + "\nORDER BY g.time_unix_nano DESC",

    "latest_sum_20": _BASE + _enriched(
        "(SELECT * FROM np2 WHERE metric_type = 'Sum' ORDER BY time_unix_nano DESC LIMIT 20)")
        + "\nORDER BY g.time_unix_nano DESC",

    "series_point_lookup": _BASE + _enriched("np2") + """
WHERE g.metric_type = 'Gauge' AND g.metric_name = 'events.click' AND g.service_name = 'svc-0'
  AND g.host_name = 'host-0' AND g.bucket = '0' AND g.odd = 'false'""",

    "name_in_range": _BASE + _enriched("np2") + f"""
WHERE g.metric_type = 'Gauge' AND g.metric_name = '{NAME_FILTER}'
  AND g.time_unix_nano BETWEEN {NAME_RANGE[0]} AND {NAME_RANGE[1]}
ORDER BY g.time_unix_nano""",

    "orphan_points": _BASE + f"""
SELECT CAST(g.dt AS VARCHAR) AS dt, count(*) AS orphan_points
FROM np2 g
WHERE g.metric_type = 'Gauge' AND NOT EXISTS (
  SELECT 1 FROM meta1 m
  WHERE m.series_key = g.series_key AND m.dt = g.dt AND m.dt <> DATE '{ORPHAN_DAY}')
GROUP BY g.dt""",

    "received_counts": _BASE + """
SELECT request_seq, request_part,
       count(*) FILTER (WHERE metric_type = 'Gauge') AS gauge_points,
       count(*) FILTER (WHERE metric_type = 'Sum') AS sum_points,
       count(*) AS received
FROM np2 GROUP BY request_seq, request_part""",

    "write_audit_summary": _BASE + """
, w AS (
  SELECT 'metrics_gauge' AS tbl, count(*) AS n FROM np2 WHERE metric_type = 'Gauge'
  GROUP BY request_seq, request_part
  UNION ALL
  SELECT 'metrics_sum', count(*) FROM np2 WHERE metric_type = 'Sum'
  GROUP BY request_seq, request_part
  UNION ALL
  SELECT 'series_metadata', count(*) FROM meta1 GROUP BY request_seq, request_part, metric_type
)
SELECT tbl AS "table", 'ok' AS status, count(*) AS writes, CAST(sum(n) AS BIGINT) AS rows
FROM w GROUP BY tbl""",

    "table_row_counts": _BASE + """
SELECT 'metrics_gauge' AS "table", count(*) AS rows FROM np2 WHERE metric_type = 'Gauge'
UNION ALL SELECT 'metrics_sum', count(*) FROM np2 WHERE metric_type = 'Sum'
UNION ALL SELECT 'series_metadata', count(*) FROM meta1
UNION ALL SELECT 'series_current', count(*) FROM cur
UNION ALL SELECT 'rejected_requests', CAST(0 AS BIGINT)""",

    "retention_keep": _BASE + """
SELECT tbl AS "table", CASE WHEN dt >= DATE '2024-01-16' THEN 'kept' ELSE 'expired' END AS state,
       count(*) AS rows, count(DISTINCT dt) AS days
FROM (SELECT 'metrics_gauge' AS tbl, dt FROM np2 WHERE metric_type = 'Gauge'
      UNION ALL SELECT 'metrics_sum', dt FROM np2 WHERE metric_type = 'Sum'
      UNION ALL SELECT 'series_metadata', dt FROM meta1) t
GROUP BY 1, 2""",

    "no_recorded_value": _BASE + """
SELECT CASE WHEN metric_type = 'Gauge' THEN 'gauge' ELSE 'sum' END AS kind,
       count(*) AS points, count(*) FILTER (WHERE flags & 1 = 1) AS no_value_points
FROM np2 GROUP BY 1""",

    "filter_service": _BASE + """
SELECT metric_name, count(*) AS series_days FROM cur WHERE service_name = 'svc-1'
GROUP BY metric_name""",

    "filter_attr_key": _BASE + """
SELECT 'resource' AS level, 'host.name' AS attr_key, count(DISTINCT series_key) AS series FROM cur
UNION ALL SELECT 'scope', 'host.name', CAST(0 AS BIGINT)
UNION ALL SELECT 'point', 'odd', count(DISTINCT series_key) FROM cur""",

    "histogram_points": _BASE + f"""
SELECT md5({_CANON}) AS series_key, metric_name, time_unix_nano, CAST(dt AS VARCHAR) AS dt,
       CAST(1 AS BIGINT) AS count, value AS sum, CAST(2 AS BIGINT) AS aggregation_temporality
FROM pt WHERE metric_type = 'Histogram'""",

    "variety_series": _VARIETY + """
SELECT metric_name, service_name, rdisp AS resource_attrs,
       md5(metric_name || chr(0) || service_name || chr(0) || rtext || chr(0) || chr(0)
           || 'bucket' || chr(2) || bucket || chr(1) || 'odd' || chr(2) || odd) AS series_key,
       count(*) AS points
FROM np GROUP BY ALL""",

    "variety_attribute_text": _VARIETY + """
SELECT ra.key AS attr_key, ra.val AS attr_value, count(*) AS points
FROM pt JOIN ra USING (res) GROUP BY ra.key, ra.val""",

    "filter_attr_value": _BASE + """
SELECT CAST(dt AS VARCHAR) AS dt, metric_name, series_key FROM cur
WHERE odd = 'true' AND host_name = 'host-2'""",
}

# The stored-path queries answer the same questions as their lineage twins.
ORACLE_SQL["stored_gauge_range"] = ORACLE_SQL["gauge_range_enriched"]
ORACLE_SQL["stored_latest_gauge_20"] = ORACLE_SQL["latest_gauge_20"]
ORACLE_SQL["stored_series_current"] = ORACLE_SQL["series_current"]
ORACLE_SQL["stored_sum_range"] = ORACLE_SQL["sum_range_enriched"]
ORACLE_SQL["stored_reinsert"] = ORACLE_SQL["series_current"]
ORACLE_SQL["stored_sql_range"] = ORACLE_SQL["gauge_range_enriched"]

_ONE_SERIES = """g.metric_type = 'Gauge' AND g.metric_name = 'events.click' AND g.service_name = 'svc-0'
  AND g.host_name = 'host-0' AND g.bucket = '0' AND g.odd = 'false'"""
ORACLE_SQL["range_by_hash"] = _BASE + _enriched("np2") + f"""
WHERE {_ONE_SERIES} AND g.time_unix_nano BETWEEN {GAUGE_RANGE[0]} AND {GAUGE_RANGE[1]}"""
ORACLE_SQL["hash_only_points"] = _BASE + f"""
SELECT series_key, time_unix_nano, pvalue AS value FROM np2 g WHERE {_ONE_SERIES}"""

ORACLE_SQL["time_forms"] = _TIMES + """
SELECT request_seq, request_part, error FROM firsterr"""

ORACLE_SQL["rejected_bodies"] = _BASE + """
SELECT 'request body could not be decoded' AS outcome,
       count(DISTINCT (request_seq, request_part)) AS n FROM pt WHERE request_seq % 10 IN (3, 7)
UNION ALL SELECT 'gauge points', count(*) FROM np2 WHERE metric_type = 'Gauge' AND request_seq % 10 NOT IN (3, 7)
UNION ALL SELECT 'sum points', count(*) FROM np2 WHERE metric_type = 'Sum' AND request_seq % 10 NOT IN (3, 7)"""

ORACLE_SQL["ingest_audit_counts"] = _BASE + """
SELECT tbl AS "table", 'ok' AS status, CAST(1 AS BIGINT) AS writes, n AS rows, true AS timed FROM (
  SELECT 'received_points' AS tbl, count(*) AS n FROM np2
  UNION ALL SELECT 'dropped_points', count(*) FROM pt WHERE metric_type = 'Histogram'
  UNION ALL SELECT 'series_metadata', count(*) FROM cur
  UNION ALL SELECT 'metrics_gauge', count(*) FROM np2 WHERE metric_type = 'Gauge'
  UNION ALL SELECT 'metrics_sum', count(*) FROM np2 WHERE metric_type = 'Sum') a WHERE n > 0"""

ORACLE_SQL["expire_counts"] = _BASE + """
SELECT 'metrics_gauge' AS "table", count(*) AS rows FROM np2 WHERE metric_type = 'Gauge' AND dt >= DATE '2024-01-16'
UNION ALL SELECT 'metrics_sum', count(*) FROM np2 WHERE metric_type = 'Sum' AND dt >= DATE '2024-01-16'
UNION ALL SELECT 'series_metadata', count(*) FROM cur WHERE year(dt) * 100 + month(dt) >= 202401"""

ORACLE_SQL["compact_with_append"] = _BASE + """
SELECT 'metrics_gauge' AS "table", 3 * count(*) AS rows FROM np2 WHERE metric_type = 'Gauge'
UNION ALL SELECT 'metrics_sum', 3 * count(*) FROM np2 WHERE metric_type = 'Sum'
UNION ALL SELECT 'series_metadata', CAST(count(*) + count(*) AS BIGINT) FROM cur
UNION ALL SELECT 'series_current', count(*) FROM cur"""

ORACLE_SQL["stream_two_sources"] = _BASE + """
SELECT 'metrics_gauge' AS "table", count(*) + count(*) FILTER (WHERE request_seq % 2 = 0) AS rows
FROM np2 WHERE metric_type = 'Gauge'
UNION ALL SELECT 'metrics_sum', count(*) + count(*) FILTER (WHERE request_seq % 2 = 0)
FROM np2 WHERE metric_type = 'Sum'
UNION ALL SELECT 'series_current', count(*) FROM cur"""

ORACLE_SQL["stored_other_types"] = _BASE + f"""
SELECT CASE r_pos WHEN 1 THEN 'metrics_exponential_histogram' WHEN 2 THEN 'metrics_summary'
       ELSE 'metrics_histogram' END AS "table",
       md5({_CANON}) AS series_key, time_unix_nano, CAST(dt AS VARCHAR) AS dt, CAST(1 AS BIGINT) AS count, value AS sum,
       CASE r_pos WHEN 1 THEN '3,4,2,1,2,-1,7' WHEN 2 THEN '2' ELSE '1,0' END AS buckets,
       CASE r_pos WHEN 2 THEN value * 2 ELSE value END AS top,
       CASE r_pos WHEN 1 THEN CAST(0 AS DOUBLE) WHEN 2 THEN CAST(0.99 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS bound,
       CAST(CASE r_pos WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS BIGINT) AS temporality
FROM pt WHERE metric_type = 'Histogram'"""

ORACLE_SQL["compact_two_days_at_once"] = _BASE + """
SELECT CAST(dt AS VARCHAR) AS dt, 2 * count(*) AS points, round(2 * sum(pvalue), 3) AS total
FROM np2 WHERE metric_type = 'Gauge' GROUP BY dt"""

_COUNTED = """
SELECT 'metrics_gauge' AS "table", count(*) AS rows FROM np2 WHERE metric_type = 'Gauge'
UNION ALL SELECT 'metrics_sum', count(*) FROM np2 WHERE metric_type = 'Sum'"""
ORACLE_SQL["replayed_epoch"] = _BASE + _COUNTED + """
UNION ALL SELECT 'series_current', count(*) FROM cur
UNION ALL SELECT 'audit metrics_gauge', count(*) FROM np2 WHERE metric_type = 'Gauge'
UNION ALL SELECT 'audit metrics_sum', count(*) FROM np2 WHERE metric_type = 'Sum'
UNION ALL SELECT 'audit received_points', count(*) FROM np2
UNION ALL SELECT 'audit dropped_points', count(*) FROM pt WHERE metric_type = 'Histogram'"""

ORACLE_SQL["audit_other_types"] = _BASE + """
, kinds AS (
  SELECT CASE metric_type WHEN 'Gauge' THEN 'metrics_gauge' WHEN 'Sum' THEN 'metrics_sum' ELSE
           CASE r_pos WHEN 1 THEN 'metrics_exponential_histogram' WHEN 2 THEN 'metrics_summary' ELSE 'metrics_histogram' END
         END AS tbl, metric_type FROM pt)
SELECT batch_id, tbl AS "table", 'ok' AS status, n AS rows FROM (
  SELECT CAST(7 AS BIGINT) AS batch_id, tbl, count(*) AS n FROM kinds GROUP BY tbl
  UNION ALL SELECT 7, 'received_points', count(*) FROM kinds
  UNION ALL SELECT 8, tbl, count(*) FROM kinds WHERE metric_type IN ('Gauge', 'Sum') GROUP BY tbl
  UNION ALL SELECT 8, 'received_points', count(*) FROM kinds WHERE metric_type IN ('Gauge', 'Sum')
  UNION ALL SELECT 8, 'dropped_points', count(*) FROM kinds WHERE metric_type = 'Histogram') a WHERE n > 0"""

ORACLE_SQL["file_time_order"] = _BASE + """
SELECT CAST(dt AS VARCHAR) AS dt, count(*) AS points, CAST(0 AS BIGINT) AS overlapping_files
FROM np2 WHERE metric_type = 'Gauge' GROUP BY dt"""

ORACLE_SQL["stored_tables"] = _BASE + """
SELECT t."table", t.rows IS NOT NULL AS found, t.rows FROM (""" + _COUNTED + """
UNION ALL SELECT 'metrics_histogram', CAST(0 AS BIGINT)
UNION ALL SELECT 'series_metadata', count(*) FROM cur
UNION ALL SELECT 'series_current', count(*) FROM cur
UNION ALL SELECT 'metrics_other', NULL) t"""

ORACLE_SQL["stream_batches"] = _BASE + """
SELECT files AS files_a_batch, 6 // files AS batches, count(*) AS received,
       count(*) FILTER (WHERE metric_type = 'Gauge') AS gauge_points
FROM np2, (SELECT unnest([CAST(1 AS BIGINT), CAST(3 AS BIGINT)]) AS files) f GROUP BY files"""

# A point without a series reads as type defaults, whose identity text is four separators.
ORACLE_SQL["stored_view_unmatched"] = _BASE + f"""
SELECT g.time_unix_nano, coalesce(c.series_key, md5(chr(0) || chr(0) || chr(0) || chr(0))) AS series_key,
       coalesce(c.metric_name, '') AS metric_name, coalesce(c.service_name, '') AS service_name,
       coalesce(c.point_attrs, '') AS point_attrs, coalesce(c.metric_description, '') AS metric_description,
       coalesce(c.scope_version, '') AS scope_version, g.pvalue AS value
FROM np2 g LEFT JOIN cur c ON g.series_key = c.series_key AND g.dt = c.dt AND c.dt <> DATE '{ORPHAN_DAY}'
WHERE g.metric_type = 'Gauge' AND g.dt BETWEEN DATE '{ORPHAN_DAY}' AND DATE '{NEXT_DAY}'"""

# The hour that came again is the last one inserted of its series and day.
_LATE = "      ORDER BY request_seq DESC, request_part DESC) AS rn2"
assert _LATE in _BASE
ORACLE_SQL["stored_closed_days"] = ORACLE_SQL["series_current"].replace(
    _LATE, f"      ORDER BY request_seq = {AGAIN_HOUR} DESC, request_seq DESC, request_part DESC) AS rn2")
ORACLE_SQL["unnumbered_lines"] = "SELECT * EXCLUDE (last_request_seq) FROM (" + ORACLE_SQL["series_current"].replace(
    _LATE, "      ORDER BY request_seq DESC, request_part ASC) AS rn2") + ") t"

ORACLE_SQL["stored_points_by_attribute"] = _BASE + f"""
SELECT asked, CAST(dt AS VARCHAR) AS dt, count(*) AS points, round(sum(pvalue), 3) AS total
FROM np2, (SELECT unnest(['service', 'host', 'any key', 'key alone']) AS asked) a
WHERE metric_type = 'Gauge' AND time_unix_nano BETWEEN {NAME_RANGE[0]} AND {NAME_RANGE[1]}
  AND CASE asked WHEN 'service' THEN service_name = 'svc-1' WHEN 'host' THEN host_name = 'host-2'
      WHEN 'any key' THEN odd = 'true' ELSE true END
GROUP BY asked, dt"""
