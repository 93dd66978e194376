"""Attribute handling (D1, D2, D3): OTLP key/value lists to text maps.

All expressions are native Spark SQL (higher-order functions over the nested
arrays), so they run in the JVM next to the scan; no Python per row. Each
``*_sql`` generator takes the SQL text of its input; the Column wrappers take
a column path such as ``"rm.resource.attributes"``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricmart.functions.text import go_float_sql, let_sql

# Fixed value: the resource attribute that names the service.
SERVICE_NAME_KEY = "service.name"
STRMAP_SQL = "MAP<STRING, STRING>"


def any_value_sql(v: str) -> str:
    """AnyValue -> text (D3, rule S9): null -> "", string as is, int as decimal,
    double as Go %g, bool true/false, bytes / array / kvlist as JSON debug
    text, empty value -> ""."""
    return (f"CASE WHEN {v} IS NULL THEN '' "
            f"WHEN {v}.stringValue IS NOT NULL THEN {v}.stringValue "
            f"WHEN {v}.intValue IS NOT NULL "
            f"THEN coalesce(CAST(try_cast({v}.intValue AS BIGINT) AS STRING), {v}.intValue) "
            f"WHEN {v}.doubleValue IS NOT NULL THEN {go_float_sql(f'{v}.doubleValue')} "
            f"WHEN {v}.boolValue IS NOT NULL THEN CASE WHEN {v}.boolValue THEN 'true' ELSE 'false' END "
            f"WHEN {v}.bytesValue IS NOT NULL OR {v}.arrayValue IS NOT NULL "
            f"OR {v}.kvlistValue IS NOT NULL THEN to_json(named_struct("
            f"'bytesValue', {v}.bytesValue, 'arrayValue', {v}.arrayValue, "
            f"'kvlistValue', {v}.kvlistValue)) "
            f"ELSE '' END")


def attribute_entries_sql(attrs: str) -> str:
    """KeyValue list -> array<struct<key, value>> keeping the LAST duplicate
    key (S7), independent of the session's map key policy; null -> empty."""
    lst = f"coalesce({attrs}, array())"
    keys = f"transform({lst}, ak -> coalesce(ak.key, ''))"
    # Only a list that does repeat a key is sorted by (key, place), so that the
    # last of each key is the one before a different key: n log n, not n^2.
    placed = (f"array_sort(transform({lst}, (ap, ai) -> "
              f"named_struct('k', coalesce(ap.key, ''), 'i', ai, 'e', ap)))")
    last = let_sql(placed, "asorted", "transform(filter(asorted, (ax, aj) -> aj = size(asorted) - 1 "
                                      "OR get(asorted, aj + 1).k <> ax.k), ay -> ay.e)")
    unique = f"CASE WHEN size(array_distinct({keys})) < size({lst}) THEN {last} ELSE {lst} END"
    return (f"transform({unique}, ae -> named_struct('key', coalesce(ae.key, ''), "
            f"'value', {any_value_sql('ae.value')}))")


def entries_text_sql(entries: str) -> str:
    """Canonical text of an attribute set (D7, S13): keys ascending bytewise,
    ``key\\x02value`` joined with ``\\x01``; empty and null are the same."""
    return (f"coalesce(array_join(transform(array_sort({entries}), "
            f"te -> concat(te.key, chr(2), te.value)), chr(1)), '')")


def entries_map_sql(entries: str) -> str:
    return f"coalesce(map_from_entries({entries}), CAST(map() AS {STRMAP_SQL}))"


def map_text_sql(m: str) -> str:
    return entries_text_sql(f"map_entries(coalesce({m}, CAST(map() AS {STRMAP_SQL})))")


def service_name_sql(attrs: str) -> str:
    """First ``service.name`` attribute as a string value (D1, S6); "" otherwise."""
    return (f"coalesce(get(filter(coalesce({attrs}, array()), sa -> sa.key = '{SERVICE_NAME_KEY}'), 0)"
            f".value.stringValue, '')")


def any_value_text(v: str) -> Column:
    return F.expr(any_value_sql(v))


def attribute_entries(attrs: str) -> Column:
    return F.expr(attribute_entries_sql(attrs))


def entries_text(entries: str) -> Column:
    return F.expr(entries_text_sql(entries))


def entries_to_map(entries: str) -> Column:
    return F.expr(entries_map_sql(entries))


def map_text(m: str) -> Column:
    return F.expr(map_text_sql(m))


def service_name(attrs: str) -> Column:
    return F.expr(service_name_sql(attrs))
