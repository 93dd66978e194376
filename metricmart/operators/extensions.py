"""Proposals the reference describes but does not build.

Off by default; each is a plain predicate or projection. On stored tables X5–X7 have a
skip structure, the attribute table: one row per attribute of a series and day, sorted
by (level, key, value). A lookup reads the few row groups that may hold its value and
reaches the facts by a semi join on (hash, day), whose days prune the facts' partitions
at run time. Attributes are part of a series' identity, so the table never changes for
a series, however often its metadata is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmart.operators.query import facts_in_range, metadata_in_range

# Fixed value: OTLP DATA_POINT_FLAGS_NO_RECORDED_VALUE_MASK.
NO_RECORDED_VALUE = 1

MAPS = {"resource": "resource_attributes", "scope": "scope_attributes", "point": "attributes"}


def null_unrecorded(facts: DataFrame) -> DataFrame:
    """Value is NULL when the no-recorded-value flag bit is set."""
    flagged = F.col("flags").bitwiseAND(F.lit(NO_RECORDED_VALUE)) == NO_RECORDED_VALUE
    return facts.withColumn("value", F.when(flagged, F.lit(None).cast("double"))
                            .otherwise(F.col("value")))


def by_service(meta: DataFrame, service: str) -> DataFrame:
    """X5."""
    return meta.where(F.col("service_name") == service)


def with_attribute_key(meta: DataFrame, key: str, where: str = "point") -> DataFrame:
    """Series whose resource / scope / point attributes contain ``key``."""
    return meta.where(F.map_contains_key(F.col(MAPS[where]), F.lit(key)))


def with_attribute_value(meta: DataFrame, key: str | None, value: str,
                         where: str = "point") -> DataFrame:
    """Attribute equals ``value`` (under ``key``, or under any key)."""
    m = F.col(MAPS[where])
    if key is None:
        return meta.where(F.array_contains(F.map_values(m), F.lit(value)))
    return meta.where(F.try_element_at(m, F.lit(key)) == F.lit(value))


def attribute_rows(meta: DataFrame) -> DataFrame:
    """Rows of the attribute table for rows of metadata."""
    def pairs(level: str, m: Column) -> Column:
        return F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(
            F.lit(level).alias("level"), e["key"].alias("attr_key"), e["value"].alias("attr_value")))
    service = F.array(F.struct(F.lit("service").alias("level"), F.lit("").alias("attr_key"), F.col("service_name").alias("attr_value")))
    every = F.concat(service, *[pairs(level, F.col(c)) for level, c in MAPS.items()])
    return meta.select(F.explode(every).alias("a"), "dt", "metric_hash", "month").select("a.*", "dt", "metric_hash", "month")


def points_with_attribute(facts: DataFrame, index: DataFrame, start, end, level: str = "point",
                          key: str | None = None, value: str | None = None) -> DataFrame:
    """X5–X7 on stored points: those of an inclusive range whose series have the attribute.

    ``index`` is the attribute table; ``key`` and ``value`` may each be left out (any key, any value)."""
    series = metadata_in_range(index, start, end).where(F.col("level") == level)
    if key is not None:
        series = series.where(F.col("attr_key") == key)
    if value is not None:
        series = series.where(F.col("attr_value") == value)
    return facts_in_range(facts, start, end).join(series.select("metric_hash", "dt"), ["metric_hash", "dt"], "left_semi")


def by_hash(facts_or_meta: DataFrame, metric_hash: int | Column) -> DataFrame:
    """Hash-only lookup without a time range (reads every partition; the
    Parquet min/max statistics and optional bloom filter skip row groups)."""
    h = metric_hash if isinstance(metric_hash, Column) else F.lit(metric_hash).cast("bigint")
    return facts_or_meta.where(F.col("metric_hash") == h)
