"""Ingest statistics and counts.

The reference keeps these as process counters; here they are DataFrames over
the points of a batch or over the stored tables, so they scale with the data
and survive restarts. All are plain (two-phase) aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.operators.flatten import GAUGE, SUM


def received_counts(points: DataFrame) -> DataFrame:
    """Gauge and sum points per request, and their total."""
    return (points.groupBy("request_seq", "request_part")
            .agg(F.count_if(F.col("metric_type") == GAUGE).alias("gauge_points"),
                 F.count_if(F.col("metric_type") == SUM).alias("sum_points"))
            .withColumn("received", F.col("gauge_points") + F.col("sum_points")))


def observe_received(points: DataFrame, name: str = "ingest") -> DataFrame:
    """E6 as a streaming-friendly metric: Dataset.observe counts rows as they flow."""
    return points.observe(name, F.count(F.lit(1)).alias("received"),
                          F.count_if(F.col("metric_type") == GAUGE).alias("gauge"),
                          F.count_if(F.col("metric_type") == SUM).alias("sum"))


def write_plan_audit(points: DataFrame, metadata: DataFrame) -> DataFrame:
    """E8 (deterministic form): writes and rows per target table, as the
    reference performs them — per request, one metadata + one fact insert for
    each metric type that has points (empty writes skipped, B10)."""
    per_req = received_counts(points)
    fact = per_req.select(
        F.explode(F.array(
            F.struct(F.lit("metrics_gauge").alias("table"), F.col("gauge_points").alias("rows")),
            F.struct(F.lit("metrics_sum").alias("table"), F.col("sum_points").alias("rows")))
        ).alias("w")).select("w.*").where(F.col("rows") > 0)
    meta = (metadata.groupBy("ord.request_seq", "ord.request_part", "metric_type")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit("series_metadata").alias("table"), "rows"))
    return (fact.unionByName(meta).groupBy("table")
            .agg(F.count(F.lit(1)).alias("writes"), F.sum("rows").alias("rows"))
            .select("table", F.lit("ok").alias("status"), "writes", "rows"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """E8/E9 over the stored ``ingest_audit`` log: writes by (table, status) and
    the duration distribution by table."""
    return (audit.groupBy("table", "status")
            .agg(F.count(F.lit(1)).alias("writes"), F.sum("rows").alias("rows"),
                 F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
                 F.sum("duration_ms").alias("sum_ms"),
                 F.percentile_approx("duration_ms", [0.5, 0.95, 0.99]).alias("p50_p95_p99_ms")))


def series_count_by_name(current: DataFrame) -> DataFrame:
    """Merged rows and distinct series per metric name."""
    return current.groupBy("metric_name").agg(
        F.count(F.lit(1)).alias("merged_rows"),
        F.countDistinct("metric_hash").alias("distinct_series"))


def table_row_counts(**tables: DataFrame) -> DataFrame:
    """Raw row count per table (one small job, union of counts)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
