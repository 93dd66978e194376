"""The star schema as DataFrames: from stored tables or straight from requests.

``MetricTables`` bundles the gauge and sum facts, the raw (unmerged) series
metadata and the rejected requests. ``from_requests`` builds them as lineage
(validate -> flatten -> keep-first), which is what a batch job writes;
``load`` reads what ingest wrote, with explicit schemas and partition columns
so range filters prune directories.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from metricmart.operators.flatten import flatten_points, gauge_rows, sum_rows
from metricmart.operators.metadata import metadata_rows, series_current
from metricmart.operators.validate import split_valid
from metricmart.schemas import GENERATION, TABLES


@dataclass
class MetricTables:
    gauge: DataFrame
    sum: DataFrame
    metadata: DataFrame
    rejected: DataFrame | None = None
    points: DataFrame | None = None

    def facts(self, kind: str) -> DataFrame:
        return self.gauge if kind == "gauge" else self.sum

    def current(self) -> DataFrame:
        """A5: the merged metadata view (FINAL)."""
        return series_current(self.metadata)

    @classmethod
    def from_requests(cls, requests: DataFrame, batch_id: int = 0) -> "MetricTables":
        accepted, rejected = split_valid(requests)
        pts = flatten_points(accepted, batch_id)
        return cls(gauge_rows(pts), sum_rows(pts), metadata_rows(pts), rejected, pts)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> "MetricTables":
        return cls(read_table(spark, root, "metrics_gauge"), read_table(spark, root, "metrics_sum"),
                   read_table(spark, root, "series_metadata"),
                   read_table(spark, root, "rejected_requests"))


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan one stored table with its declared schema (no inference)."""
    schema, _ = TABLES[name]
    return spark.read.schema(StructType(schema.fields).add(GENERATION, "string")).parquet(table_path(root, name)).drop(GENERATION)
