"""Catalog tables (H1–H7) and the store handle.

Every table is an external Parquet table under a store root (a shared
folder), registered in the session catalog with ``CREATE TABLE IF NOT
EXISTS``. Facts are partitioned by ``dt``, the metadata by ``month``, the logs by
``day``, and each of these by the write generation (``gen``, see
``generations``); partitions are tracked by the catalog, so a range read lists
only the directories it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmart.operators.query import MAP_DIM_COLS
from metricmart.operators.retention import DEFAULT_RETENTION_DAYS, retained
from metricmart.plans.store import MetricTables
from metricmart.schemas import GENERATION, TABLES


# Distinct series that a file's bloom filter is sized for.
HASH_BLOOM_NDV = 100_000


def _ddl_columns(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


@dataclass
class MetricStore:
    spark: SparkSession
    root: str
    database: str = "default"
    retention_days: int = DEFAULT_RETENTION_DAYS

    def name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def table(self, table: str) -> DataFrame:
        """Scan one table through the catalog (partition pruning), without
        generations that a compaction has replaced but not dropped yet."""
        from metricmart.plans.generations import replaced

        rows = self.spark.table(self.name(table))
        hidden = replaced(self, table) if GENERATION in rows.columns else None
        return (rows if hidden is None else rows.where(~hidden)).drop(GENERATION)

    def current(self) -> DataFrame:
        """The merged metadata, without merging closed days again.

        A compacted month holds one row per day, name and hash. Days without a row in a
        later generation are closed and read as they are; only the others are merged."""
        from metricmart.operators.metadata import series_current
        from metricmart.plans.generations import partitions, replaced

        rows, hidden = self.spark.table(self.name("series_metadata")), replaced(self, "series_metadata")
        rows = rows if hidden is None else rows.where(~hidden)
        names = partitions(self, "series_metadata")
        merged = [s for s in names if s[GENERATION].startswith("c")]
        columns = ["dt", "metric_name", "metric_hash", *_MERGED]
        if not merged:
            return series_current(rows).select(*columns)
        is_merged = F.col(GENERATION).startswith("c")
        base, log = rows.where(is_merged), rows.where(~is_merged)
        if len(merged) == len(names):
            return base.select(*columns)
        days = log.select("month", "dt").distinct()     # a row a day
        closed = base.join(days, ["month", "dt"], "left_anti")
        touched = base.join(days, ["month", "dt"], "left_semi").unionByName(log)
        return closed.select(*columns).unionByName(series_current(touched).select(*columns))

    def tables(self, as_of=None) -> MetricTables:
        """The star schema; with ``as_of`` (a date) rows past the retention
        window are cut on read (a partition filter), so results are exact
        between expiry runs (H13)."""
        t = MetricTables(self.table("metrics_gauge"), self.table("metrics_sum"),
                         self.table("series_metadata"), self.table("rejected_requests"))
        if as_of is None:
            return t
        keep = lambda df: retained(df, as_of, self.retention_days)
        return MetricTables(keep(t.gauge), keep(t.sum), keep(t.metadata), t.rejected)

    def exists(self, table: str) -> bool:
        """A7."""
        return self.spark.catalog.tableExists(f"{self.database}.{table}")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bloom_options(ndv: int) -> dict[str, str]:
    """Parquet writer options of tables keyed by ``metric_hash``."""
    return {"parquet.bloom.filter.enabled#metric_hash": "true",
            "parquet.bloom.filter.expected.ndv#metric_hash": str(ndv)}


def ddl_statements(store: MetricStore, hash_bloom_ndv: int = HASH_BLOOM_NDV) -> list[str]:
    """H2–H7 (+ reject and audit logs). Tables keyed by ``metric_hash`` get a
    Parquet bloom filter on it when ``hash_bloom_ndv`` > 0: facts are sorted by
    time, so inside a day the hash min/max cannot skip row groups but the bloom
    filter can (series lookups, B12 / X8)."""
    out = []
    for table, (schema, parts) in TABLES.items():
        part = f" PARTITIONED BY ({', '.join([*parts, GENERATION])})"
        opts = ""
        if hash_bloom_ndv and "metric_hash" in schema.fieldNames():
            listed = ", ".join(f"'{k}' = '{v}'" for k, v in bloom_options(hash_bloom_ndv).items())
            opts = f" OPTIONS ({listed})"
        out.append(
            f"CREATE TABLE IF NOT EXISTS {store.name(table)} ({_ddl_columns(schema)}, {GENERATION} STRING) "
            f"USING parquet{opts}{part} LOCATION '{store.path(table)}' "
            f"TBLPROPERTIES ('retention_days' = '{store.retention_days}')")
    return out


_MERGED = ["metric_description", "metric_unit", "metric_type", "service_name",
           "resource_attributes", "scope_attributes", "attributes", "scope_name",
           "scope_version", "ord"]


def current_view_sql(store: MetricStore) -> str:
    """A5 / E2 for SQL users: ``series_current`` = the merged metadata (last
    inserted row per day, name and hash). ``month`` is a grouping column too
    (it follows from ``dt``), so month/dt filters on the view reach the scan."""
    payload = ", ".join(f"'{c}', {c}" for c in _MERGED)
    cols = ", ".join(f"m.{c} AS {c}" for c in _MERGED)
    return (f"CREATE OR REPLACE VIEW {store.name('series_current')} AS "
            f"SELECT dt, metric_name, metric_hash, {cols}, month FROM ("
            f"SELECT dt, month, metric_name, metric_hash, "
            f"max_by(named_struct({payload}), ord) AS m "
            f"FROM {store.name('series_metadata')} GROUP BY dt, month, metric_name, metric_hash)")


def enriched_view_sql(store: MetricStore, view: str, facts: str) -> str:
    """G5 / F3 for SQL users: a fact table with its series' merged metadata by
    (hash, day), and type defaults for a point without a series (S27), as ``enrich_by_day``.

    ``month`` is a column of the view and a key of its join: a predicate on it,
    beside one on ``dt``, reaches the metadata's partitions too."""
    def shown(c: str) -> str:
        if c in MAP_DIM_COLS:
            return f"coalesce(m.{c}, CAST(map() AS MAP<STRING, STRING>)) AS {c}"
        return f"coalesce(m.{c}, '') AS {c}"
    cols = ", ".join(shown(c) for c in ["metric_name", *_MERGED] if c != "ord")
    points = ", ".join(f.name for f in TABLES[facts][0].fields)
    return (f"CREATE OR REPLACE VIEW {store.name(view)} AS SELECT f.*, {cols} FROM "
            f"(SELECT {points}, year(dt) * 100 + month(dt) AS month FROM {store.name(facts)}) f "
            f"LEFT JOIN {store.name('series_current')} m "
            f"ON f.metric_hash = m.metric_hash AND f.dt = m.dt AND f.month = m.month")


def create_tables(spark: SparkSession, root: str, database: str = "default",
                  retention_days: int = DEFAULT_RETENTION_DAYS,
                  hash_bloom_ndv: int = HASH_BLOOM_NDV) -> MetricStore:
    """H1: create the six metric tables plus the reject and audit logs if absent.

    When a table is (re-)registered over existing data, its partitions are
    recovered from the folder layout once.
    """
    store = MetricStore(spark, root, database, retention_days)
    if database != "default":
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` "
                  f"LOCATION '{root.rstrip('/')}/_database'")
    for (table, (_, parts)), stmt in zip(TABLES.items(), ddl_statements(store, hash_bloom_ndv)):
        existed = store.exists(table)
        if existed:
            _check_location(store, table)
        spark.sql(stmt)
        if not existed and path_exists(spark, store.path(table)):
            spark.sql(f"ALTER TABLE {store.name(table)} RECOVER PARTITIONS")
    spark.sql(current_view_sql(store))
    spark.sql(enriched_view_sql(store, "gauge_enriched", "metrics_gauge"))
    spark.sql(enriched_view_sql(store, "sum_enriched", "metrics_sum"))
    return store


def _check_location(store: MetricStore, table: str) -> None:
    rows = store.spark.sql(f"DESCRIBE TABLE EXTENDED {store.name(table)}") \
        .where("col_name = 'Location'").collect()
    have = rows[0][1].rstrip("/") if rows else ""
    want = store.path(table)
    if not (have == want or have.endswith(":" + want) or have.endswith(want)):
        raise ValueError(f"{store.name(table)} already exists at {have}, not {want}; "
                         "use another database for another store root")


def latest_points_recent(store: MetricStore, kind: str = "gauge", n: int = 20):
    """G1/G2 on stored tables without a full scan.

    The newest day partitions (names from the catalog) that hold at least ``n``
    points, by their row counts, are all that the plan reads. A point's day is
    derived from its time, so every point of a newer day is later than every
    point of an older one and the answer equals the full top-k.
    """
    from metricmart.operators.query import latest_points
    from metricmart.plans.generations import partitions

    table = "metrics_gauge" if kind == "gauge" else "metrics_sum"
    days = sorted({s["dt"] for s in partitions(store, table)}, reverse=True)
    facts, meta = store.table(table), store.table("series_metadata")
    held, done, window = 0, 0, 1
    while done < len(days) and held < n:
        added = days[done:done + window]    # each day is counted once, by its files' footers
        held += facts.where(F.col("dt").between(F.lit(added[-1]).cast("date"), F.lit(added[0]).cast("date"))).count()
        done, window = done + window, 2 * window
    if not days:
        return latest_points(facts, meta, n)
    lo = days[min(done, len(days)) - 1]
    since = F.col("dt") >= F.lit(lo).cast("date")
    return latest_points(facts.where(since), meta.where((F.col("month") >= int(lo[:4] + lo[5:7])) & since), n)
