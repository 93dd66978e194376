"""Series metadata: keep-first per request (E1) and merge-on-read.

* E1 — within one request and one metric type, one row per (hash, UTC day),
  taken from the FIRST point (S15). A ``min_by`` aggregation: the points of a
  request sit in the task that exploded it, so the partial (map-side)
  aggregation already leaves one row per key and only those rows shuffle.
* E2 — across requests, one row per (day, name, hash) holding the LAST
  inserted values (S16). The insertion order is the ``ord`` struct (batch,
  request, type rank, positions). Every insert writes all columns (S17), so
  last-per-column equals last row: one ``max_by`` over a struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.operators.flatten import META_COLS, ORD_COLS, REQUEST


def _month(dt):
    return (F.year(dt) * 100 + F.month(dt)).cast("int")


def metadata_rows(points: DataFrame) -> DataFrame:
    """Rows to append to ``series_metadata`` for one batch of points."""
    ord_ = F.struct(*[F.col(c) for c in ORD_COLS])
    payload = F.struct(*[F.col(c) for c in META_COLS], ord_.alias("ord"))
    first = (points
             .groupBy(*REQUEST, "metric_type", "metric_hash", "dt")
             .agg(F.min_by(payload, ord_).alias("m")))
    return first.select("dt", "metric_hash", *[F.col("m")[c].alias(c) for c in META_COLS],
                        F.col("m.ord").alias("ord"), _month(F.col("dt")).alias("month"))


def batch_metadata(points: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda winners: winners) -> DataFrame:
    """E1 and E2 of one batch of stored points: one row per (dt, metric_name, metric_hash).

    The winner of each series and day is found on narrow rows: the first position in each
    request (positions packed into one decimal, so it is a hash aggregation), and of these
    the last in insertion order. Only winners then meet their wide columns, by a join on
    their positions, which name one point each. ``keep`` may write the winners and read them
    back: the join then knows their size, and few winners leave the points unshuffled."""
    # nine digits a position, the outermost first (no request has room for more)
    packed = F.expr(" + ".join(f"cast({c} AS decimal(9,0)) * 1{'0' * 9 * i}BD" for i, c in enumerate(("p_pos", "m_pos", "s_pos", "r_pos"))))
    first = points.groupBy(*REQUEST, "type_rank", "metric_name", "metric_hash", "dt").agg(
        F.min(packed.cast("decimal(38,0)")).alias("at"))
    last = first.groupBy("dt", "metric_name", "metric_hash").agg(
        F.max(F.struct(*REQUEST, "type_rank", "at")).alias("w")).select("w.*")
    # a type's points of one request have positions of their own, so these keys name one point
    found = points.withColumn("at", packed.cast("decimal(38,0)")).join(keep(last), [*REQUEST, "type_rank", "at"])
    return found.select("dt", "metric_hash", *META_COLS, F.struct(*[F.col(c) for c in ORD_COLS]).alias("ord"),
                        _month(F.col("dt")).alias("month"))


def _last(meta: DataFrame, keys: list[str], order) -> DataFrame:
    payload = F.struct(*[F.col(c) for c in META_COLS if c not in keys], F.col("ord"))
    merged = meta.groupBy(*keys).agg(F.max_by(payload, order).alias("m"))
    rest = [c for c in META_COLS if c not in keys]
    return merged.select(*keys, *[F.col("m")[c].alias(c) for c in rest], F.col("m.ord").alias("ord"))


def series_current(meta: DataFrame) -> DataFrame:
    """The merged (FINAL) view — one row per (dt, metric_name, metric_hash)."""
    return _last(meta, ["dt", "metric_name", "metric_hash"], F.col("ord"))


def series_by_day(meta: DataFrame) -> DataFrame:
    """Join side of the day-aligned lookup (F3): exactly one row per (metric_hash, dt)."""
    return _last(meta, ["dt", "metric_hash"], F.col("ord"))


def series_by_hash(meta: DataFrame) -> DataFrame:
    """Join side of LEFT ANY JOIN on hash (F1): one row per hash — the latest day's
    last-inserted row."""
    payload = F.struct(*[F.col(c) for c in META_COLS], F.col("dt"), F.col("ord"))
    merged = meta.groupBy("metric_hash").agg(
        F.max_by(payload, F.struct(F.col("dt"), F.col("ord"))).alias("m"))
    return merged.select("metric_hash", *[F.col("m")[c].alias(c) for c in META_COLS],
                         F.col("m.dt").alias("dt"), F.col("m.ord").alias("ord"))
