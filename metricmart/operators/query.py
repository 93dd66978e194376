"""Time-ranged reads, lookup joins and listings.

Design points for scale:

* The time range is the only mandatory filter (S30). Facts are partitioned by
  ``dt`` and the metadata by ``month``; a predicate on ``time_unix_nano`` alone
  prunes nothing, so every range read adds the ``dt`` (and ``month``) bounds.
  Bounds are inclusive at both ends (S29) and applied on nanoseconds.
* The lookup join is day-aligned (F3): facts join the merged metadata on
  (metric_hash, dt). Every point's day has its own metadata row, the range
  prunes both sides, and each fact row meets at most one dimension row (S26).
  No broadcast hint is forced on the dimension: Spark broadcasts it when its
  measured size is under the (adaptive) threshold and keeps a shuffled join
  otherwise.
* Latest-N runs the top-k before the join (TakeOrderedAndProject), once; only
  metadata of its <= k keys is merged.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmart.functions import nanos_to_timestamp
from metricmart.operators.flatten import META_COLS
from metricmart.operators.metadata import series_by_day, series_by_hash
from metricmart.schemas import STRMAP

_EPOCH = _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)
NANOS_PER_DAY = 86_400_000_000_000

STRING_DIM_COLS = ["metric_name", "metric_description", "metric_unit", "metric_type",
                   "service_name", "scope_name", "scope_version"]
MAP_DIM_COLS = ["resource_attributes", "scope_attributes", "attributes"]


def to_nanos(t) -> int:
    """Instant -> UTC nanoseconds. Accepts int nanos, datetime/date, or ISO text
    ('2024-01-05' = midnight UTC)."""
    if isinstance(t, int):
        return t
    if isinstance(t, str):
        t = _dt.datetime.fromisoformat(t)
    if isinstance(t, _dt.date) and not isinstance(t, _dt.datetime):
        t = _dt.datetime(t.year, t.month, t.day)
    if t.tzinfo is None:
        t = t.replace(tzinfo=_dt.timezone.utc)
    delta = t - _EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000_000 + delta.microseconds * 1000


def nanos_day(n: int) -> _dt.date:
    return (_EPOCH + _dt.timedelta(days=n // NANOS_PER_DAY)).date()


def _month_key(d: _dt.date) -> int:
    return d.year * 100 + d.month


def facts_in_range(facts: DataFrame, start, end) -> DataFrame:
    """Inclusive time range on a fact table, with partition bounds."""
    s, e = to_nanos(start), to_nanos(end)
    return facts.where(F.col("dt").between(F.lit(nanos_day(s)), F.lit(nanos_day(e)))
                       & F.col("time_unix_nano").between(F.lit(s), F.lit(e)))


def metadata_in_range(meta: DataFrame, start, end) -> DataFrame:
    """Metadata rows for the days a range touches (month partition + dt)."""
    ds, de = nanos_day(to_nanos(start)), nanos_day(to_nanos(end))
    return meta.where(F.col("month").between(F.lit(_month_key(ds)), F.lit(_month_key(de)))
                      & F.col("dt").between(F.lit(ds), F.lit(de)))


def _fill_defaults(df: DataFrame) -> DataFrame:
    """Unmatched lookup columns read as type defaults, not NULL."""
    empty = F.create_map().cast(STRMAP)
    cols = []
    for c in df.columns:
        if c in STRING_DIM_COLS:
            cols.append(F.coalesce(F.col(c), F.lit("")).alias(c))
        elif c in MAP_DIM_COLS:
            cols.append(F.coalesce(F.col(c), empty).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def _redealt(dim: DataFrame, keys: list[str]) -> DataFrame:
    """A merged dimension whose join has to deal it anew.

    An aggregation leaves its rows dealt by the keys; a join would reuse that,
    and then Spark cannot split a hot series on the facts' side (its skew-join
    rule wants both sides as plain shuffles). An expression that changes no
    value hides it, for one more shuffle of the small side."""
    return dim.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("bigint")) for k in keys})


def enrich_by_day(facts: DataFrame, meta: DataFrame) -> DataFrame:
    """day-aligned LEFT lookup, exactly one dimension row per fact at most."""
    dim = _redealt(series_by_day(meta).drop("ord"), ["metric_hash"])
    return _fill_defaults(facts.join(dim, ["metric_hash", "dt"], "left"))


def enrich_any(facts: DataFrame, meta: DataFrame) -> DataFrame:
    """LEFT ANY JOIN on the hash alone; the chosen row is the latest
    day's last-inserted one. Reads the whole dimension: prefer enrich_by_day."""
    dim = _redealt(series_by_hash(meta).drop("ord").withColumnRenamed("dt", "meta_dt"), ["metric_hash"])
    return _fill_defaults(facts.join(dim, "metric_hash", "left"))


def points_in_range(gauge_or_sum: DataFrame, meta: DataFrame, start, end, enrich: bool = True,
                    metric_name: str | None = None, metric_hash: int | Column | None = None,
                    order: bool = True) -> DataFrame:
    """G5 (+B13, B14, B15): points of one fact table in an inclusive range,
    optionally for one name or one series, enriched day-aligned, by time."""
    f = facts_in_range(gauge_or_sum, start, end)
    m = metadata_in_range(meta, start, end)
    if metric_hash is not None:
        h = metric_hash if isinstance(metric_hash, Column) else F.lit(metric_hash).cast("bigint")
        f = f.where(F.col("metric_hash") == h)
        m = m.where(F.col("metric_hash") == h)
    if metric_name is not None:
        m = m.where(F.col("metric_name") == metric_name)
        # the series of that name on those days: one inner join filters and enriches
        dim = _redealt(series_by_day(m).drop("ord"), ["metric_hash"])
        out = f.join(dim, ["metric_hash", "dt"])
        out = _fill_defaults(out) if enrich else out.select(*f.columns)
    else:
        out = enrich_by_day(f, m) if enrich else f
    return out.orderBy("time_unix_nano", "metric_hash") if order else out


def top_k(gauge_or_sum: DataFrame, n: int) -> DataFrame:
    """The n latest points (TakeOrderedAndProject), without the derived ``ts``."""
    return (gauge_or_sum.select(*[c for c in gauge_or_sum.columns if c != "ts"])
            .orderBy(F.col("time_unix_nano").desc(), F.col("metric_hash")).limit(n))


def latest_points(gauge_or_sum: DataFrame, meta: DataFrame, n: int = 20) -> DataFrame:
    """Latest n points (time desc, hash as tie-break), enriched.

    One plan, nothing runs while it is built. The top-k's n rows, numbered, meet the
    unmerged metadata of their series (adaptive execution broadcasts them by their
    measured size), and each keeps its last inserted row; a union with the bare
    points keeps those without metadata. Both uses of the top-k take all its columns
    behind the same exchange, so it runs once and the facts are scanned once.
    """
    number = F.row_number().over(Window.orderBy(F.col("time_unix_nano").desc(), F.col("metric_hash")))
    top = top_k(gauge_or_sum, n).withColumn("latest_rank", number).repartition(1)
    dims = [c for c in META_COLS if c in meta.columns]
    payload = F.struct(*[F.col(c) for c in dims])
    # null-safe keys: a filter on them would make this use of the top-k differ from the other
    same = F.col("f.metric_hash").eqNullSafe(F.col("d.metric_hash")) & F.col("f.dt").eqNullSafe(F.col("d.dt"))
    found = meta.withColumns({"m": payload, "o": F.col("ord")}).select("metric_hash", "dt", "m", "o").alias("d") \
        .join(top.alias("f"), same).select("f.*", "d.m", F.col("d.o").alias("ord"))
    kinds = {f.name: f.dataType for f in found.schema.fields}
    bare = top.select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("m", "ord")])
    last = found.unionByName(bare).groupBy(*top.columns).agg(F.max_by("m", "ord").alias("m"))
    out = last.withColumn("ts", nanos_to_timestamp(F.col("time_unix_nano")))
    return (_fill_defaults(out.select(*gauge_or_sum.columns, *[F.col("m")[c].alias(c) for c in dims]))
            .orderBy(F.col("time_unix_nano").desc(), F.col("metric_hash")))


def series_points(gauge_or_sum: DataFrame, meta: DataFrame, metric_hash: int | Column,
                  start=None, end=None) -> DataFrame:
    """Two-step lookup — the series' points (hash filter pushed to the
    scan), then its metadata."""
    h = metric_hash if isinstance(metric_hash, Column) else F.lit(metric_hash).cast("bigint")
    f = gauge_or_sum.where(F.col("metric_hash") == h)
    m = meta.where(F.col("metric_hash") == h)
    if start is not None:
        f = facts_in_range(f, start, end)
        m = metadata_in_range(m, start, end)
    return enrich_by_day(f, m)


def orphan_points(gauge_or_sum: DataFrame, meta: DataFrame) -> DataFrame:
    """facts whose (hash, day) has no metadata row — must be empty when the
    metadata-first write order held."""
    return gauge_or_sum.join(meta.select("metric_hash", "dt"), ["metric_hash", "dt"], "left_anti")


def series_listing(current: DataFrame) -> DataFrame:
    """Merged series, sorted by name."""
    return current.select("dt", "metric_name", "service_name", "metric_type", "attributes",
                          "metric_hash").orderBy("metric_name", "dt", "metric_hash")


def map_value(m: Column, key: str) -> Column:
    """One element of an attribute map ("" when absent)."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(""))
