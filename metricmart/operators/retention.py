"""Retention.

Both facts and metadata expire on ``dt < today - retention_days`` (a
deliberate alignment: in the reference the metadata of the last day expires a
day before its facts). Expiry drops whole day partitions (H14); readers also
apply the same predicate so results are exact between expiry runs.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RETENTION_DAYS = 90


def cutoff_date(today, retention_days: int = DEFAULT_RETENTION_DAYS) -> _dt.date:
    if isinstance(today, str):
        today = _dt.date.fromisoformat(today)
    if isinstance(today, _dt.datetime):
        today = today.date()
    return today - _dt.timedelta(days=retention_days)


def retained(df: DataFrame, today, retention_days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    """Rows still inside the retention window (partition filter on dt)."""
    return df.where(F.col("dt") >= F.lit(cutoff_date(today, retention_days)))


def expired_flag(today, retention_days: int = DEFAULT_RETENTION_DAYS) -> Column:
    return F.col("dt") < F.lit(cutoff_date(today, retention_days))
