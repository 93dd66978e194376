"""Point-level scalars."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS_PER_DAY = 86_400_000_000_000
_TWO_64 = Decimal(2 ** 64)
_TWO_63 = Decimal(2 ** 63)


def unsigned_nanos(s: Column) -> Column:
    """OTLP fixed64 nanos (JSON string or number) -> BIGINT, wrapping values
    >= 2^63 like a uint64 -> int64 cast (S11). Missing -> 0; text outside
    unsigned 64 bits never gets here (validation rejects its request)."""
    d = s.try_cast("decimal(20,0)")
    wrapped = F.when(d >= F.lit(_TWO_63), d - F.lit(_TWO_64)).otherwise(d)
    return F.coalesce(wrapped.try_cast("bigint"), F.lit(0).cast("bigint"))


def floor_div(n: Column, k: int) -> Column:
    """Exact floor division of a BIGINT by a positive constant (integral `div`)."""
    return F.call_function("div", n - F.pmod(n, F.lit(k)), F.lit(k))


def nanos_to_timestamp(n: Column) -> Column:
    """Instant with microsecond precision (nanos stay the source of truth)."""
    return F.timestamp_micros(floor_div(n, 1000))


def nanos_to_date(n: Column) -> Column:
    """UTC day of a nanosecond instant, independent of the session time zone."""
    return F.date_from_unix_date(floor_div(n, NANOS_PER_DAY).cast("int"))


def point_value(p: Column) -> Column:
    """D5 (S10): asDouble as is, asInt cast to double, unset -> 0."""
    return F.coalesce(p["asDouble"], p["asInt"].try_cast("bigint").cast("double"),
                      F.lit(0.0).cast("double"))
