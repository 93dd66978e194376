"""Series identity (D7, D8): canonical text and the 64-bit series hash.

identity text = name \\x00 service \\x00 res \\x00 scope \\x00 point-attrs, each
map as sorted ``key\\x02value`` pairs joined with ``\\x01`` (rule S13); the
hash is xxHash64 with seed 0 over its UTF-8 bytes (S14).

Spark's ``xxhash64`` starts from seed 42 and chains each argument's result
into the next one's seed. The BIGINT literal below hashes (seed 42) to exactly
0, so placing it first makes the canonical string hash with seed 0 — the key
is computed natively, with no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricmart.functions.attributes import map_text_sql

# Fixed value: xxhash64(seed=42) of this BIGINT is 0.
SEED_ZERO_PREFIX = -365884300664092260

FIELD_SEP = "\x00"


def identity_text(name: Column, service: Column, res_text: Column, scope_text: Column,
                  attr_text: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (name, service, res_text, scope_text, attr_text)]
    return F.concat_ws(FIELD_SEP, *parts)


def metric_hash(canonical: Column) -> Column:
    """Signed BIGINT with the same 64 bits as the unsigned xxHash64 (seed 0)."""
    return F.xxhash64(F.lit(SEED_ZERO_PREFIX).cast("bigint"), F.coalesce(canonical, F.lit("")))


def identity_text_from_maps(name: str, service: str, res: str, scope: str, attrs: str) -> Column:
    """Identity text rebuilt from stored columns (names / SQL expressions)."""
    return F.expr(f"concat_ws(chr(0), coalesce({name}, ''), coalesce({service}, ''), "
                  f"{map_text_sql(res)}, {map_text_sql(scope)}, {map_text_sql(attrs)})")


def series_key(canonical: Column) -> Column:
    """md5 hex of the identity text: an engine-neutral key for cross-checks."""
    return F.md5(F.coalesce(canonical, F.lit("")))


def unsigned_hash_text(h: Column) -> Column:
    """Unsigned decimal display of a BIGINT hash."""
    return F.conv(F.hex(h), 16, 10)
