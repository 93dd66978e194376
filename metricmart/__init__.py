"""metricmart: OpenTelemetry metrics ingest and query on Spark.

Export requests (nested, one row each) are validated, flattened into gauge and
sum points, keyed by a deterministic 64-bit series hash and stored as slim,
day-partitioned fact tables beside a series dimension that is merged on read.
Every step is a DataFrame / Spark SQL expression.
"""

from metricmart.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
