"""Session settings the engine relies on.

The engine's expressions do not depend on the session time zone or on the map
key policy (dates are computed from integer nanoseconds, attribute lists are
de-duplicated explicitly), but UTC keeps displayed timestamps honest.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings applied to sessions we build ourselves (tests, bench). On a cluster
# these belong in spark-defaults; the engine's results do not depend on them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # target size of shuffle partitions, hence of files written after REBALANCE
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    # Runtime size check for lookup joins: AQE turns a sort-merge join into a
    # broadcast join only when the measured dimension side is below this.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str = "local[*]", app: str = "metricmart",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults; used by tests and bench."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialised intermediates.

    Read from ``spark.checkpoint.dir`` (cluster setting). Only a single-process
    session (``local[...]``), where every folder is shared, may leave it unset
    and gets a scratch folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="metricmart-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")
