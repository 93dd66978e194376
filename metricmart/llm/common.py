"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmart.session import checkpoint_root

#: Texts are handed to numpy in runs of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder``; False for a NULL id."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The lineage ends at the files, so a lost executor costs a re-read, and the
    scan has no partitioning of its own, which lets AQE split skewed joins."""
    return materialise_at(df, scratch_path(df.sparkSession, what))


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{checkpoint_root(spark)}/metricmart-llm/{what}-{uuid.uuid4().hex}"


def materialise_at(df: DataFrame, path: str) -> DataFrame:
    """``materialise`` at a ``scratch_path``, for files that go (``discard``) once what was made of them is written."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL counts as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def runs(batch: pa.RecordBatch, column: str, limit: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes (at least one row each)."""
    start, size = 0, 0
    lengths = pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def fresh_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
