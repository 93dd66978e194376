"""Export request sources (A1, A2, A3).

Requests arrive as OTLP/JSON documents (one per line) or nested Parquet, one
row per request. The schema is always explicit; nothing is inferred.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from metricmart.schemas import EXPORT_BODY, EXPORT_REQUEST


# Fixed value: the rejection message for a body that is no export request.
MSG_UNDECODABLE = "request body could not be decoded"
_CORRUPT = "_corrupt_record"
# Schema for JSON readers: Spark puts the text of an undecodable line into the last column.
_JSON_REQUEST = StructType([*EXPORT_REQUEST.fields, StructField(_CORRUPT, StringType(), True)])
_JSON_BODY = StructType([*EXPORT_BODY.fields, StructField(_CORRUPT, StringType(), True)])


def _decode_error(undecodable: Column) -> Column:
    return F.when(undecodable, F.lit(MSG_UNDECODABLE)).alias("decode_error")


# When a file arrived: orders requests that carry no arrival number.
def _received_at() -> Column:
    return F.col("_metadata.file_modification_time").alias("received_at")


# Where a line stands in its file: the start of the block that a task reads (in steps of 4 KiB),
# then the task's own count of lines.
_ROW_BITS = 33


def _block_order() -> Column:
    return F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 12), _ROW_BITS)


def _row_in_task() -> Column:
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))


def in_line_order(batch: DataFrame) -> DataFrame:
    """A micro-batch of a line stream with ``line_order``; Spark counts rows in batches only."""
    if "block_order" not in batch.columns:
        return batch
    return batch.withColumn("line_order", F.col("block_order") + _row_in_task()).drop("block_order")


def _row_order() -> Column:
    return F.col("_metadata.row_index").alias("line_order")


def _decoded(lines: DataFrame) -> DataFrame:
    """JSON rows with ``decode_error`` set where the line is no export request."""
    return lines.select(*EXPORT_REQUEST.fieldNames(), _received_at(), _block_order().alias("block_order"),
                        _decode_error(F.col(_CORRUPT).isNotNull()))


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A1: batch read of stored requests (JSON lines or nested Parquet). A line
    that does not decode stays a row and is rejected by validation."""
    if fmt == "json":
        return in_line_order(_decoded(spark.read.schema(_JSON_REQUEST).option("mode", "PERMISSIVE")
                                      .option("columnNameOfCorruptRecord", _CORRUPT).json(path)))
    return spark.read.schema(EXPORT_REQUEST).format(fmt).load(path).select("*", _received_at(), _row_order())


def read_request_stream(spark: SparkSession, path: str, fmt: str = "json",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """A2: continuous read of request files dropped into a folder."""
    reader = spark.readStream.schema(_JSON_REQUEST if fmt == "json" else EXPORT_REQUEST).format(fmt)
    if fmt == "json":
        reader = reader.option("columnNameOfCorruptRecord", _CORRUPT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(path)
    return _decoded(lines) if fmt == "json" else lines.select("*", _received_at(), _row_order())


def read_kafka_requests(spark: SparkSession, bootstrap_servers: str, topic: str,
                        starting_offsets: str = "earliest") -> DataFrame:
    """A2 (Kafka variant): OTLP/JSON request bodies from a Kafka topic.

    Needs the Spark Kafka connector on the classpath (not bundled with
    PySpark). Arrival order is the records' timestamps, then (offset, partition), so
    requests of several partitions are ordered by their arrival too.
    """
    raw = (spark.readStream.format("kafka")
           .option("kafka.bootstrap.servers", bootstrap_servers)
           .option("subscribe", topic).option("startingOffsets", starting_offsets).load())
    return parse_requests(raw, "value", received_at="timestamp", line_order=F.col("offset") * F.lit(1 << 16) + F.col("partition"))


def parse_requests(df: DataFrame, body: str | Column = "value",
                   seq: str | Column | None = None, received_at: str | Column | None = None,
                   line_order: str | Column | None = None) -> DataFrame:
    """A3: decode request bodies carried as JSON text (e.g. a Kafka ``value``).

    ``seq`` orders requests for "last wins"; without it ``received_at`` (a timestamp)
    and ``line_order`` do, where they are given.
    """
    body_col = F.col(body) if isinstance(body, str) else body
    seq_col = (F.col(seq) if isinstance(seq, str) else seq) if seq is not None \
        else F.lit(None).cast("bigint")
    known = [(F.col(c) if isinstance(c, str) else c).alias(name)
             for name, c in (("received_at", received_at), ("line_order", line_order)) if c is not None]
    text = body_col.cast("string")
    parsed = F.from_json(text, _JSON_BODY, {"columnNameOfCorruptRecord": _CORRUPT})
    return df.select(seq_col.cast("bigint").alias("request_seq"),
                     F.lit(0).cast("bigint").alias("request_part"),
                     parsed["resourceMetrics"].alias("resourceMetrics"), *known,
                     _decode_error(text.isNull() | parsed.isNull() | parsed[_CORRUPT].isNotNull()))


def requests_from_json(spark: SparkSession, docs: Iterable[dict]) -> DataFrame:
    """Small in-memory requests (tests, examples): each dict is one request."""
    lines = [json.dumps(d) for d in docs]
    return spark.createDataFrame([(x,) for x in lines], "value string").select(
        F.from_json("value", EXPORT_REQUEST).alias("r")).select("r.*")


def write_requests(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)


def write_ordered_requests(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Sorted requests as files of one task each, that arrived a second apart in the order of the sort.

    Readers order requests without arrival numbers by their file's arrival, then by their
    line, so this is the order of one file that holds them all, which no task has to write."""
    write_requests(df, path, fmt)
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def files():    # Spark numbers them by the partition, with five digits or more
        parts = [f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
        return sorted(parts, key=lambda f: int(f.getPath().getName().split("-")[1]))
    found = files()
    last = max((f.getModificationTime() for f in found), default=0) // 1000 * 1000
    for i, f in enumerate(reversed(found)):
        fs.setTimes(f.getPath(), last - 1000 * i, -1)
    times = [f.getModificationTime() for f in files()]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise OSError(f"{path} does not keep the arrival times of its files")
