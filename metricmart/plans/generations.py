"""Write generations: how batches and compactions share a table.

Every table's second partition column is ``gen``. A batch writes sub-partitions
of its own generation, ``b<batch id>``, by dynamic overwrite, and then adds them
to the catalog in one call. A write that is repeated (a replayed epoch, a batch
that failed inside a commit) replaces its own sub-partitions and no others, so
it lands once however often and wherever it stopped.

A compaction of one partition (a fact day, a metadata month, a log day) merges
the generations that it finds into one of its own, ``c<run>``. It notes beside
the table which generations that one replaces, adds it to the catalog (from then
on readers see it, and ``MetricStore.table`` hides the replaced ones), and drops
the replaced ones. A run that stopped before it added its generation has changed
nothing; one that stopped later is completed by the next maintenance of the
table. Generations written meanwhile are not in the note and stay.

A lease, a file that only one creator gets, keeps two runs off one partition;
a run that died holds it until it expires. Maintenance never touches what
belongs to a run whose lease is live. The epoch that a stream may still replay
is never compacted, as its replay could not replace its rows any more.

Limits: a DataFrame made before a compaction added its generation, and first run
before that compaction dropped the old ones, would list both; one that has listed
the old files may find them gone and fail, and is right when run again. SQL views
read the catalog alone and share the first limit at any time.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from metricmart.plans.catalog import MetricStore, delete_path
from metricmart.schemas import GENERATION, TABLES

#: A run that has not ended after so many seconds has died.
LEASE_SECONDS = 6 * 3600


class PartitionBusy(RuntimeError):
    """Another maintenance run holds the partition's lease."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; False if it does."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        return False
    try:
        out = fs.create(p, False)
    except Exception:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, src = _fs(spark, old)
    dst = _fs(spark, new)[1]
    fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise OSError(f"{old} could not be renamed to {new}")


# ---------------------------------------------------------------- partitions
def batch_generation(batch_id: int) -> str:
    return f"b{batch_id}"


def partitions(store: MetricStore, table: str) -> list[dict]:
    """The catalog's partitions, names only."""
    rows = store.spark.sql(f"SHOW PARTITIONS {store.name(table)}").collect()
    return [dict(kv.split("=", 1) for kv in r[0].split("/")) for r in rows]


def _spec(s: dict) -> str:
    return "PARTITION (" + ", ".join(f"{k} = '{v}'" for k, v in s.items()) + ")"


def add_partitions(store: MetricStore, table: str, specs: list[dict]) -> None:
    """Register written sub-partitions, all in one catalog call."""
    if specs:
        store.spark.sql(f"ALTER TABLE {store.name(table)} ADD IF NOT EXISTS {' '.join(map(_spec, specs))}")
    store.spark.catalog.refreshTable(store.name(table))


def drop_partitions(store: MetricStore, table: str, specs: list[dict]) -> None:
    """Take sub-partitions out of the catalog, in one call, then delete their folders."""
    if not specs:
        return
    store.spark.sql(f"ALTER TABLE {store.name(table)} DROP IF EXISTS {', '.join(map(_spec, specs))}")
    for s in specs:
        delete_path(store.spark, f"{store.path(table)}/" + "/".join(f"{k}={v}" for k, v in s.items()))
    store.spark.catalog.refreshTable(store.name(table))


def registered(store: MetricStore, table: str, spec: dict) -> bool:
    return not store.spark.sql(f"SHOW PARTITIONS {store.name(table)} {_spec(spec)}").isEmpty()


# ---------------------------------------------------------------- leases
def _lease_folder(store: MetricStore, table: str) -> str:
    return f"{store.path(table)}/_lease"    # hidden from scans by its leading underscore


def live_runs(store: MetricStore, table: str) -> set[str]:
    """Runs that hold a lease of the table now."""
    found = set()
    for name in list_names(store.spark, _lease_folder(store, table)):
        text = read_text(store.spark, f"{_lease_folder(store, table)}/{name}")
        held = json.loads(text) if text else None
        if held and held["until"] > time.time():
            found.add(held["run"])
    return found


@contextlib.contextmanager
def lease(store: MetricStore, table: str, partition: str, run: str, seconds: float = LEASE_SECONDS) -> Iterator[Callable[[], None]]:
    """Hold a partition alone. Gives a function that raises unless it is still held."""
    spark, path = store.spark, f"{_lease_folder(store, table)}/{partition}"
    mine = json.dumps({"run": run, "until": time.time() + seconds})
    if not create_text(spark, path, mine):
        text = read_text(spark, path)
        if text and json.loads(text)["until"] > time.time():
            raise PartitionBusy(f"{table}/{partition} is held by another run")
        # of several takers of a dead lease one gets to move it away
        gone = f"{path}.{uuid.uuid4().hex}"
        try:
            rename(spark, path, gone)
        except Exception:
            raise PartitionBusy(f"{table}/{partition} was just taken") from None
        delete_path(spark, gone)
        if not create_text(spark, path, mine):
            raise PartitionBusy(f"{table}/{partition} was just taken")

    def still_held() -> None:
        if read_text(spark, path) != mine:
            raise PartitionBusy(f"{table}/{partition} was taken over")
    try:
        yield still_held
    finally:
        if read_text(spark, path) == mine:
            delete_path(spark, path)


# ---------------------------------------------------------------- replacement
def _notes(store: MetricStore, table: str) -> str:
    return f"{store.path(table)}/_replaced"


def _read_notes(store: MetricStore, table: str) -> dict[str, dict]:
    folder = _notes(store, table)
    found = {run: read_text(store.spark, f"{folder}/{run}") for run in list_names(store.spark, folder)}
    return {run: json.loads(text) for run, text in found.items() if text}


def replaced(store: MetricStore, table: str) -> Column | None:
    """True for rows of generations that a registered compaction has replaced; None if there are none."""
    hidden = None
    for run, note in _read_notes(store, table).items():
        if registered(store, table, {**note["partition"], GENERATION: run}):
            (key, value), = note["partition"].items()
            old = (F.col(key).cast("string") == value) & F.col(GENERATION).isin(note["old"])
            hidden = old if hidden is None else hidden | old
    return hidden


def _complete(store: MetricStore, table: str, run: str, note: dict) -> bool:
    """End a run that stopped or is at its end; True if its generation stands. Every step may have been done."""
    new = {**note["partition"], GENERATION: run}
    done = registered(store, table, new)
    if done:
        drop_partitions(store, table, [{**note["partition"], GENERATION: g} for g in note["old"]])
    else:
        delete_path(store.spark, f"{store.path(table)}/" + "/".join(f"{k}={v}" for k, v in new.items()))
    delete_path(store.spark, f"{_notes(store, table)}/{run}")
    return done


def recover(store: MetricStore, table: str) -> int:
    """Complete or undo the table's dead runs. How many were completed."""
    notes, live = _read_notes(store, table), live_runs(store, table)
    done = sum(_complete(store, table, run, note) for run, note in notes.items() if run not in live)
    work = f"{store.path(table)}/_compaction"
    for run in list_names(store.spark, work):
        if run not in live_runs(store, table):
            delete_path(store.spark, f"{work}/{run}")
    return done


def replace(store: MetricStore, table: str, value, rewrite, options: dict[str, str], open_generations: frozenset[str] | set = frozenset(),
            after_staging=None, least: int = 1) -> int:
    """Merge the generations that one partition has now. ``rewrite`` maps their rows to the new ones.

    Returns the rows of the new generation; 0 where fewer than ``least`` generations are there."""
    spark, run = store.spark, f"c{uuid.uuid4().hex}"
    schema, (key,) = TABLES[table]
    with lease(store, table, f"{key}={value}", run) as still_held:
        recover(store, table)
        old = sorted(s[GENERATION] for s in partitions(store, table)
                     if s[key] == str(value) and s[GENERATION] not in open_generations)
        if len(old) < least:
            return 0
        rows = spark.table(store.name(table)).where((F.col(key) == F.lit(value).cast(schema[key].dataType)) & F.col(GENERATION).isin(old))
        work = f"{store.path(table)}/_compaction/{run}"
        rewrite(rows.drop(GENERATION)).drop(key).write.options(**options).parquet(work)
        stored = [f for f in schema.fields if f.name != key]
        count = lambda path: spark.read.schema(type(schema)(stored)).parquet(path).count()
        n = count(work)
        if after_staging:
            after_staging()
        still_held()
        if not create_text(spark, f"{_notes(store, table)}/{run}", json.dumps({"partition": {key: str(value)}, "old": old})):
            raise OSError(f"the note of {run} exists already")
        target = f"{store.path(table)}/{key}={value}/{GENERATION}={run}"
        rename(spark, work, target)
        if count(target) != n:
            raise OSError(f"{target} does not hold the {n} rows that were staged")
        add_partitions(store, table, [{key: str(value), GENERATION: run}])
        _complete(store, table, run, {"partition": {key: str(value)}, "old": old})
    return n


# ---------------------------------------------------------------- epochs of streams
class Epochs:
    """Batch ids of a stream's epochs that may still be replayed.

    They are kept below the store, by the stream's own id, which lies in its
    checkpoint folder: two streams, or one on a new checkpoint, never share any.
    A replayed epoch gets the batch id and time of its first attempt."""

    def __init__(self, store: MetricStore, checkpoint: str):
        self.store, path = store, f"{checkpoint.rstrip('/')}/metricmart-stream"
        create_text(store.spark, path, uuid.uuid4().hex)
        self.root = f"{_epochs(store)}/{read_text(store.spark, path)}"

    def batch(self, epoch: int, new_id: Callable[[], int]) -> tuple[int, float]:
        """(batch id, time of the first attempt) of an epoch. Epochs before the last one are forgotten."""
        path = f"{self.root}/{epoch}"
        if read_text(self.store.spark, path) is None:
            create_text(self.store.spark, path, json.dumps({"batch_id": new_id(), "at": time.time()}))
        for name in list_names(self.store.spark, self.root):
            if int(name) < epoch:
                delete_path(self.store.spark, f"{self.root}/{name}")
        kept = json.loads(read_text(self.store.spark, path))
        return kept["batch_id"], kept["at"]


def _epochs(store: MetricStore) -> str:
    return f"{store.root.rstrip('/')}/_epochs"


def open_generations(store: MetricStore) -> set[str]:
    """Generations of epochs that a stream may replay."""
    found, root = set(), _epochs(store)
    for stream in list_names(store.spark, root):
        for epoch in list_names(store.spark, f"{root}/{stream}"):
            text = read_text(store.spark, f"{root}/{stream}/{epoch}")
            if text:
                found.add(batch_generation(json.loads(text)["batch_id"]))
    return found
