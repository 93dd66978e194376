"""Suffix-array dedup: remove every byte inside a 200-byte string that starts anywhere else too.

Equal 200-byte strings (windows) have the same least hash of a 32-byte part, at
the same place inside them. So the windows of a text fall into segments with one
such anchor each, and equal windows always lie in segments with equal anchors.
Segments whose anchor occurs once hold no repeated window. Segments equal as a
whole are one string with a count, and all their windows repeat. The distinct
strings that share an anchor are dealt into shards by it. Only windows that share more than the anchor, a core of about 160
bytes, with a window of another string can repeat; the shard's suffix arrays of
those are built by induced sorting, and a window repeats where its common prefix with
a neighbour in the array, from permuted common prefixes, is 200 bytes or more.

An anchor of more than ``SHARD_STRINGS`` distinct strings is dealt by its cores: a row
for each string and core, with the bytes of the windows that hold it (at most five
rows a string). Equal ones are found by their bytes and go on as one; a core of few
distinct ones goes to suffix arrays. A core that still has too many is dealt again: a
window reaches over it by half of what it has beside it, to the left or to the right, so
two longer cores each take half of the windows. After at most seven such levels a core
is a window. So no group has to fit into one task, nothing is dropped or capped, and
suffix arrays or equal bytes decide every window of such an anchor.

Defined results: NULL counts as empty; texts shorter than 200 bytes repeat nothing
and stay whole; rows equal in id and text are two places, so both lose their
repeated bytes and have equal results; a NULL id stays NULL; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmart.llm.common import byte_values, materialise, runs, table
from metricmart.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH = 200
GRAM = 32
#: Bytes that are hashed at once; places in them take 20 bits of the keys whose least is sought.
PIECE = 1 << 20
#: Distinct strings of one anchor, or of one core, in a task, and bytes for which one suffix array is built.
SHARD_STRINGS = 2000
ARRAY_BYTES = 1 << 20
#: Bytes of whole groups that a task takes up at once.
BATCH_BYTES = 4 << 20

_PLACE = np.uint64(PIECE - 1)
_BASE = 0x9E3779B97F4A7C15
_FINAL = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Polynomial hashes, modulo 2**64, of any ranges of a byte string of at most PIECE bytes."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        n = len(data)
        self.back = _powers(pow(base, -1, 1 << 64), PIECE + 1)
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(base, PIECE + 1)[:n], dtype=np.uint64)
        self.sums = np.append(np.zeros(1, np.uint64), sums)

    def of(self, starts, ends, final: np.uint64) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        x ^= x >> np.uint64(32)
        x *= final
        return x ^ (x >> np.uint64(29))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        x = (self.sums[size:] - self.sums[:n]) * self.back[:n]
        x ^= x >> np.uint64(32)
        x *= _FINAL[0]
        return x ^ (x >> np.uint64(29))


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, place of the anchor in the first, anchor, whole hash) of each segment."""
    out = [[] for _ in range(6)]
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not held:
            return
        data = np.frombuffer(b"".join([p for _, _, p in held]), np.uint8)
        sizes = np.array([len(p) for _, _, p in held])
        begins = np.cumsum(sizes) - sizes
        hashes = Hashes(data)
        grams = hashes.grams(GRAM)
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        least = (least_in_windows(keys, length - GRAM + 1) & _PLACE).astype(np.int64)  # leftmost on ties
        piece = np.repeat(np.arange(len(held)), sizes)[: len(least)]
        inside = np.arange(len(least)) + length <= (begins + sizes)[piece]
        new = inside & np.concatenate([[True], (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])])
        first = np.flatnonzero(new)
        # a segment ends before the next one, or with its piece
        windows = np.minimum(np.append(first[1:], len(least)), (begins + sizes - length + 1)[piece[first]]) - first
        owner, offset = np.array([k for k, _, _ in held]), np.array([o for _, o, _ in held])
        values = (owner[piece[first]], first - begins[piece[first]] + offset[piece[first]], windows,
                  least[first] - first, grams[least[first]].view(np.int64), hashes.of(first, first + windows + length - 1, _FINAL[1]).view(np.int64))
        for column, value in zip(out, values):
            column.append(value)
        held.clear()

    size = 0
    for number, text in enumerate(texts):
        for offset in range(0, max(0, len(text) - length + 1), PIECE - length):
            part = text[offset : offset + PIECE - 1]  # pieces overlap, so every window is in one whole
            if size + len(part) >= PIECE:
                flush()
                size = 0
            held.append((number, offset, part))
            size += len(part)
    flush()
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def all_segments(docs: DataFrame, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, "text"):
                number, first, windows, offset, anchor, whole = segments(byte_values(run.column("text")), length)
                at = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id").take(at), run.column("text_hash").take(at), pa.array(first, pa.int32()),
                     pa.array(windows, pa.int32()), pa.array(offset, pa.int16()), pa.array(anchor), pa.array(whole)],
                    names=schema.names)

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("text_hash", T.LongType())
    schema = schema.add("first", T.IntegerType()).add("windows", T.IntegerType()).add("offset", T.ShortType())
    schema = schema.add("anchor", T.LongType()).add("whole", T.LongType())
    return docs.mapInArrow(cut, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, packed: the texts compressed, as they are shuffled more than once."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for run in runs(batch, "text"):
                data = [squeeze.compress(t) for t in byte_values(run.column("text"))]
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), run.column("text_hash"), pa.array(data, pa.binary())], names=schema.names)

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("text_hash", T.LongType()).add("packed", T.BinaryType())
    return docs.mapInArrow(pack, schema)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def repeated_windows(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, which of its windows start anywhere else in the strings."""
    sizes = np.array([len(s) for s in strings])
    text = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 1
    array = suffix_array(np.append(text, 0), 258)
    long_ = permuted_prefixes(np.append(text, 0), array, 2)[array] >= length
    repeats = np.zeros(len(text) + 1, bool)
    repeats[array[long_]] = True  # like the one before it
    repeats[array[np.append(long_[1:], False)]] = True  # like the one after it
    begins = ends - sizes
    return [repeats[b : b + n - length + 1] for b, n in zip(begins.tolist(), sizes.tolist())]


def cells(offset: int, windows: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(cell, first window, last window, start of the core) of a string's windows by the place of
    the anchor in them. A cell's windows all hold the core, which starts at the same distance from
    the anchor in every string."""
    width = cell_width(length)
    for cell in range((offset - windows + 1) // width, offset // width + 1):
        yield cell, max(0, offset - cell * width - width + 1), min(windows - 1, offset - cell * width), offset - cell * width


def cell_width(length: int) -> int:
    return max(1, (length - GRAM) // 4)


def repeated_in_shard(rows: list[dict], length: int) -> list[np.ndarray]:
    """For each string of whole anchors, which of its windows start in another place of them."""
    core = length - cell_width(length) + 1
    groups: dict[tuple, list[tuple[int, int, int]]] = {}
    masks = []
    for i, row in enumerate(rows):
        data = row["data"]
        n = len(data) - length + 1
        masks.append(np.zeros(n, bool))
        for cell, a, b, start in cells(row["offset"], n, length):
            groups.setdefault((row["anchor"], cell, data[start : start + core]), []).append((i, a, b))
    held: list[tuple[bytes, tuple[int, int]]] = []
    size = 0

    def sort_held() -> None:
        for (_, (i, a)), mask in zip(held, repeated_windows([data for data, _ in held], length) if held else []):
            masks[i][a : a + len(mask)] |= mask
        held.clear()

    for group in groups.values():
        if len(group) == 1:
            continue  # no other string has the core
        alike: dict[bytes, list[tuple[int, int]]] = {}
        for i, a, b in group:
            alike.setdefault(rows[i]["data"][a : b + length], []).append((i, a))
        for data, members in alike.items():
            if len(members) > 1:  # copies repeat as a whole
                for i, a in members:
                    masks[i][a : a + len(data) - length + 1] = True
        if len(alike) > 1:
            held += [(data, members[0]) for data, members in alike.items()]
            size += sum(map(len, alike))
        if size >= ARRAY_BYTES:
            sort_held()
            size = 0
    sort_held()
    return masks


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def _strings(packed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments: one row each, with anchor and whether that has too many strings for one task."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                text = _unpack(row["packed"])
                for s in row["segments"]:
                    data = text[s["first"] : s["first"] + s["windows"] + length - 1]
                    out.append((row["doc_id"], row["text_hash"], s["first"], s["n"], s["offset"], s["anchor"], s["hot"], data))
                    size += len(data)
                    if size >= PIECE:
                        yield _columns(out, arrow)
                        out, size = [], 0
            yield _columns(out, arrow)

    id_type = packed.schema["doc_id"].dataType
    schema = T.StructType().add("doc_id", id_type).add("text_hash", T.LongType()).add("first", T.IntegerType()).add("n", T.LongType()).add("offset", T.ShortType())
    schema = schema.add("anchor", T.LongType()).add("hot", T.BooleanType()).add("data", T.BinaryType())
    arrow = _arrow(schema)
    lists = wanted.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("first", "windows", "n", "offset", "anchor", "hot")).alias("segments"))
    lists = lists.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "segments")
    # a document that is listed twice gives its strings once
    once = packed.join(lists, packed.doc_id.eqNullSafe(lists.id) & (packed.text_hash == lists.hash)).select("doc_id", "text_hash", "packed", "segments")
    return once.mapInArrow(extract, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _range_schema(id_type: T.DataType) -> T.StructType:
    schema = T.StructType().add("doc_id", id_type).add("text_hash", T.LongType())
    return schema.add("first", T.IntegerType()).add("windows", T.IntegerType())


def _search(strings: DataFrame, length: int) -> DataFrame:
    """doc_id, text_hash, first, windows from the suffix arrays of all anchors."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["anchor"] != last and size >= BATCH_BYTES:
                    yield _columns(sorted_out(held), arrow)
                    held, size = [], 0
                last = row["anchor"]
                held.append(row)
                size += len(row["data"])
        if held:
            yield _columns(sorted_out(held), arrow)

    def sorted_out(rows: list[dict]) -> list[tuple]:
        return [(row["doc_id"], row["text_hash"], row["first"] + int(a), int(n))
                for row, mask in zip(rows, repeated_in_shard(rows, length)) if row["n"] == 1
                for a, n in zip(*_ranges(mask))]

    schema = _range_schema(strings.schema["doc_id"].dataType)
    arrow = _arrow(schema)
    return strings.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(search, schema)


def _cell_schema(id_type: T.DataType) -> T.StructType:
    """A core and the windows around it: the first window's place, windows, where the core starts
    in data and its size, its key, whether the windows are known to repeat, and their bytes."""
    schema = _range_schema(id_type).add("begin", T.IntegerType()).add("core", T.IntegerType())
    return schema.add("key", T.BinaryType()).add("known", T.BooleanType()).add("data", T.BinaryType())


def _core_key(parent: bytes, side: str, core: bytes) -> bytes:
    return hashlib.blake2b(core, digest_size=16, key=parent, person=side.encode()).digest()


def halves(windows: int, begin: int, core: int, length: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(side, first window, last window, start of the longer core, its size) of the two parts of a
    core's windows: those that reach ``reach`` bytes or more to the left of it, and the others,
    which reach as far as is left to the right."""
    reach = (length - core + 1) // 2
    split = begin - reach
    if split >= 0:
        yield "l", 0, min(windows - 1, split), begin - reach, core + reach
    if split < windows - 1:
        yield "r", max(0, split + 1), windows - 1, begin, length - reach + 1


def _first_cells(strings: DataFrame, length: int) -> DataFrame:
    schema = _cell_schema(strings.schema["doc_id"].dataType)
    arrow, core = _arrow(schema), length - cell_width(length) + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = row["data"]
                for cell, a, b, start in cells(row["offset"], len(data) - length + 1, length):
                    key = _core_key(f"{row['anchor']} {cell}".encode(), "", data[start : start + core])
                    out.append((row["doc_id"], row["text_hash"], row["first"] + a, b - a + 1, start - a, core, key, row["n"] > 1, data[a : b + length]))
            yield _columns(out, arrow)

    return strings.mapInArrow(cut, schema)


def _next_cells(cores: DataFrame, length: int) -> DataFrame:
    schema = _cell_schema(cores.schema["doc_id"].dataType)
    arrow = _arrow(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = row["data"]
                for side, a, b, start, size in halves(row["windows"], row["begin"], row["core"], length):
                    key = _core_key(row["key"], side, data[start : start + size])
                    out.append((row["doc_id"], row["text_hash"], row["first"] + a, b - a + 1, start - a, size, key, row["known"], data[a : b + length]))
            yield _columns(out, arrow)

    return cores.mapInArrow(cut, schema)


def _search_cells(cores: DataFrame, length: int) -> DataFrame:
    """doc_id, text_hash, first, windows from suffix arrays over the distinct rows of whole cores."""
    schema = _range_schema(cores.schema["doc_id"].dataType)
    arrow = _arrow(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] != last and size >= ARRAY_BYTES:
                    yield _columns(sorted_out(held), arrow)
                    held, size = [], 0
                last = row["key"]
                held.append(row)
                size += len(row["data"])
        if held:
            yield _columns(sorted_out(held), arrow)

    def sorted_out(rows: list[dict]) -> list[tuple]:
        return [(row["doc_id"], row["text_hash"], row["first"] + int(a), int(n))
                for row, mask in zip(rows, repeated_windows([r["data"] for r in rows], length)) if not row["known"]
                for a, n in zip(*_ranges(mask))]

    return cores.repartition("key").sortWithinPartitions("key").mapInArrow(search, schema)


def _search_hot(strings: DataFrame, length: int, shard_strings: int) -> DataFrame | None:
    """doc_id, text_hash, first, windows of anchors with too many strings for one task."""
    found = None
    rows = materialise(_first_cells(strings, length), "cells")
    while not rows.isEmpty():
        one = F.struct("doc_id", "text_hash", "first", "windows", "begin", "core")
        distinct = materialise(rows.groupBy("key", "data").agg(
            F.count("*").alias("n"), F.max("known").alias("known"), F.min(one).alias("one")), "distinct-cells")
        # equal windows repeat as a whole, wherever they are not known to yet
        again = rows.filter("NOT known").join(distinct.filter("n > 1").select("key", "data"), ["key", "data"], "left_semi")
        of_core = materialise(distinct.groupBy("key").agg(F.count("*").alias("of_core")).filter("of_core > 1"), "cores")
        shared = distinct.join(of_core, "key").select(
            "one.*", "key", (F.col("known") | (F.col("n") > 1)).alias("known"), "data", "of_core")
        few = _search_cells(shared.filter(F.col("of_core") <= shard_strings).drop("of_core"), length)
        ranges = materialise(again.select("doc_id", "text_hash", "first", "windows").unionByName(few), "cell-ranges")
        found = ranges if found is None else found.unionByName(ranges)
        many = shared.filter((F.col("of_core") > shard_strings) & (F.col("core") < length)).drop("of_core")
        rows = materialise(_next_cells(many, length), "cells")
    return found


def repeated_ranges(docs: DataFrame, packed: DataFrame, length: int = LENGTH, shard_strings: int = SHARD_STRINGS) -> DataFrame:
    """doc_id, text_hash, first, windows: ranges of repeated windows of each document."""
    every = materialise(all_segments(docs, length), "segments")
    shared = materialise(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors")
    some = materialise(every.join(shared, "anchor"), "shared-segments")
    place = F.struct("doc_id", "text_hash", "first", "windows", "offset")
    strings = materialise(some.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(place).alias("place")), "strings")
    # segments that are equal as a whole repeat as a whole
    again = materialise(strings.filter("n > 1").select("anchor", "whole"), "repeated-strings")
    copies = some.join(again, ["anchor", "whole"]).select("doc_id", "text_hash", "first", "windows")
    # the other strings of an anchor go to suffix arrays, one stand-in for each group of copies
    mixed = strings.groupBy("anchor").agg(F.count("*").alias("strings")).filter("strings > 1")
    mixed = materialise(mixed.select("anchor", (F.col("strings") > shard_strings).alias("hot")), "mixed-anchors")
    wanted = strings.join(mixed, "anchor").select("place.*", "n", "anchor", "hot")
    if mixed.filter("hot").isEmpty():
        return copies.unionByName(materialise(_search(_strings(packed, wanted, length), length), "searched"))
    data = materialise(_strings(packed, wanted, length), "string-bytes")
    own = materialise(_search(data.filter("NOT hot"), length), "searched")
    ranges = copies.unionByName(own)
    across = _search_hot(data.filter("hot"), length, shard_strings)
    return ranges if across is None else ranges.unionByName(across)


def covered(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of the bytes under ranges of windows."""
    out: list[list[int]] = []
    for first, end in sorted((r["first"], r["first"] + r["windows"] - 1 + length) for r in ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def dedup_substrings(docs: DataFrame, length: int = LENGTH, shard_strings: int = SHARD_STRINGS, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, spans (removed [start, end) byte ranges), kept_sha256 and, if asked for, the kept bytes."""
    keyed = _keyed(docs)
    packed = _packed(keyed)
    lists = repeated_ranges(keyed, packed, length, shard_strings).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("first", "windows")).alias("ranges"))
    lists = lists.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "ranges")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                text = _unpack(row["packed"])
                spans = covered(row["ranges"] or [], length)
                edges = [0, *[e for span in spans for e in span], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((row["doc_id"], len(text), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), *[kept] * with_kept))
                size += len(text)
                if size >= PIECE:
                    yield _columns(out, arrow)
                    out, size = [], 0
            yield _columns(out, arrow)

    span = T.StructType().add("start", T.LongType()).add("end", T.LongType())
    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n_bytes", T.LongType())
    schema = schema.add("spans", T.ArrayType(span)).add("kept_sha256", T.StringType())
    schema = schema.add("kept", T.BinaryType()) if with_kept else schema
    arrow = _arrow(schema)
    joined = packed.join(lists, packed.doc_id.eqNullSafe(lists.id) & (packed.text_hash == lists.hash), "left")
    return joined.select("doc_id", "packed", "ranges").mapInArrow(remove, schema)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed bytes and spans, and a digest of what is left, of every document."""
    out = dedup_substrings(table(spark, sf_dir, "documents"), with_kept=False)
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
