"""Bounded-space online packing of token ids into sequences.

Each task packs its own documents as they come. It keeps at most ``windows``
open windows; a document gives whole windows of its own first, and the rest is
placed into the open window that it fits best (the one with the least room).
Where it fits none, a new window is opened while there are fewer than
``windows``; after that the fullest one is filled up with the start of the rest
and emitted, and what remains is placed again. At its end a task empties its
windows into each other, the emptiest first, and keeps one leftover of less than
a sequence. Leftovers are merged the same way, ``FAN_IN`` at a time, level by
level, until one is left; it is cut into sequences whose lengths are powers of
two. So no id is padding, and every sequence but those of the last leftover
(at most one of each power of two) is full.

Memory is bounded by the open windows and the batch at hand. Each level is
written before the next one reads it, so a lost executor costs its tasks alone.

Ids are those of the tokenizers library. Parts of a text that begin with a lone
space between visible characters have ids of their own (no match of the
pre-tokenizer reaches over such a place), so the library encodes each distinct
part once, many together, and a worker keeps the ids of ``CACHE_PARTS`` parts. The
texts of a run are cut, and their ids joined, as Arrow columns: Python handles
each distinct part of a run, not each occurrence. The file must be of byte-level tokens without normalisation; others are refused.

Defined results: a NULL or empty text has the end id alone; a document's pieces
cover its ids once, whatever their number; rows equal in all columns are packed
each by itself; rows with a NULL id are packed like others; ties between equally
full windows go to the one opened first; an empty table has no piece; columns
beside doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmart.llm.common import materialise, runs, table

#: Windows that a task keeps open.
WINDOWS = 64
#: Leftovers that are merged into one.
FAN_IN = 32
#: Distinct text parts whose ids a Python worker keeps; a full cache starts anew.
CACHE_PARTS = 1_000_000
#: Parts that are encoded as one text.
JOINED_PARTS = 2000
#: Longer parts are encoded anew each time.
CACHE_CHARS = 48
#: Where a text may be cut: before a lone space between visible characters.
CUT = re.compile(r"(?<=\S)(?= \S)")


def _edged(part: str) -> bool:
    """Whether white space at the part's ends may belong to a match that reaches over them."""
    return not part or part[0].isspace() or part[-1].isspace()


class PartEncoder:
    """Ids of texts, as little-endian unsigned 32-bit integers, by a tokenizers file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}  # of parts after a space, which is left out of the key
        tokens = sorted(self.tokenizer.get_vocab().items(), key=lambda t: t[1])
        self.sizes = np.zeros(tokens[-1][1] + 1, np.int64)  # bytes of each token: a character each
        self.sizes[[i for _, i in tokens]] = [len(t) for t, _ in tokens]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _part_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that may follow each other: as one text, cut where the tokens' bytes reach the parts' ends."""
        found = []
        for i in range(0, len(parts), JOINED_PARTS):
            some = [" " + p for p in parts[i:i + JOINED_PARTS]]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(p.encode()) for p in some])
            reached = np.cumsum(self.sizes[ids])
            at = np.searchsorted(reached, ends)
            if reached[-1] != ends[-1] or (reached[at] != ends).any():
                raise ValueError("the tokenizer's tokens aren't the bytes of the text")
            raw, cuts = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
            found += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > CACHE_PARTS:
            self.kept = {}
        return self._encode(pc.split_pattern(pa.array(texts, pa.string()), " "), texts)

    def _encode(self, lists: pa.ListArray, texts: list[str] | None = None) -> list[bytes]:
        """Ids of texts given by their parts: what is before the first space, then each part after one.

        With ``texts``, those that have parts with edges of white space are cut at ``CUT`` instead."""
        if not len(lists):
            return []
        kept, starts = self.kept, lists.offsets.to_numpy()
        starts = starts - starts[0]
        # a part of many occurrences is looked up once
        coded = lists.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(kept.get, names))
        unknown = np.array([i for i, own in enumerate(ids) if own is None], np.int64)
        edged = np.array([_edged(names[i]) for i in unknown.tolist()], bool)
        if texts is not None and edged.any():
            loose = np.zeros(len(names), bool)
            loose[unknown[edged]] = True
            loose = np.logical_or.reduceat(loose[codes], starts[:-1])
            cut = [CUT.split(texts[i]) for i in np.flatnonzero(loose).tolist()]
            cut = pa.array([[head, *(p[1:] for p in rest)] for head, *rest in cut], lists.type)
            others, own = iter(self._encode(lists.filter(pa.array(~loose)))), iter(self._encode(cut))
            return [next(own if x else others) for x in loose.tolist()]
        heads = [names[i] for i in codes[starts[:-1]].tolist()]
        codes[starts[:-1]] = len(names) + np.arange(len(heads))
        used = np.zeros(len(names) + len(heads), bool)
        used[codes] = True
        # a part with edges of white space isn't kept: elsewhere it may be a piece of a match
        once = unknown[edged & used[unknown]].tolist()
        for i, own in zip(once, self._ids([" " + names[i] for i in once]), strict=True):
            ids[i] = own
        plain = unknown[~edged & used[unknown]].tolist()
        for i, own in zip(plain, self._part_ids([names[i] for i in plain]), strict=True):
            ids[i] = own
            if len(names[i]) <= CACHE_CHARS:
                kept[names[i]] = own
        joined = pa.array(ids + self._ids(heads), pa.large_binary()).take(pa.array(codes))
        _, ends, raw = joined.buffers()
        cuts, raw = np.frombuffer(ends, np.int64)[starts].tolist(), memoryview(raw or b"")
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def encoder(path: str) -> PartEncoder:
    """One encoder for each tokenizers file and Python worker."""
    return PartEncoder(path)


class Packer:
    """Open windows of one task. ``done`` takes each emitted window, a list of pieces.

    A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, size: int, windows: int, done):
        self.size, self.windows, self.done = size, windows, done
        self.by_room: list[tuple[int, int]] = []  # (room, number) of the open windows, in order
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0

    def add(self, doc_id, ids: bytes):
        tokens = len(ids) // 4
        whole = tokens - tokens % self.size
        for start in range(0, whole, self.size):
            self.done([(doc_id, start, ids[4 * start:4 * (start + self.size)], tokens)])
        if whole < tokens:
            self.place((doc_id, whole, ids[4 * whole:], tokens), self.windows)

    def place(self, piece: tuple, windows: int):
        """Into the best fitting window, a new one while there are fewer than ``windows``, or cut."""
        while True:
            doc_id, start, ids, tokens = piece
            n = len(ids) // 4
            at = bisect_left(self.by_room, (n, -1))
            if at < len(self.by_room):
                room, number = self.by_room.pop(at)
            elif len(self.by_room) < windows:
                room, number, self.opened = self.size, self.opened, self.opened + 1
                self.held[number] = []
            else:
                room, number = self.by_room.pop(0)
                self.done([*self.held.pop(number), (doc_id, start, ids[:4 * room], tokens)])
                piece = (doc_id, start + room, ids[4 * room:], tokens)
                continue
            self.held[number].append(piece)
            if room == n:
                self.done(self.held.pop(number))
            else:
                insort(self.by_room, (room - n, number))
            return

    def leftover(self) -> list[tuple]:
        """Empty the open windows into each other; the pieces of the last one."""
        while len(self.by_room) > 1:
            _, number = self.by_room.pop()
            for piece in self.held.pop(number):
                self.place(piece, 1)
        return next(iter(self.held.values()), [])


PIECE = [("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()),
         ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType()), ("from_group", T.LongType())]


def _schema(doc_id: T.DataType) -> T.StructType:
    """Pieces; leftover ones have no sequence yet, but their ids and the group that they come from."""
    schema = T.StructType().add("doc_id", doc_id).add("start", T.LongType())
    for name, kind in PIECE:
        schema = schema.add(name, kind)
    return schema


class _Rows:
    """Collects pieces as rows of ``_schema``; sequences are numbered by level, group and order."""

    def __init__(self, level: int, group: int):
        self.base, self.group, self.sequences, self.rows = (level << 60) + (group << 32), group, 0, []

    def emit(self, pieces: list[tuple]):
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), tokens, self.base + self.sequences, offset, None, None))
            offset += n
        self.sequences += 1

    def keep(self, pieces: list[tuple]):
        for doc_id, start, ids, tokens in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, None, tokens, None, None, ids, self.group))

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(schema)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        self.rows = []
        return made


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _powers(pieces: list[tuple], size: int) -> Iterator[list[tuple]]:
    """Cut pieces of less than ``size`` ids in all into sequences of descending powers of two."""
    total = sum(len(p[2]) // 4 for p in pieces)
    pieces = pieces[::-1]
    for bit in reversed(range(size.bit_length())):
        room = total & 1 << bit
        sequence = []
        while room:
            doc_id, start, ids, tokens = pieces.pop()
            if len(ids) // 4 > room:
                pieces.append((doc_id, start + room, ids[4 * room:], tokens))
                ids = ids[:4 * room]
            sequence.append((doc_id, start, ids, tokens))
            room -= len(ids) // 4
        if sequence:
            yield sequence


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, windows: int = WINDOWS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of each document.

    A document is its text's ids by the tokenizers file ``tokenizer`` (a path that
    every executor can open) and ``end_id``. ``size`` must be a power of two."""
    if size < 1 or size & size - 1:
        raise ValueError("size must be a power of two")
    schema = _schema(docs.schema["doc_id"].dataType)
    arrow, end = _arrow(schema), np.array([end_id], "<u4").tobytes()

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(0, TaskContext.get().partitionId())
        packer = Packer(size, windows, rows.emit)
        for batch in batches:
            for run in runs(batch, "text"):
                texts = [t or "" for t in run.column("text").to_pylist()]
                ids = encoder(tokenizer).encode(texts)
                for doc_id, own in zip(run.column("doc_id").to_pylist(), ids, strict=True):
                    packer.add(doc_id, own + end)
                yield rows.batch(arrow)
        rows.keep(packer.leftover())
        yield rows.batch(arrow)

    def merge(level: int, last: bool):
        def merge_group(key: tuple, pieces: pa.Table) -> pa.Table:
            rows = _Rows(level, key[0].as_py())
            packer = Packer(size, windows, rows.emit)
            for p in pieces.select(["doc_id", "start", "ids", "doc_tokens", "from_group"]).sort_by(
                    [("from_group", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")]).to_pylist():
                packer.place((p["doc_id"], p["start"], p["ids"], p["doc_tokens"]), windows)
            left = packer.leftover()
            if last:
                for sequence in _powers(left, size):
                    rows.emit(sequence)
            else:
                rows.keep(left)
            return pa.Table.from_batches([rows.batch(arrow)])
        return merge_group

    levels = [materialise(docs.select("doc_id", "text").mapInArrow(pack_task, schema), "packed-0")]
    groups = 1 + (levels[0].agg(F.max("from_group")).first()[0] or 0)
    while True:
        groups = -(-groups // FAN_IN)
        left = levels[-1].filter("ids IS NOT NULL")
        merged = left.groupBy(F.expr(f"from_group div {FAN_IN}").alias("group")).applyInArrow(
            merge(len(levels), groups == 1), schema)
        levels.append(materialise(merged, f"packed-{len(levels)}"))
        if groups == 1:
            break
    pieces = levels[0]
    for more in levels[1:]:
        pieces = pieces.unionByName(more)
    return pieces.filter("sequence_id IS NOT NULL").drop("ids", "from_group")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 ids."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
