"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to their words (A-Z lower-cased, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) joined by single spaces. The automaton
holds every window of 13 consecutive benchmark words (a shorter item is one
window), each between spaces so that only whole words match, and one scan of a
normalised text finds every occurrence. Word numbers lead back to offsets in
the original text.

The automaton covers a block of about ``block_bytes`` of benchmark text; a
larger benchmark is cut into pieces that share 12 words, so that a long item
can't fill a block, and held against all documents block by block. Rows are then
numbered and written once; only numbers, word counts and hits are grouped.

Defined results: NULL or empty texts have no words and no hits; very long texts
are scanned whole; NULL benchmark texts give no windows; repeated items each
count under their own id; a NULL item id counts as the item "" ; an empty
benchmark marks nothing; repeated document rows give repeated results; ties
can't occur, every window that is met counts; other columns, of any type, are
not read by the scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmart.llm.common import byte_values, fresh_name, materialise, runs, table

WINDOW_WORDS = 13
#: Benchmark bytes that one automaton covers (about 100 times as much memory in a worker).
BLOCK_BYTES = 1 << 20
#: Windows of a piece of a long item, where the benchmark is more than one block.
PIECE_WINDOWS = 4096
#: Hit words per 100 words from which a document counts as contaminated.
CONTAMINATED_PERCENT = 5

#: Bytes that make words: digits, letters and all of UTF-8 beyond ASCII; others turn into spaces.
_NORMALISE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_SPACE = 0x20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMALISE).split()


def windows_of(words: list[bytes], size: int = WINDOW_WORDS) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class WindowAutomaton:
    """Finds the benchmark windows that occur in a normalised text."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW_WORDS):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for window in windows_of(words_of(text), size):
                owners.setdefault(window, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            # latin-1 keeps one character a byte
            self.automaton.add_word(f" {window.decode('latin-1')} ", (len(window) + 2, window.count(b" ") + 1, tuple(ids)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, normalised: bytes) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, word count) of each occurrence in a text of words each between spaces, and their items."""
        if self.empty:
            return [], set()
        found = list(self.automaton.iter(normalised.decode("latin-1")))
        if not found:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(normalised, np.uint8) == _SPACE)
        starts = np.array([end - n + 1 for end, (n, _, _) in found])
        first = np.searchsorted(spaces, starts).tolist()
        return [(a, n) for a, (_, (_, n, _)) in zip(first, found)], set().union(*(ids for _, (_, _, ids) in found))


#: The automaton that a Python worker built last, under its scan's token: tasks of one scan share it.
_built: dict[str, WindowAutomaton] = {}


def _worker_automaton(token: str, shared: Broadcast, size: int) -> WindowAutomaton:
    if token not in _built:
        _built.clear()
        _built[token] = WindowAutomaton(shared.value, size)
    return _built[token]


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs [start, end) covered by (start, length) ranges."""
    out: list[list[int]] = []
    for start, n in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n)
        else:
            out.append([start, start + n])
    return [(a, b) for a, b in out]


def original_offsets(text: str, word_runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets [start, end) in the original text of runs of word numbers."""
    raw = text.encode()
    inside = np.concatenate([[False], np.frombuffer(raw.translate(_NORMALISE), np.uint8) != _SPACE, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in word_runs]


def pieces(items: DataFrame, size: int, n_windows: int = PIECE_WINDOWS) -> DataFrame:
    """item_id, text: the normalised words of each item in pieces of at most ``n_windows`` windows.

    Neighbouring pieces share ``size - 1`` words, so that their windows are those of the item."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, "text"):
                rows, texts = [], []
                for i, raw in enumerate(byte_values(run.column("text"))):
                    words = words_of(raw)
                    some = [b" ".join(words[k : k + n_windows + size - 1])
                            for k in range(0, max(1, len(words) - size + 1), n_windows)] if words else []
                    rows += [i] * len(some)
                    texts += [t.decode() for t in some]
                yield pa.RecordBatch.from_arrays(
                    [run.column("item_id").take(pa.array(rows, pa.int64())), pa.array(texts, pa.string())], names=["item_id", "text"])

    rows = items.select("item_id", "text")
    return rows.mapInArrow(cut, rows.schema)


def benchmark_blocks(items: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of about ``block_bytes`` text bytes, dealt by a hash."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _scan_block(docs: DataFrame, items: DataFrame, size: int, with_spans: bool) -> DataFrame:
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    block = [(r.id, r.text.encode()) for r in rows.filter("text is not null").collect()]  # one bounded block
    shared = docs.sparkSession.sparkContext.broadcast(block)
    token = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _worker_automaton(token, shared, size)
        for batch in batches:
            for run in runs(batch, "text"):
                n_words, hits, items_hit, spans = [], [], [], []
                for raw in byte_values(run.column("text")):
                    words = words_of(raw)
                    ranges, ids = automaton.scan(b" " + b" ".join(words) + b" ")
                    covered = united(ranges)
                    n_words.append(len(words))
                    hits.append([{"first": a, "last": b - 1} for a, b in covered])
                    items_hit.append(sorted(ids))
                    if with_spans:
                        offsets = original_offsets(raw.decode(), covered) if covered else []
                        spans.append([{"start": a, "end": b} for a, b in offsets])
                columns = [run.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hits, HITS), pa.array(items_hit, pa.list_(pa.string()))]
                if with_spans:
                    columns.append(pa.array(spans, SPANS))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n_words", T.LongType())
    schema = schema.add("hits", T.ArrayType(run_of("first", "last"))).add("items", T.ArrayType(T.StringType()))
    if with_spans:
        schema = schema.add("spans", T.ArrayType(run_of("start", "end")))
    names = schema.names
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def run_of(start: str, end: str) -> T.StructType:
    return T.StructType().add(start, T.LongType()).add(end, T.LongType())


HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _blocks_of(items: DataFrame, size: int, block_bytes: int) -> list[DataFrame]:
    """The benchmark as one block, or its pieces in several."""
    blocks = benchmark_blocks(items, block_bytes)
    return blocks if len(blocks) == 1 else benchmark_blocks(materialise(pieces(items, size), "benchmark"), block_bytes)


def _united_hits(rows: DataFrame, blocks: list[DataFrame], size: int, with_spans: bool) -> DataFrame:
    """The columns of benchmark_hits for rows whose doc_id is unique, over several blocks."""
    parts = [_scan_block(rows, block, size, with_spans) for block in blocks]
    # the first block's scan counts the words of every row, the others add rows with hits
    parts = [parts[0], *[p.filter(F.size("items") > 0) for p in parts[1:]]]
    lists = ["hits", "items", *["spans"] * with_spans]
    # at most one row a block for each document
    merged = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(
        F.first("n_words").alias("n_words"),
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in lists])
    return merged.select("doc_id", "n_words", *[_merged(F.col(c), c) for c in lists])


def benchmark_hits(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS,
                   block_bytes: int = BLOCK_BYTES, with_spans: bool = True) -> DataFrame:
    """doc_id, n_words, hits (runs of hit words), items (ids found), spans (code point offsets) of each row."""
    blocks = _blocks_of(items, size, block_bytes)
    if len(blocks) == 1:
        return _scan_block(docs, blocks[0], size, with_spans)
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    found = _united_hits(rows.select(F.col("row").alias("doc_id"), "text"), blocks, size, with_spans)
    return rows.select("row", "doc_id").join(found.withColumnRenamed("doc_id", "row"), "row").drop("row")


def _merged(column, name: str):
    """United runs of a list of ranges from several blocks, or the sorted distinct ids."""
    if name == "items":
        return F.array_sort(column).alias(name)
    start, end = ("first", "last") if name == "hits" else ("start", "end")
    touch = 1 if name == "hits" else 0  # runs of words hold their last word
    kind = f"array<struct<{start}:bigint,{end}:bigint>>"

    def add(done, run):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (run[start] <= last[end] + touch)
        grown = F.struct(last[start].alias(start), F.greatest(last[end], run[end]).alias(end))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(
            F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(column), F.array().cast(kind), add).alias(name)


def verdict_columns(percent: int = CONTAMINATED_PERCENT) -> dict:
    """n_hit, n_items, items_sha256 and contaminated, from the columns of benchmark_hits."""
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1)
    return {
        "n_hit": n_hit,
        "n_items": F.size("items").cast("bigint"),
        "items_sha256": F.sha2(F.concat_ws(",", "items"), 256),
        "contaminated": (n_hit > 0) & (100 * n_hit >= percent * F.col("n_words")),
    }


def remove_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS,
                        percent: int = CONTAMINATED_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    While the benchmark is one block, the whole row is the scan's id and nothing
    is joined; else the numbers of contaminated rows are taken away from them."""
    blocks = _blocks_of(items, size, block_bytes)
    contaminated = verdict_columns(percent)["contaminated"]
    row = fresh_name(docs, "row")
    if len(blocks) == 1:
        whole = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
        kept = _scan_block(whole, blocks[0], size, with_spans=False).filter(~contaminated)
        return kept.select(*[F.col("doc_id")[c].alias(c) for c in docs.columns])
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _united_hits(rows.select(F.col(row).alias("doc_id"), "text"), blocks, size, with_spans=False)
    bad = found.filter(contaminated).select(F.col("doc_id").alias(row))
    return rows.join(bad, row, "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, and whether it counts as contaminated."""
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_spans=False)
    return hits.select("doc_id", "n_words", *[c.alias(n) for n, c in verdict_columns().items()])


#: DuckDB: windows of each item by word lists, met by the documents' word lists of the same lengths.
OP6_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, row_number() OVER () AS k, CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), coalesce(CAST(item_id AS VARCHAR), ''), text FROM benchmark
), w AS (
  SELECT kind, k, id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), []) AS ws FROM words
), windows AS (
  SELECT DISTINCT id AS item, least(13, len(ws)) AS n, unnest(list_transform(
    range(1, greatest(1, len(ws) - 12) + 1), lambda i: list_slice(ws, i, i + least(13, len(ws)) - 1))) AS win
  FROM w WHERE kind = 'i' AND len(ws) > 0
), lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT k, n, unnest(range(1, len(ws) - n + 2)) AS pos, ws FROM w, lengths WHERE kind = 'd' AND len(ws) >= n
), met AS (
  SELECT g.k, g.pos, g.n, x.item FROM grams g JOIN windows x ON x.n = g.n AND x.win = list_slice(g.ws, g.pos, g.pos + g.n - 1)
), hit AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(pos, pos + n)) AS p FROM met) GROUP BY k
), found AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT k, item FROM met) GROUP BY k
)
SELECT CAST(w.id AS BIGINT) AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit USING (k) LEFT JOIN found USING (k) WHERE kind = 'd'
"""
