"""SimHash near-dedup through a Gray-order hierarchical index.

Fingerprints: 64 bits over XXH64 hashes of 4-word shingles. Two fingerprints
that differ in at most 4 of 64 bits agree on one of 5 disjoint blocks of bits,
so each distinct fingerprint is dealt to 5 blocks' groups and every link is found
in one of them. Inside a group the fingerprints are sorted by Gray rank and
indexed as a tree: a node holds the bits that all its fingerprints share (a mask
and a pattern) and only the bits that its parent didn't settle add to the
accumulated difference, so whole subtrees are pruned, or accepted without
looking further once even their worst case is near enough. A group yields a
spanning forest of its links, never its pairs; those forests are united by
min-label propagation, checkpointed after each round.

A group of more than ``BLOCK_ROWS`` fingerprints is cut into blocks by a hash and
handled as pairs of blocks, in different tasks, so no task holds more than two
blocks; every pair of blocks is covered, so no link is lost. The blocks aren't
ranges of the Gray order, so no pair of them is pruned: of n fingerprints about
n * n / ``BLOCK_ROWS`` rows are shuffled. Only inside a pair does the index prune.

Defined results: a NULL or empty text has fingerprint zero and is linked like
any other; a text of fewer than 4 words is one shingle; repeated rows are
members like others; a component's id is its smallest doc_id (NULL ids aside;
NULL if it has no other); an empty table gives an empty result; other columns
pass through where rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmart.llm.common import byte_values, fresh_name, materialise, runs, table

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints of a group that one index holds; a larger group is cut by a hash.
BLOCK_ROWS = 2048
#: Fingerprints below a node that are compared one by one.
LEAF_ROWS = 256


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of a UTF-8 text: a bit is 1 if set in over half the shingles' hashes."""
    words = text.lower().split()  # bytes: A-Z only, and the white space of ASCII only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    n = max(1, len(words) - size + 1)
    starts = (ends - lengths + 1)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(size, len(words)) - 1 :].tolist())], "<u8")
    return int.from_bytes(_majority(hashes), "little")


def _majority(hashes: np.ndarray) -> bytes:
    # 4096 hashes at a time: eight times their bytes are unpacked
    ones = sum(np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
               for i in range(0, len(hashes), 4096))
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (signed 64-bit) of each row."""
    def run_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch, "text"):
                fps = np.array([fingerprint(t, size) for t in byte_values(run.column("text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("fp", T.LongType())
    return docs.select("doc_id", "text").mapInArrow(run_texts, schema)


def block_masks(max_bits: int) -> list[int]:
    """max_bits + 1 disjoint masks that cover 64 bits, of nearly equal width."""
    edges = [round(64 * i / (max_bits + 1)) for i in range(max_bits + 2)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray code."""
    rank = fps.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def unite(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


class GrayIndex:
    """Tree over Gray-sorted fingerprints; a node's fingerprints agree on its mask."""

    def __init__(self, fps: np.ndarray):
        """``fps``: distinct fingerprints in Gray order."""
        self.fps = fps
        self.nodes: list[tuple[int, int, int, int, tuple[int, ...]]] = []
        self.root = self._build(0, len(fps))

    def _build(self, lo: int, hi: int) -> int:
        """Node over [lo, hi): (lo, hi, shared mask, shared pattern, children)."""
        part = self.fps[lo:hi]
        every, some = int(np.bitwise_and.reduce(part)), int(np.bitwise_or.reduce(part))
        mask = ~(every ^ some) & 0xFFFFFFFFFFFFFFFF
        children: tuple[int, ...] = ()
        if hi - lo > LEAF_ROWS:
            # Gray neighbours share high bits: cut where the highest open bit changes
            top = 1 << (~mask & 0xFFFFFFFFFFFFFFFF).bit_length() - 1
            first = int(part[0]) & top
            cut = lo + int(np.argmax((part & np.uint64(top)) != np.uint64(first)))
            children = (self._build(lo, cut), self._build(cut, hi))
        self.nodes.append((lo, hi, mask, every & mask, children))
        return len(self.nodes) - 1

    def link(self, fp: int, i: int, forest: Forest, max_bits: int, after: int, links: list[tuple[int, int]]) -> None:
        """Unite item ``i`` with the indexed items (from number ``after`` on) within ``max_bits`` of ``fp``."""
        pending = [(self.root, 0, 0)]  # node, bits settled above, difference on them
        while pending:
            at, settled, difference = pending.pop()
            lo, hi, mask, pattern, children = self.nodes[at]
            if hi <= after:
                continue
            difference += ((fp ^ pattern) & mask & ~settled).bit_count()
            if difference > max_bits:
                continue  # all of them differ by more
            open_bits = 64 - mask.bit_count()
            if difference + open_bits <= max_bits:
                near = range(max(lo, after), hi)  # all of them are near enough
            elif children:
                pending += [(c, mask, difference) for c in children]
                continue
            else:
                start = max(lo, after)
                apart = np.bitwise_count(self.fps[start:hi] ^ np.uint64(fp))
                near = (start + np.flatnonzero(apart <= max_bits)).tolist()
            for j in near:
                if forest.unite(i, j):
                    links.append((i, j))


def forest_of(fps: np.ndarray, left: int, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of Gray-sorted distinct fingerprints.

    ``left`` > 0: only links between the first ``left`` of them and the others
    (two blocks of a larger group); 0: all links."""
    links: list[tuple[int, int]] = []
    forest = Forest(len(fps))
    index = GrayIndex(fps)
    for i, fp in enumerate(fps[: left or len(fps)].tolist()):
        index.link(fp, i, forest, max_bits, max(left, i + 1), links)
    return links


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, from batches sorted by them."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        at = [rows[k].to_numpy() for k in keys]
        new = np.zeros(max(0, rows.num_rows - 1), bool)
        for values in at:
            new |= values[1:] != values[:-1]
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(starts, starts[1:]):
            yield tuple(v[a] for v in at), rows.slice(a, b - a)
        rest = rows.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield tuple(rest[k][0].as_py() for k in keys), rest


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b: spanning forests, over all groups, of the links between distinct fingerprints ``fp``."""
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(max_bits)])
    dealt = distinct.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseAND(m))).alias("part", "bits"))
    sizes = dealt.groupBy("part", "bits").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > block_rows).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    # few groups are large: written, this side is small, and a skewed key of the other can be split
    large = materialise(large.select("part", "bits", "blocks"), "simhash-large")
    cut = dealt.join(large, ["part", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = cut.withColumn("own", own).withColumn("other", other).select(
        "part", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp")
    keys = ["part", "bits", "low", "high"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for (_, _, low, high), rows in _groups(batches, keys):
            if rows.num_rows == 1:
                continue
            fps = rows["fp"].to_numpy().view(np.uint64)
            if low == high:
                fps, left = fps[np.argsort(gray_rank(fps))], 0
            else:
                in_low = rows["own"].to_numpy() == low
                sides = [side[np.argsort(gray_rank(side))] for side in (fps[in_low], fps[~in_low])]
                fps, left = np.concatenate(sides), len(sides[0])
            signed = fps.view(np.int64)
            found += [(int(signed[i]), int(signed[j])) for i, j in forest_of(fps, left, max_bits)]
            if len(found) > 100_000:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], schema=pair)
                found = []
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], schema=pair)

    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node reachable) of every node of the (a, b) edges but the roots.

    Large-star and small-star steps in turn, each written to the shared folder,
    until a round changes nothing."""
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        signature = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if signature == state or signature[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = signature
        # large star: greater neighbours move to the least of a node's neighbourhood
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.filter("v > u").join(materialise(least, "star"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = materialise(moved.filter("a <> b").distinct(), "edges")
        # small star: a node and its lesser neighbours move to the least of them
        least = moved.groupBy("a").agg(F.min("b").alias("m"))
        joined = moved.join(materialise(least, "star"), "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges = materialise(moved.filter("a <> b").distinct(), "edges")


def groups_of(prints: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, fp, component_id of each (doc_id, fp) row; ``prints`` is written already."""
    first = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(first, max_bits, block_rows))
    linked = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = materialise(linked.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    named = materialise(linked.join(least, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (a NULL id last), with all its columns."""
    row = fresh_name(docs, "row")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-rows")
    # a row is named by its id first, so that the least name of a component has the least id
    name = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    prints = materialise(fingerprints(numbered.select(name.alias("doc_id"), "text"), size), "simhash-prints")
    keepers = groups_of(prints, max_bits).select(F.col("component_id.row").alias(row)).distinct()
    return numbered.join(keepers, row, "left_semi").select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    prints = materialise(fingerprints(table(spark, sf_dir, "documents")), "simhash-prints")
    return groups_of(prints).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
