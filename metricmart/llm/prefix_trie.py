"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A turn's id is 16 bytes of the SHA-256 of its role and text, kept beside its
number of words; texts are not shuffled. A conversation's turns, in order, are
cut into blocks of ``WIDTH`` positions, one row a block: the key of the node
that the block before ends at, and turn columns t1 .. tWIDTH (NULL past the
end). One ``GROUP BY block, prior, ROLLUP (t1, ...)`` then gives every prefix of
every conversation at once; grouping_id tells a prefix's length, and a prefix
is a node where its last turn column isn't NULL. A long conversation has
further rows, keyed by the prior block's node, so no length needs another pass.

A node's ``conv_id`` is its smallest member. The smallest member of a node is
also that of each deeper node that it belongs to, so every node's own figure is
laid on its smallest member at that position; sums over subtrees are then sums
over members of what they carry from that position on, in a second ROLLUP.

Only the turns of one conversation (sorted by Spark, read as a stream and never
held together) and the digests of one node (chunks of ids that share all but ``CHUNK_BITS`` bits,
read as a stream) pass through one task in order; counts and sums of hot
prefixes are combined before the shuffle.

Defined results: turns go by ``turn`` (NULL first), ties by role and then by the
turn's id; equal rows are turns of their own; NULL role or text is empty; rows
without a conv_id belong to no conversation and are left out; a text of any
length counts as a whole; conversations without turns are members of the root
alone; an empty table has no node; columns beside the four are not read. A word
is a run of characters other than space and 0x09-0x0D.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmart.llm.common import materialise, table

#: Turn columns of a block.
WIDTH = 8
#: Bytes of a turn's or node's id.
ID_BYTES = 16
#: Ids that are joined to one text before a node's digest, as a power of two.
CHUNK_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"

TURN = "struct<id:binary,words:bigint>"
BLOCK = f"conv_id bigint, block int, prior binary, turns array<{TURN}>, reach int"


def _digest(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, ID_BYTES)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, skip, turn, role, id, words: what ``turn_blocks`` orders; part and skip are 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.lit(0).alias("part"), F.lit(0).alias("skip"), "turn",
        role.alias("role"), _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))


def with_family_heads(turns: DataFrame, family: int, most: int) -> DataFrame:
    """Conversations whose first turns come from their family's first one.

    The family of conversation c starts at b = c - c % ``family``. With h =
    crc32(decimal c) % (``most`` + 1), c gets the first h turns of b (as many as
    there are), then its own turns after its first h."""
    base = F.col("conv_id") - F.col("conv_id") % family
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    rank = "row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, id)"
    heads = (turns.filter(base == F.col("conv_id")).withColumn("at", F.expr(rank)).filter(F.col("at") <= most)
             .withColumnRenamed("conv_id", "base"))
    members = turns.select("conv_id").distinct().select("conv_id", base.alias("base"), taken.alias("taken"))
    given = members.filter("taken > 0").join(heads, "base").filter("at <= taken")
    given = given.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("skip"), "turn", "role", "id", "words")
    own = turns.withColumn("part", F.lit(1)).withColumn("skip", taken)
    return own.unionByName(given)


def turn_blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, prior, turns, reach of each block of each conversation.

    Rows go by part, turn, role and id; the first ``skip`` rows of part 1 are
    passed over. ``reach`` is the number of turns in the block, one more where
    the conversation goes on; one without turns has one block, of none."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        conv, block, prior, held, passed = None, 0, b"", [], 0

        def end(more: bool):
            made.append((conv, block, prior, held, len(held) + more))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for c, part, skip, turn_id, words in zip(*columns, strict=True):
                if c != conv:
                    if conv is not None:
                        end(False)
                    conv, block, prior, held, passed = c, 0, b"", [], 0
                if part and passed < skip:
                    passed += 1
                    continue
                if len(held) == WIDTH:
                    end(True)
                    prior = hashlib.sha256(prior + b"".join(i for i, _ in held)).digest()[:ID_BYTES]
                    block, held = block + 1, []
                held.append((turn_id, words))
            if len(made) >= 4096:
                yield as_batch(made)
                made = []
        if conv is not None:
            end(False)
        if made:
            yield as_batch(made)

    def as_batch(made: list[tuple]) -> pa.RecordBatch:
        convs, blocks, priors, held, reach = zip(*made, strict=True)
        offsets = [0]
        for h in held:
            offsets.append(offsets[-1] + len(h))
        flat = [t for h in held for t in h]
        each = pa.StructArray.from_arrays([pa.array([i for i, _ in flat], pa.binary()),
                                           pa.array([w for _, w in flat], pa.int64())], names=["id", "words"])
        return pa.RecordBatch.from_arrays(
            [pa.array(convs, pa.int64()), pa.array(blocks, pa.int32()), pa.array(priors, pa.binary()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each), pa.array(reach, pa.int32())],
            names=["conv_id", "block", "prior", "turns", "reach"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "id")
    return ordered.select("conv_id", "part", "skip", "id", "words").mapInArrow(cut, BLOCK)


def _positions(blocks: DataFrame) -> DataFrame:
    """The blocks with turn columns t1 .. tWIDTH in place of the list."""
    return blocks.withColumns({f"t{j}": F.get("turns", F.lit(j - 1)) for j in range(1, WIDTH + 1)}).drop("turns")


def rolled_up(positions: DataFrame, aggregates: str) -> DataFrame:
    """block, prior, d, ids, last and the aggregates of each prefix, by one ROLLUP.

    d is the prefix's number of turns in its block, ids those turns' ids, last
    its last turn; the prefix of no turns is given for the first block alone."""
    columns = ", ".join(f"t{j}" for j in range(1, WIDTH + 1))
    at = "CASE d " + " ".join(f"WHEN {j} THEN t{j}" for j in range(1, WIDTH + 1)) + " END"
    return positions.sparkSession.sql(f"""
        SELECT * EXCEPT ({columns}), {at} AS last,
               filter(array({", ".join(f"t{j}.id" for j in range(1, WIDTH + 1))}), i -> i IS NOT NULL) AS ids
        FROM (SELECT block, prior, {columns}, {WIDTH} - bit_count(grouping_id()) AS d, {aggregates}
              FROM {{positions}} GROUP BY block, prior, ROLLUP ({columns}))
        WHERE CASE WHEN d = 0 THEN block = 0 ELSE {at} IS NOT NULL END""", positions=positions)


def _node_id(prior: Column, ids: Column) -> Column:
    joined = F.aggregate(ids, prior, lambda a, i: F.concat(a, i))
    return F.when(F.size(ids) == 0, prior).otherwise(_digest(joined))


def _nodes(positions: DataFrame) -> DataFrame:
    """One row a node: its key, its parent's key, depth, smallest member, members, own saving."""
    found = rolled_up(positions, "count(*) AS n_convs, min(conv_id) AS conv_id, max(reach) AS reach")
    ids = F.col("ids")
    return found.select(
        _node_id(F.col("prior"), ids).alias("node"),
        F.when(F.col("d") > 0, _node_id(F.col("prior"), F.slice(ids, 1, F.greatest(F.col("d") - 1, F.lit(0))))).alias("parent"),
        (F.col("block").cast("bigint") * WIDTH + F.col("d")).alias("depth"), "block", "d", "conv_id", "n_convs",
        F.when(F.col("d") > 0, (F.col("n_convs") - 1) * F.col("last.words")).otherwise(0).alias("own"),
        (F.col("reach") == F.col("d")).cast("int").alias("leaf"))


def _subtree_sums(positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n_leaves, saved_tokens of each node, summed over its members."""
    steps = range(1, WIDTH + 1)
    laid = nodes.groupBy("conv_id", "block").agg(
        F.max("leaf").alias("leaf"), F.sum("own").alias("own"),
        *[F.sum(F.when(F.col("d") == j, F.col("own")).otherwise(0)).alias(f"own{j}") for j in steps])
    held = positions.drop("reach").join(laid, ["conv_id", "block"], "left").fillna(0, ["leaf", "own", *[f"own{j}" for j in steps]])
    after = "OVER (PARTITION BY conv_id ORDER BY block DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    held = held.withColumns({"leaf": F.expr(f"max(leaf) {after}"), "later": F.expr(f"sum(own) {after}") - F.col("own")})
    held = held.filter("leaf > 0 OR later + own > 0").select(
        "block", "prior", *[f"t{j}" for j in steps], "leaf",
        *[(F.col("later") + sum((F.col(f"own{i}") for i in range(j, WIDTH + 1)), F.lit(0))).alias(f"from{j}") for j in steps])
    found = rolled_up(held, "sum(leaf) AS n_leaves, " + ", ".join(f"sum(from{j}) AS from{j}" for j in steps))
    saved = F.expr("CASE d WHEN 0 THEN from1 " + " ".join(f"WHEN {j} THEN from{j}" for j in steps) + " END")
    return found.select(_node_id(F.col("prior"), F.col("ids")).alias("node"), "n_leaves", saved.alias("saved_tokens"))


def _end_digests(blocks: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of the ids of the conversations that end at the node."""
    ends = blocks.filter(F.col("reach") <= WIDTH).select(
        _node_id(F.col("prior"), F.col("turns.id")).alias("node"), "conv_id",
        F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
    chunks = ends.groupBy("node", "chunk").agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is not None and key == node:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield as_batch(out)
            out = []
        if state is not None:
            yield as_batch([(node, state.hexdigest())])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())],
                                          names=["node", "ends_sha256"])

    ordered = chunks.repartition("node").sortWithinPartitions("node", "chunk")
    schema = T.StructType().add("node", T.BinaryType()).add("ends_sha256", T.StringType())
    return ordered.select("node", "ids").mapInArrow(digests, schema)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie of ``turns`` (the form of ``numbered_turns``).

    node and parent (keys), conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (words that sharing a subtree's turns saves), ends_sha256."""
    blocks = materialise(turn_blocks(turns), "trie-blocks")
    positions = _positions(blocks)
    nodes = materialise(_nodes(positions), "trie-nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(children, "node", "left").join(_subtree_sums(positions, nodes), "node", "left")
            .join(_end_digests(blocks), "node", "left").join(parents, "parent", "left")
            .select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs",
                    F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
                    F.coalesce("n_leaves", F.lit(0).cast("bigint")).alias("n_leaves"),
                    F.coalesce("saved_tokens", F.lit(0).cast("bigint")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations, without its keys."""
    turns = with_family_heads(numbered_turns(table(spark, sf_dir, "conversations")), family=20, most=3)
    return prefix_trie(turns).drop("node", "parent")


#: crc32 by bits (DuckDB has none): 3988292384 is the reflected polynomial, 255 is added to mark a byte.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS pos
  FROM t),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT + 255, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x - 255) ELSE xor(a >> 1, 3988292384 * (a & 1)) END),
             4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
parts AS (
  SELECT c.conv_id, 0 AS part, r.pos, r.role, r.text FROM convs c JOIN ranked r ON r.conv_id = c.base AND r.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, r.pos, r.role, r.text FROM convs c JOIN ranked r ON r.conv_id = c.conv_id AND r.pos > c.h),
placed AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM parts),
chained AS (
  SELECT conv_id, d, text, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY d) AS path
  FROM placed
  UNION ALL SELECT conv_id, 0, '', [] FROM convs),
lengths AS (SELECT conv_id, max(d) AS len FROM chained GROUP BY conv_id),
nodes AS (
  SELECT path, d AS depth, min(c.conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(min(text), '[^\x20\x09-\x0D]+')) ELSE 0 END AS own,
         sha256(coalesce(string_agg(c.conv_id::VARCHAR, ',' ORDER BY c.conv_id) FILTER (WHERE l.len = d), '')) AS ends_sha256
  FROM chained c JOIN lengths l ON l.conv_id = c.conv_id GROUP BY path, d),
kids AS (SELECT path[:-2] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT u.path, sum(v.own) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM (SELECT path, own, unnest(list_transform(range(len(path) + 1), lambda i: path[:i])) AS above FROM nodes) v
  JOIN nodes u ON u.path = v.above LEFT JOIN kids k ON k.path = v.path GROUP BY u.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path LEFT JOIN kids k ON k.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:-2]
"""
