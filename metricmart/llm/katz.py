"""Language-model scores by Katz backoff over word bigrams.

Counts are Good-Turing discounted: a count r up to ``CUTOFF`` becomes
``r* = r d_r`` with Katz's ratio of the numbers of bigrams (or words) seen r and
r + 1 times; larger counts stay. With C the count of the word before (h),

    P(w | h) = r*(hw) / (C(h) + 1)    if hw was seen in training
             = a(h) P(w)              otherwise, and P(w) if h was never seen

and a(h) = (1 - sum of r*(hw) / (C(h) + 1)) / (1 - sum of P(w)), both sums over
the words seen after h, so that every P(. | h) sums to one over the training
words, the end and one unknown word. One more than the count in the denominator
leaves mass even where all counts are above the cutoff. P(w) = r*(w) / (N + 1)
likewise, and the rest of it is the unknown word's.

The corpus is dealt into packs of documents by a hash. Each pack sends its
distinct words to partitions by word and gets their corpus counts back, then
sends its distinct bigrams to partitions by the word before and gets their
counts and that word's sums back, and so scores each token of its documents. So a
word or a bigram, however frequent, is one entry a pack, and a frequent word
before is spread over several partitions by the word after it. Word ids are dense
numbers, ascending as counts fall, so the arrays that are shuffled compress well.

Defined results: NULL and empty texts have only the end token; words unseen in
training are the unknown word; with no training text every score is 0; repeated
rows are counted and scored each; a row with a NULL id is a training row; if
Good-Turing ratios aren't between 0 and 1 (small corpora), r* = r - 1/2 up to the
cutoff; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmart.llm.common import byte_values, fold_of, materialise, runs, table

#: Counts up to this are discounted.
CUTOFF = 5
#: Text bytes of a pack, on average; a pack is handled in one task.
PACK_BYTES = 8 << 20
#: Packs for each partition of the word and bigram tables.
PACKS_PER_PART = 1
#: A word before with more than this share of a partition's tokens is spread by the word after it.
SPREAD = 0.25
EDGE, UNKNOWN, FIRST_ID = 0, 1, 2


# ---- discounts ----------------------------------------------------------------------------------

def discounted(n: np.ndarray) -> np.ndarray:
    """r* of r = 0..CUTOFF, from ``n``: how many are seen 0 (unused), 1, ... CUTOFF + 1 times."""
    r = np.arange(1, CUTOFF + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
        ratio = ((r + 1) * n[2:] / (r * n[1:-1]) - common) / (1 - common)
    valid = np.isfinite(ratio).all() and (ratio > 0).all() and (ratio < 1).all()
    return np.append(0.0, r * ratio if valid else r - 0.5)


def star(counts: np.ndarray, table_: np.ndarray) -> np.ndarray:
    return np.where(counts <= CUTOFF, table_[np.minimum(counts, CUTOFF)], counts)


class Unigrams:
    """Training totals and the distribution of single words."""

    def __init__(self, documents: int, word_tokens: int, words: int, seen: np.ndarray):
        """``seen``: how many words (the end not among them) occur 0 (unused), 1, ... CUTOFF + 1 times."""
        self.documents = documents
        self.tokens = word_tokens + documents  # each text's end is a token
        self.types = words + (documents > 0)
        n = seen.astype(np.int64).copy()
        if 0 < documents <= CUTOFF + 1:
            n[documents] += 1
        self.table = discounted(n)
        r = np.arange(CUTOFF + 1)
        kept = self.tokens - (r * n[:-1]).sum() + (self.table * n[:-1])[1:].sum()
        self.unknown = 1 - kept / (self.tokens + 1)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, star(counts, self.table) / (self.tokens + 1), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


# ---- packed arrays ------------------------------------------------------------------------------

def squeezed(values: np.ndarray) -> bytes:
    """Differences of 64-bit integers, bytes of equal weight together, compressed."""
    steps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=3).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def expanded(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel())


class Pack:
    """The tokens of a group of documents, by local word numbers in order of their parts.

    The documents are put in order first, so a pack that is built again has the same numbers."""

    def __init__(self, rows: pa.Table, parts: int):
        docs = sorted(zip(rows["packed"].to_pylist(), rows["held_out"].to_pylist(), range(rows.num_rows)), key=lambda d: d[:2])
        self.doc_ids = rows["doc_id"].take(pa.array([k for _, _, k in docs], pa.int64()))
        self.held_out = np.array([h for _, h, _ in docs], bool)
        number: dict[bytes, int] = {}
        ids, unpack = [], zstandard.ZstdDecompressor()
        for data, _, _ in docs:
            ids.append(np.array([number.setdefault(w, len(number)) for w in unpack.decompress(data).split()], np.int64))
        self.lengths = np.array([len(i) for i in ids])
        words = list(number)
        part = np.array([zlib.crc32(w) % parts for w in words], np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words, self.part = [words[i] for i in order], part[order]
        self.tokens = place[np.concatenate(ids)] if number else np.zeros(0, np.int64)
        self.training = np.repeat(~self.held_out, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.training], minlength=len(self.words))

    def with_counts(self, ids: np.ndarray, counts: np.ndarray, uni: Unigrams) -> None:
        """Corpus ids and counts of the words; builds (before, word) of every token, ends included."""
        ends = np.cumsum(self.lengths + 1) - 1
        self.starts = ends - self.lengths
        # words by their place among the pack's ids; the text's edge is one of them
        names, place = np.unique(np.append(ids, EDGE), return_inverse=True)
        self.name_count = np.zeros(len(names), np.int64)
        self.name_count[place] = np.append(counts, uni.documents)
        self.name = np.full(len(self.tokens) + len(self.lengths), place[-1])
        at = np.ones(len(self.name), bool)
        at[ends] = False
        self.name[at] = place[self.tokens]
        before = np.roll(self.name, 1)
        before[self.starts] = place[-1]
        self.known = self.name_count[before] > 0  # the word before was seen in training
        # distinct (before, word), in order of ids
        pairs, self.pair = np.unique(before[self.known] * len(names) + self.name[self.known], return_inverse=True)
        first, second = pairs // len(names), pairs % len(names)
        self.pair_before, self.pair_word = names[first], names[second]
        self.pair_before_count, self.pair_count = self.name_count[first], self.name_count[second]
        in_training = np.repeat(~self.held_out, self.lengths + 1)[self.known]
        self.pair_training = np.bincount(self.pair, in_training, len(pairs)).astype(np.int64)

    def message(self, parts: int, uni: Unigrams) -> tuple[np.ndarray, ...]:
        """What goes to the bigram partitions, in order of these: part, before, word, training count, word's count,
        and the number of the pair. A word before that is spread asks each of its partitions for its sums, by an
        entry without a pair (-1), as its unseen pairs need them all."""
        spread = np.ceil(self.pair_before_count * parts / max(1.0, SPREAD * uni.tokens)).astype(np.int64)
        spread = np.clip(spread, 1, parts)
        salt = (_mixed(self.pair_word) % spread.astype(np.uint64)).astype(np.int64)
        heads = np.flatnonzero(np.append(True, self.pair_before[1:] != self.pair_before[:-1])) if len(spread) else np.zeros(0, np.int64)
        heads = heads[spread[heads] > 1]
        asks = np.repeat(heads, spread[heads])
        ask_salt = np.arange(len(asks)) - np.repeat(np.cumsum(spread[heads]) - spread[heads], spread[heads])
        before = np.append(self.pair_before, self.pair_before[asks])
        part = (_mixed(before * 1_000_003 + np.append(salt, ask_salt)) % np.uint64(parts)).astype(np.int64)
        none = np.zeros(len(asks), np.int64)
        columns = (part, before, np.append(self.pair_word, none - 1), np.append(self.pair_training, none),
                   np.append(self.pair_count, none), np.append(np.arange(len(self.pair_word)), none - 1))
        order = np.argsort(part, kind="stable")
        return tuple(c[order] for c in columns)


def _mixed(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


# ---- Spark jobs ---------------------------------------------------------------------------------

#: What packs and partitions send each other: four packed columns, and counts of counts from partitions.
MESSAGE = "pack int, part int, kind int, a binary, b binary, c binary, d binary, stats array<bigint>"
_ARROW = pa.schema([("pack", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "abcd"], ("stats", pa.list_(pa.int64()))])
WORDS, PAIRS = 1, 2


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in _ARROW]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _slices(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, start, end) of an ascending array's runs."""
    if not len(part):
        return []
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return list(zip(part[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)]))


def packs(docs: DataFrame, held_out: Column, n: int) -> DataFrame:
    """pack, doc_id, held_out, packed: lower-cased texts, compressed as they are shuffled several times."""
    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for run in runs(batch, "text"):
                data = [squeeze.compress(t.lower()) for t in byte_values(run.column("text"))]  # bytes: A-Z only
                yield pa.RecordBatch.from_arrays([run.column("pack"), run.column("doc_id"), run.column("held_out"), pa.array(data, pa.binary())], names=schema.names)

    rows = docs.select("doc_id", "text").withColumn("held_out", held_out).withColumn(
        "pack", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    schema = T.StructType().add("pack", T.IntegerType()).add("doc_id", docs.schema["doc_id"].dataType)
    schema = schema.add("held_out", T.BooleanType()).add("packed", T.BinaryType())
    return rows.select("pack", "doc_id", "held_out", "text").mapInArrow(pack, schema)


def _send_words(packed: DataFrame, parts: int) -> DataFrame:
    def send(rows: pa.Table) -> pa.Table:
        pack, own = rows["pack"][0].as_py(), Pack(rows, parts)
        counts, squeeze = own.word_counts(), zstandard.ZstdCompressor(level=3)
        return _table([(pack, part, WORDS, squeeze.compress(b"\n".join(own.words[a:b])), squeezed(counts[a:b]), None, None, None)
                       for part, a, b in _slices(own.part)])

    return packed.groupBy("pack").applyInArrow(send, MESSAGE)


def _count_words(sent: DataFrame, parts: int) -> DataFrame:
    """Back to each pack: ids and corpus counts of its words; pack -1: words seen 0 (unused), 1, ... times, words, tokens."""
    def count(rows: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        unpack, places, counts = zstandard.ZstdDecompressor(), [], []
        for a, b in zip(rows["a"].to_pylist(), rows["b"].to_pylist()):
            places.append(np.array([number.setdefault(w, len(number)) for w in unpack.decompress(a).split(b"\n")], np.int64))
            counts.append(expanded(b))
        total = np.bincount(np.concatenate(places), np.concatenate(counts), len(number)).astype(np.int64)
        part = rows["part"][0].as_py()
        order = np.argsort(-total, kind="stable")
        ids = np.empty(len(number), np.int64)
        ids[order] = FIRST_ID + part + np.arange(len(number)) * parts
        ids[total == 0] = UNKNOWN
        out = [(pack, part, WORDS, squeezed(ids[p]), squeezed(total[p]), None, None, None) for pack, p in zip(rows["pack"].to_pylist(), places)]
        few = np.bincount(total[total <= CUTOFF + 1], minlength=CUTOFF + 2).tolist()
        return _table([*out, (-1, part, WORDS, None, None, None, None, [*few, int((total > 0).sum()), int(total.sum())])])

    return sent.groupBy("part").applyInArrow(count, MESSAGE)


def _counted(rows: pa.Table, replies: pa.Table, parts: int, uni: Unigrams) -> Pack:
    own = Pack(rows, parts)
    words = replies.filter(pc.equal(replies["kind"], WORDS)).sort_by("part")
    ids = [expanded(x) for x in words["a"].to_pylist()]
    counts = [expanded(x) for x in words["b"].to_pylist()]
    empty = [np.zeros(0, np.int64)]
    own.with_counts(np.concatenate(ids or empty), np.concatenate(counts or empty), uni)
    return own


def _send_pairs(packed: DataFrame, replies: DataFrame, parts: int, uni: Unigrams) -> DataFrame:
    def send(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table([])
        pack, own = rows["pack"][0].as_py(), _counted(rows, answers, parts, uni)
        part, *columns, _ = own.message(parts, uni)
        return _table([(pack, p, PAIRS, *[squeezed(c[a:b]) for c in columns], None) for p, a, b in _slices(part)])

    return packed.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(send, MESSAGE)


def _count_pairs(sent: DataFrame, uni: Unigrams) -> DataFrame:
    """Back to each pack: corpus counts of its pairs, and for each word before that has an unseen pair there: how
    many follow it 1, 2, ... CUTOFF times, the sum of larger counts, and the sum of P of all that follow it."""
    def count(rows: pa.Table) -> pa.Table:
        columns = [[expanded(x) for x in rows[c].to_pylist()] for c in "abcd"]
        ends = np.cumsum([len(x) for x in columns[0]])
        before, word, training, unigram = (np.concatenate(c) for c in columns)
        order = np.lexsort((word, before))
        b, w = before[order], word[order]
        new = np.append(True, (b[1:] != b[:-1]) | (w[1:] != w[:-1]))
        kind = np.cumsum(new) - 1
        r = np.bincount(kind, training[order]).astype(np.int64)
        kind_before, p = b[new], uni.p(unigram[order][new])
        counts = np.empty(len(order), np.int64)
        counts[order] = r[kind]
        # sums over what follows each word
        opens = np.append(True, kind_before[1:] != kind_before[:-1])
        owner, heads = np.cumsum(opens) - 1, kind_before[opens]
        seen = r > 0
        follow = [np.bincount(owner, r == k, len(heads)) for k in range(1, CUTOFF + 1)]
        sums = np.stack([*follow, np.bincount(owner, np.where(r > CUTOFF, r, 0), len(heads)), np.bincount(owner, np.where(seen, p, 0), len(heads))], 1)
        out, part = [], rows["part"][0].as_py()
        for pack, start, end in zip(rows["pack"].to_pylist(), [0, *ends.tolist()], ends.tolist()):
            mine = np.unique(before[start:end][counts[start:end] == 0])
            at = np.searchsorted(heads, mine)
            out.append((pack, part, PAIRS, squeezed(counts[start:end]), None, None, None, None))
            if len(mine):
                out.append((pack, part, PAIRS + 1, squeezed(mine), zstandard.ZstdCompressor(level=3).compress(sums[at].tobytes()), None, None, None))
        few = np.bincount(r[seen & (r <= CUTOFF + 1)], minlength=CUTOFF + 2).tolist()
        return _table([*out, (-1, part, PAIRS, None, None, None, None, few)])

    return sent.groupBy("part").applyInArrow(count, MESSAGE)


def _score(packed: DataFrame, replies: DataFrame, parts: int, uni: Unigrams, bigram: np.ndarray, id_type: T.DataType) -> DataFrame:
    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], f.type) for f in arrow], schema=arrow)
        own = _counted(rows, answers, parts, uni)
        sent = own.message(parts, uni)[-1]
        got = answers.filter(pc.equal(answers["kind"], PAIRS)).sort_by("part")
        r = np.empty(len(own.pair_word), np.int64)
        if len(r):
            r[sent[sent >= 0]] = np.concatenate([expanded(x) for x in got["a"].to_pylist()])[sent >= 0]
        # a word before that is spread has sums in several partitions
        more = answers.filter(pc.equal(answers["kind"], PAIRS + 1))
        heads = [expanded(x) for x in more["a"].to_pylist()]
        sums = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.float64).reshape(-1, CUTOFF + 2) for x in more["b"].to_pylist()]
        log_p = np.log10(uni.p(own.name_count))[own.name]
        value = log_p.copy()
        if len(r):
            total = own.pair_before_count + 1
            seen = np.log10(np.where(r > 0, star(r, bigram), 1) / total)
            weight = np.zeros(len(r))
            unseen = np.flatnonzero(r == 0)
            if len(unseen):
                names, place = np.unique(np.concatenate(heads), return_inverse=True)
                held = np.zeros((len(names), CUTOFF + 2))
                np.add.at(held, place, np.concatenate(sums))
                h = held[np.searchsorted(names, own.pair_before[unseen])]
                left = 1 - (h[:, :CUTOFF] @ bigram[1:] + h[:, CUTOFF]) / total[unseen]
                weight[unseen] = np.log10(left / (1 - h[:, CUTOFF + 1]))
            value[own.known] = np.where(r > 0, seen, weight)[own.pair] + np.where((r > 0)[own.pair], 0, log_p[own.known])
        add = lambda x: np.add.reduceat(x, own.starts)  # noqa: E731  every document has its end
        n = len(own.lengths)
        columns = [own.doc_ids, own.held_out, own.lengths + 1, add((own.name_count > 0).astype(np.int64)[own.name]), np.full(n, uni.tokens),
                   add(uni.base(own.name_count)[own.name]), add(value)]
        return pa.table([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType().add("doc_id", id_type).add("held_out", T.BooleanType())
    for c in ("n_tokens", "n_known", "train_tokens"):
        schema = schema.add(c, T.LongType())
    schema = schema.add("base_score", T.DoubleType()).add("score", T.DoubleType())
    arrow = to_arrow_schema(schema)
    return packed.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(score, schema)


def score_texts(docs: DataFrame, held_out: Column, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows not held out."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.when(~held_out, 1)).alias("documents")).first()
    n = 1 + (size.bytes or 0) // pack_bytes
    parts = 1 + n // PACKS_PER_PART
    packed = packs(docs, held_out, n)

    def stats(messages: DataFrame, width: int) -> np.ndarray:
        sums = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(width)]
        return np.array([x or 0 for x in messages.filter("pack = -1").agg(*sums).first()], np.int64)

    words = materialise(_count_words(_send_words(packed, parts), parts), "katz-words")
    found = stats(words, CUTOFF + 4)
    uni = Unigrams(size.documents, int(found[-1]), int(found[-2]), found[: CUTOFF + 2])
    word_replies = words.filter("pack >= 0")
    pairs = materialise(_count_pairs(_send_pairs(packed, word_replies, parts, uni), uni), "katz-pairs")
    bigram = discounted(stats(pairs, CUTOFF + 2))
    replies = word_replies.unionByName(pairs.filter("pack >= 0"))
    return _score(packed, replies, parts, uni, bigram, docs.schema["doc_id"].dataType)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; learned from those whose crc32(doc_id) mod 5 is not 1."""
    return score_texts(table(spark, sf_dir, "documents"), fold_of("doc_id", 5, 1))
