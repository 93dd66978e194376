"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word enters as a hashed word embedding plus the mean of its hashed character
trigram embeddings. Two gated recurrent layers read a window of words from both
ends, attention weighs their states, and a logistic unit scores the window. All
overlapping windows of a text are scored; its score is the highest of them.

Training is plain numpy on the driver over a bounded sample of labelled rows: of
each label the ``TRAIN_ROWS`` rows with the least hash of their id, and of each
text at most ``TRAIN_WINDOWS`` evenly spaced windows. Toxic texts teach with all
their windows in the first round and with their highest window after it, other
texts always with all of them. Scoring covers every window of every row.

Defined results: a NULL or empty text is one window without words and scores as
such; ties and repeated rows get equal scores; without labelled rows of both
kinds every score is the share of label 1 among them (0 without any); an empty
table gives an empty result; labels, lang, source and doc_id never enter a
score; NULL labels teach nothing; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmart.llm.common import fold_of, runs, table

WINDOW, STRIDE = 32, 24
HIDDEN, ATTENTION, DIM = 8, 8, 12
WORD_BITS, CHAR_BITS = 18, 13
#: Bounds of the training sample: rows of each label, and windows of each text.
TRAIN_ROWS, TRAIN_WINDOWS = 1000, 16
ROUNDS, BATCH, RATE = 4, 128, 0.02
TOXIC_SCORE = 0.3
#: Distinct words whose input projections a Python worker keeps; then the table starts anew.
CACHE_WORDS = 300_000
#: Windows that are scored at once.
SCORE_WINDOWS = 8192
EDGE_SIGNS = ".,;:!?\"'()[]{}*#%&$|<>~`-_=+/\\"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word (without case and signs at its edges), buckets of its character
    trigrams (of UTF-8 bytes, the word between ^ and $) in one flat array, and how many it has."""
    plain = [w.lower().strip(EDGE_SIGNS).encode("utf-8", "surrogatepass") for w in words]
    buckets = np.fromiter(map(zlib.crc32, plain), np.int64, len(plain)) & (1 << WORD_BITS) - 1
    sizes = np.maximum(np.fromiter(map(len, plain), np.int64, len(plain)), 1)
    # an empty word is ^ and $ with a blank between them
    codes = np.frombuffer(b"".join([b"^" + (p or b" ") + b"$" for p in plain]), np.uint8).astype(np.uint32)
    mixed = (codes[:-2] | codes[1:-1] << 8 | codes[2:] << 16) * np.uint32(2654435761)
    inside = np.ones(len(codes), bool)
    ends = np.cumsum(sizes + 2)
    inside[ends - 1] = inside[ends - 2] = False
    return buckets, (mixed >> np.uint32(32 - CHAR_BITS))[inside[:-2]].astype(np.int64), sizes


def windows(n_words: int) -> list[int]:
    """Starts of the overlapping windows that cover a text."""
    return list(range(0, max(1, n_words - (WINDOW - STRIDE)), STRIDE))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _sums(bucket: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets, and the sum of the rows of ``values`` in each."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return bucket[starts], np.add.reduceat(values[order], starts)


class Network:
    """Weights; words are rows of feature tables, windows are rows of word numbers (-1: none)."""

    DENSE = ("Wx", "U", "b", "bn", "A", "a", "v", "w", "c")

    def __init__(self, seed: int = 7, dtype=np.float32):
        rnd = np.random.default_rng(seed)
        draw = lambda *shape: (rnd.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(dtype)
        self.word = np.zeros((1 << WORD_BITS, DIM), dtype)  # words never trained on add nothing
        self.char = (rnd.standard_normal((1 << CHAR_BITS, DIM)) * 0.1).astype(dtype)
        self.Wx, self.U = draw(2, DIM, 3 * HIDDEN), draw(2, HIDDEN, 3 * HIDDEN)
        self.b, self.bn = np.zeros((2, 1, 3 * HIDDEN), dtype), np.zeros((2, 1, HIDDEN), dtype)
        self.A, self.a, self.v = draw(2 * HIDDEN, ATTENTION), np.zeros(ATTENTION, dtype), draw(ATTENTION)
        self.w, self.c = draw(2 * HIDDEN), np.full(1, -1, dtype)

    def inputs(self, words: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Feature vectors of distinct words: word bucket, and trigram buckets in one flat array."""
        starts = np.cumsum(sizes) - sizes
        return self.word[words] + np.add.reduceat(self.char[grams], starts) / sizes[:, None].astype(self.char.dtype)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs (words x 2 directions x 3 gates) of feature vectors."""
        return np.ascontiguousarray((x @ self.Wx + self.b).transpose(1, 0, 2))

    def forward(self, gates: np.ndarray, index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logit of each window. ``keep`` collects what the backward pass needs."""
        n, steps = index.shape
        there = index >= 0
        h = np.zeros((2, n, HIDDEN), gates.dtype)
        states = np.zeros((steps, n, 2 * HIDDEN), gates.dtype)
        trace = []
        for t in range(steps):
            at = (t, steps - 1 - t)
            on = np.stack([there[:, p] for p in at])[:, :, None]
            x = np.stack([gates[index[:, p], d] for d, p in enumerate(at)])
            hu = h @ self.U
            zr = _sigmoid(x[..., : 2 * HIDDEN] + hu[..., : 2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            m = hu[..., 2 * HIDDEN :] + self.bn
            new = np.tanh(x[..., 2 * HIDDEN :] + r * m)
            before, h = h, np.where(on, h + z * (new - h), h)
            states[at[0], :, :HIDDEN], states[at[1], :, HIDDEN:] = h[0], h[1]
            if keep is not None:
                trace.append((on, z, r, m, new, before))
        looked = np.tanh(states @ self.A + self.a)
        energy = np.where(there.T, looked @ self.v, -1e9)
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        if keep is not None:
            keep += [trace, states, looked, weight, pooled, there]
        return pooled @ self.w + self.c[0]

    def backward(self, gates: np.ndarray, index: np.ndarray, kept: list, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense weights but Wx and b, and of the gate inputs of each word."""
        trace, states, looked, weight, pooled, there = kept
        steps = index.shape[1]
        g = {"w": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.w
        d_weight = (states * d_pooled).sum(2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(0)) * there.T
        d_looked = d_energy[:, :, None] * self.v * (1 - looked**2)
        g["v"] = (d_energy[:, :, None] * looked).sum((0, 1))
        g["A"], g["a"] = np.einsum("tbi,tbj->ij", states, d_looked), d_looked.sum((0, 1))
        d_states = weight[:, :, None] * d_pooled + d_looked @ self.A.T
        d_inputs = np.zeros((2, steps, len(index), 3 * HIDDEN), gates.dtype)
        g["U"], g["bn"] = np.zeros_like(self.U), np.zeros_like(self.bn)
        d_h = np.zeros((2, len(index), HIDDEN), gates.dtype)
        for t in reversed(range(steps)):
            on, z, r, m, new, before = trace[t]
            at = (t, steps - 1 - t)
            d_h = d_h + np.stack([d_states[at[0], :, :HIDDEN], d_states[at[1], :, HIDDEN:]])
            d_next = d_h * on
            d_new = d_next * z * (1 - new**2)
            d_z, d_r, d_m = d_next * (new - before) * z * (1 - z), d_new * m * r * (1 - r), d_new * r
            d_hu = np.concatenate([d_z, d_r, d_m], 2)
            g["U"] += before.transpose(0, 2, 1) @ d_hu
            g["bn"] += d_m.sum(1, keepdims=True)
            d_h = d_h * ~on + d_next * (1 - z) + d_hu @ self.U.transpose(0, 2, 1)
            for d, p in enumerate(at):
                d_inputs[d, p] = np.concatenate([d_z[d], d_r[d], d_new[d]], 1)
        d_gates = np.zeros_like(gates)
        for d in (0, 1):
            if there.any():
                at, total = _sums(index.T[there.T], d_inputs[d][there.T])
                d_gates[at, d] = total
        return g, d_gates


class Vocabulary:
    """Numbers for the words of windows, and their features."""

    def __init__(self, texts: list[list[str]]):
        number: dict[str, int] = {}
        self.index = np.full((len(texts), WINDOW), -1, np.int64)
        for i, words in enumerate(texts):
            self.index[i, : len(words)] = [number.setdefault(w, len(number)) for w in words]
        self.words, self.grams, self.sizes = word_features(list(number))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def features(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[numbers] - (np.cumsum(sizes) - sizes), sizes)
        return self.words[numbers], self.grams[at], sizes


def fit(texts: list[list[list[str]]], labels: list[int], seed: int = 7) -> Network:
    """Train on texts given as lists of windows of words."""
    net, rnd = Network(seed), np.random.default_rng(seed)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    words = Vocabulary([w for t in texts for w in t])
    index = words.index
    target = np.array(labels, np.float32)[owner]
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in net.DENSE}
    sums = {"word": np.full(len(net.word), 1e-6, np.float32), "char": np.full(len(net.char), 1e-6, np.float32)}
    step = 0
    for done in range(ROUNDS):
        used = np.arange(len(index))
        if done:  # of a toxic text, the window that is likeliest so far
            score = np.concatenate([_logits(net, words, index[i : i + SCORE_WINDOWS]) for i in range(0, len(index), SCORE_WINDOWS)])
            order = np.lexsort((-score, owner))
            best = order[np.append(True, owner[order][1:] != owner[order][:-1])]
            used = np.concatenate([used[target == 0], best[target[best] == 1]])
        share = target[used].mean()
        balance = np.where(target[used] == 1, min(3.0, (1 - share) / share), 1).astype(np.float32)
        for part in np.array_split(rnd.permutation(len(used)), max(1, len(used) // BATCH)):
            step += 1
            rows, weight = used[part], balance[part]
            seen, local = np.unique(index[rows], return_inverse=True)
            local = local.reshape(index[rows].shape) - int(seen[0] < 0)
            seen = seen[seen >= 0]
            if not len(seen):
                continue
            word, gram, size = words.features(seen)
            x = net.inputs(word, gram, size)
            gates, kept = net.project(x), []
            d_logit = ((_sigmoid(net.forward(gates, local, kept)) - target[rows]) * weight / weight.sum()).astype(np.float32)
            grads, d_gates = net.backward(gates, local, kept, d_logit)
            both = d_gates.transpose(1, 0, 2)
            grads["Wx"], grads["b"] = x.T @ both, both.sum(1, keepdims=True)
            d_x = (both @ net.Wx.transpose(0, 2, 1)).sum(0)
            for k, grad in grads.items():
                first, second = moments[k]
                first += 0.1 * (grad - first)
                second += 0.01 * (grad**2 - second)
                fixed = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
                getattr(net, k)[...] -= RATE * 0.5 * fixed
            for k, bucket, grad in (("word", word, d_x), ("char", gram, np.repeat(d_x / size[:, None], size, 0))):
                at, total = _sums(bucket, grad)
                sums[k][at] += (total**2).mean(1)
                getattr(net, k)[at] -= RATE * 2 * total / np.sqrt(sums[k][at])[:, None]
    return net


def _logits(net: Network, words: Vocabulary, index: np.ndarray) -> np.ndarray:
    seen, local = np.unique(index, return_inverse=True)
    local = local.reshape(index.shape) - int(seen[0] < 0)
    seen = seen[seen >= 0]
    gates = net.project(net.inputs(*words.features(seen))) if len(seen) else np.zeros((1, 2, 3 * HIDDEN), np.float32)
    return net.forward(gates, local)


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[list[list[str]]], list[int]]:
    """Windows of words and labels of a bounded sample: ``rows`` rows of each label."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    texts, targets = [], []
    for label in (0, 1):
        ids = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).distinct()
        # at most ``rows`` ids are broadcast, and as many rows of windows come back
        found = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id").mapInArrow(
            _sample_windows, "doc_id bigint, windows array<string>").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
        some = [[w.split() for w in r.windows] for r in found]
        texts += some
        targets += [label] * len(some)
    return texts, targets


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").fill_null("").to_pylist():
            words = text.split()
            starts = windows(len(words))
            if len(starts) > TRAIN_WINDOWS:
                starts = [starts[i * len(starts) // TRAIN_WINDOWS] for i in range(TRAIN_WINDOWS)]
            out.append([" ".join(words[s : s + WINDOW]) for s in starts])
        ids = batch.column("doc_id").cast(pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.string()))], names=["doc_id", "windows"])


class Scorer:
    """Scores texts; keeps the gate inputs of words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self.number: dict[str, int] = {}
        self.gates = np.zeros((1024, 2, 3 * HIDDEN), np.float32)

    def _numbers(self, words: list[str]) -> list[int]:
        number = self.number
        new = list(set(words).difference(number))
        if new:
            if len(number) + len(new) > CACHE_WORDS and number:
                number.clear()
                return self._numbers(words)
            start, stop = len(number), len(number) + len(new)
            if stop > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros((max(stop, 2 * len(self.gates)) - len(self.gates), *self.gates.shape[1:]), np.float32)])
            for i in range(0, len(new), 4096):
                some = new[i : i + 4096]
                self.gates[start + i : start + i + len(some)] = self.net.project(self.net.inputs(*word_features(some)))
            number.update(zip(new, range(start, stop)))
        return list(map(number.__getitem__, words))

    def scores(self, texts: list[str]) -> list[float]:
        split = [t.split() for t in texts]
        counts = np.array([len(w) for w in split])
        flat = np.array([*self._numbers([w for words in split for w in words]), *[-1] * WINDOW], np.int64)
        begin = np.cumsum(counts) - counts
        starts = [windows(n) for n in counts.tolist()]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        start = np.array([s for some in starts for s in some])
        best = np.full(len(texts), -np.inf)
        for i in range(0, len(start), SCORE_WINDOWS):
            rows, own = start[i : i + SCORE_WINDOWS], owner[i : i + SCORE_WINDOWS]
            place = rows[:, None] + np.arange(WINDOW)
            index = np.where(place < counts[own][:, None], flat[np.minimum(begin[own][:, None] + place, len(flat) - 1)], -1)
            np.maximum.at(best, own, self.net.forward(self.gates, index).astype(np.float64))
        return _sigmoid(best).tolist()


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, score of each row, by a network or a constant."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scorer = None if isinstance(own, float) else Scorer(own)
        for batch in batches:
            for run in runs(batch, "text"):
                texts = run.column("text").fill_null("").to_pylist()
                values = scorer.scores(texts) if scorer else [own] * len(texts)
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("score", T.DoubleType())
    return docs.select("doc_id", "text").mapInArrow(run_texts, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network | float:
    texts, targets = training_sample(docs, labels, rows)
    if len(set(targets)) < 2:
        return float(np.mean(targets)) if targets else 0.0
    return fit(texts, targets)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels are learned from the training fold only."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~fold_of("doc_id", 4, 2)))
    return score(docs, model).select(
        "doc_id", fold_of("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))
