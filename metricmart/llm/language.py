"""Language ID as multilingual mixture inference.

A text is a mixture of languages. Each language is a distribution over hashed
character trigrams (letters lower-cased, all else a blank). Expectation-
maximisation estimates the mixture proportions of a text from the trigrams'
likelihoods under each language. The set of languages is chosen by penalised
likelihood: languages are ranked by their share in the full mixture, mixtures of
the first 1, 2, ... of them are fitted, and the one with the best likelihood less
``log(n) / 2`` for each further language is taken (each letter is in three
trigrams, so a third of the log likelihood counts). The prediction is the
language with the largest share, the score that share.

Training counts come from all rows of the training fold in one pass: each task
adds up a (languages x buckets) table, and only those tables are shuffled.

Defined results: a NULL text or one without a letter is ``und`` with score 0, as
is every text when no language is learned; ties go to the language first in
code point order; a language of NULL is not learned from; repeated rows count
each; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmart.llm.common import RUN_BYTES, fold_of, runs, table

#: Trigrams are hashed to 2 ** BUCKET_BITS numbers; the model has that many values a language.
BUCKET_BITS = 15
#: The model of at most so many languages goes to the executors; more are refused.
MAX_LANGUAGES = 256
SMOOTHING = 0.5
EM_ROUNDS = 20
#: Rounds end when no share of the run moves by more.
EM_STEP = 1e-3
#: Languages whose share in the full mixture is below this are not tried in a set.
LEAST_SHARE = 0.02
#: Letters in this many trigrams each; their evidence counts once.
OVERLAP = 3
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram that holds a letter, and the number of its text."""
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letters()[codes]
    codes = np.where(letter, codes, 0x20).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
             + codes[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    keep = (letter[:-2] | letter[1:-1] | letter[2:]) & (owner[:-2] == owner[2:])
    return bucket[keep], owner[:-2][keep]


def _pieces(text: str) -> list[str]:
    """A very long text in parts; trigrams over their edges are left to the blank at each edge."""
    return [text[i : i + RUN_BYTES] for i in range(0, len(text), RUN_BYTES)]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n: how often each trigram bucket occurs in a language, for (text, lang) rows without NULLs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for run in runs(batch, "text"):
                langs = run.column("lang").to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs], np.int64)
                parts = [(i, p) for i, t in enumerate(run.column("text").to_pylist()) for p in _pieces(t)]
                for start in range(0, len(parts), 4096):
                    some = parts[start : start + 4096]
                    bucket, owner = trigrams([p for _, p in some])
                    at = number[np.array([i for i, _ in some], np.int64)][owner] if len(owner) else owner
                    table_ = np.bincount((at << BUCKET_BITS) + bucket, minlength=len(names) << BUCKET_BITS)
                    for name, row in zip(names, table_.reshape(len(names), -1)):
                        total[name] = total.get(name, 0) + row
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())],
                names=["lang", "bucket", "n"])

    return docs.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Likelihood of each bucket (rows) under each language (columns, in code point order)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.likelihood = np.ascontiguousarray((smooth / smooth.sum(1, keepdims=True)).T)

    def proportions(self, texts: list[str]) -> np.ndarray:
        """Shares (texts x languages) of the languages in each text's chosen set; zeros without a letter."""
        parts = [(i, p) for i, t in enumerate(texts) for p in _pieces(t)]
        found = [trigrams([p]) if len(p) >= RUN_BYTES else None for _, p in parts]
        short = [k for k, f in enumerate(found) if f is None]
        bucket, owner = trigrams([parts[k][1] for k in short]) if short else (np.zeros(0, np.int64),) * 2
        owner = np.array([parts[k][0] for k in short], np.int64)[owner] if len(owner) else owner
        for k, f in enumerate(found):
            if f is not None:
                bucket, owner = np.append(bucket, f[0]), np.append(owner, np.full(len(f[0]), parts[k][0]))
        # equal trigrams of a text are one observation with a count
        seen, n = np.unique((owner << BUCKET_BITS) + bucket, return_counts=True)
        owner, evidence = seen >> BUCKET_BITS, self.likelihood[seen & ((1 << BUCKET_BITS) - 1)]
        return self._choose(owner, evidence, n.astype(np.float64), len(texts))

    def _choose(self, owner: np.ndarray, evidence: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
        size = len(self.languages)
        total = np.bincount(owner, n, texts)
        full = self._fit(owner, evidence, n, np.repeat(total[:, None] > 0, size, 1) * np.ones(size))[0]
        order = np.argsort(-full, axis=1, kind="stable")
        best, best_value = np.zeros((texts, size)), np.full(texts, -np.inf)
        for k in range(1, size + 1):
            wanted = (total > 0) & (np.take_along_axis(full, order[:, k - 1 : k], 1)[:, 0] >= (LEAST_SHARE if k > 1 else 0))
            if not wanted.any():
                break
            allowed = np.zeros((texts, size))
            np.put_along_axis(allowed, order[:, :k], 1.0, 1)
            rows = wanted[owner]
            share, value = self._fit(owner[rows], evidence[rows], n[rows], allowed * wanted[:, None])
            value = value / OVERLAP - (k - 1) * np.log(np.maximum(total, 1)) / 2
            better = wanted & (value > best_value)
            best[better], best_value[better] = share[better], value[better]
        return best

    @staticmethod
    def _fit(owner: np.ndarray, evidence: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log likelihood of each text's mixture of its allowed languages.

        ``owner`` ascends, so a text's observations are one slice."""
        texts = len(allowed)
        share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
        if not len(owner):
            return share, np.zeros(texts)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        present, place = owner[starts], np.cumsum(np.append(True, owner[1:] != owner[:-1])) - 1
        total = np.add.reduceat(n, starts)[:, None]
        own = share[present]
        for _ in range(EM_ROUNDS if (allowed > 0).sum(1).max() > 1 else 0):
            joint = evidence * own[place]
            joint *= (n / joint.sum(1))[:, None]
            before, own = own, np.add.reduceat(joint, starts, axis=0) / total
            if np.abs(own - before).max() < EM_STEP:
                break
        mixed = np.log((evidence * own[place]).sum(1)) * n
        share[present] = own
        value = np.zeros(texts)
        value[present] = np.add.reduceat(mixed, starts)
        return share, value


def train(docs: DataFrame) -> LanguageModel:
    """The model of all (text, lang) rows; its size is bounded by MAX_LANGUAGES x 2 ** BUCKET_BITS."""
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    names = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    counts = trigram_counts(rows).toArrow()
    at = pc.index_in(counts["lang"], pa.array(names, pa.string())).to_numpy()
    found = np.zeros((len(names), 1 << BUCKET_BITS))
    found[at, counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return LanguageModel(names, found)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, mixture (shares of the chosen languages) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.likelihood))

    def run_model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel.__new__(LanguageModel)
        own.languages, own.likelihood = shared.value
        for batch in batches:
            for run in runs(batch, "text"):
                texts = run.column("text").fill_null("").to_pylist()
                shares = own.proportions(texts) if own.languages else np.zeros((len(texts), 0))
                lang, score, mixture = [], [], []
                for row in shares:
                    at = int(row.argmax()) if len(row) else -1
                    known = at >= 0 and row[at] > 0
                    lang.append(own.languages[at] if known else UNKNOWN)
                    score.append(min(1.0, float(row[at])) if known else 0.0)
                    mixture.append([(own.languages[i], float(row[i])) for i in np.flatnonzero(row)])
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(mixture, pa.map_(pa.string(), pa.float64()))], names=schema.names)

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("lang_pred", T.StringType())
    schema = schema.add("score", T.DoubleType()).add("mixture", T.MapType(T.StringType(), T.DoubleType()))
    return docs.select("doc_id", "text").mapInArrow(run_model, schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and score of every document; learned from the training fold's text and lang only."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4, 2)
    model = train(docs.filter(~held_out).select("text", "lang"))
    out = predict(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "mixture")
