import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricmart.llm import toxicity as X


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(X, "WORD_BITS", 6)
    monkeypatch.setattr(X, "CHAR_BITS", 5)


def test_gradients_against_differences(small):
    rnd = np.random.default_rng(0)
    net = X.Network(1, np.float64)
    words = X.Vocabulary([["ab", "cd", "ef"], ["xx", "ab"], [], ["q"] * X.WINDOW])
    net.word += rnd.standard_normal(net.word.shape)
    for k in ("b", "bn", "a"):
        getattr(net, k)[...] = rnd.standard_normal(getattr(net, k).shape)
    gates = net.project(net.inputs(*words.features(np.arange(len(words.words)))))
    d_logit, kept = rnd.standard_normal(4), []
    net.forward(gates, words.index, kept)
    grads, d_gates = net.backward(gates, words.index, kept, d_logit)
    places = [(getattr(net, k), g) for k, g in grads.items()] + [(gates, d_gates)]
    for values, grad in places:
        for _ in range(12):
            at = tuple(rnd.integers(0, n) for n in values.shape)
            old, sides = values[at], []
            for step in (1e-6, -1e-6):
                values[at] = old + step
                sides.append((net.forward(gates, words.index) * d_logit).sum())
            values[at] = old
            assert abs((sides[0] - sides[1]) / 2e-6 - grad[at]) < 1e-7


def test_word_features():
    buckets, grams, sizes = X.word_features(["Idiot!", "idiot", "", "...", "日本"])
    assert buckets[0] == buckets[1] and buckets[2] == buckets[3] and sizes.tolist() == [5, 5, 1, 1, 6]
    assert grams[:5].tolist() == grams[5:10].tolist() and len(grams) == sizes.sum()


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        covered = {k for s in X.windows(n) for k in range(s, min(n, s + X.WINDOW))}
        assert covered == set(range(n))


def corpus(seed, n):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("aeioubcdfg") for _ in range(rnd.randint(2, 7))) for _ in range(600)]
    bad = ["scumbag", "worthless", "vile"]
    texts, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([10, 60, 200]))]
        toxic = int(rnd.random() < 0.3)
        for _ in range(2 * toxic):
            words.insert(rnd.randint(0, len(words)), rnd.choice(bad))
        texts.append(" ".join(words))
        labels.append(toxic)
    return texts, labels


def test_held_out_accuracy_and_odd_rows(spark, documents, sf):
    texts, toxic = corpus(2, 300)
    odd = [None, "", " \n", "x" * 100_000, texts[0], "fine words " * 30_000 + texts[toxic.index(1)]]
    docs = documents(texts + odd, [*range(304), None, 305]).withColumn("score", F.lit("mine"))
    rows = [(i, 1, t) for i, t in enumerate(toxic)] + [(5, 1, None), (None, 1, 1), (10**6, 0, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality long, toxic long")
    got = {r.doc_id: r for r in X.op8_toxicity(spark, sf(documents=docs, labels=labels)).collect()}
    assert len(got) == 306 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and not got[None].held_out
    assert np.mean([got[i].predicted == toxic[i] for i in held]) >= 0.95
    assert got[300].score == got[301].score == got[302].score
    assert abs(got[None].score - got[0].score) < 1e-6
    assert got[305].predicted == 1


def test_scores_do_not_depend_on_the_batch(documents):
    texts, toxic = corpus(3, 40)
    net = X.fit([[t.split()[s:s + X.WINDOW] for s in X.windows(len(t.split()))] for t in texts], toxic)
    together = X.Scorer(net).scores(texts)
    assert np.allclose(together, [X.Scorer(net).scores([t])[0] for t in texts], atol=1e-5)


def test_without_both_labels_or_rows(spark, documents, sf):
    one = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "doc_id long, quality long, toxic long")
    rows = X.op8_toxicity(spark, sf(documents=documents(["a", "b"]), labels=one)).collect()
    assert {r.score for r in rows} <= {1.0, 0.0}
    none = one.filter("false")
    assert [r.score for r in X.op8_toxicity(spark, sf(documents=documents(["a"]), labels=none)).collect()] == [0.0]
    assert X.op8_toxicity(spark, sf(documents=documents([]), labels=one)).count() == 0
