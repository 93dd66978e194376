import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricmart.llm import language as L

SYLLABLES = {"aa": "ba ko tu mi".split(), "bb": "sch ung ver ei".split(), "cc": "жо ли ку да".split()}


def say(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_trigrams_against_plain_counting():
    texts = ["Ab, c", "", "É1é", "  ", "x"]
    bucket, owner = L.trigrams(texts)
    for i, text in enumerate(texts):
        padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        windows = [padded[j:j + 3] for j in range(len(padded) - 2)]
        assert (owner == i).sum() == sum(w.strip() != "" for w in windows)
    assert L.trigrams(["ab 1"])[0].tolist() == L.trigrams(["AB\n!"])[0].tolist()


def test_mixture_finds_both_languages():
    rnd = random.Random(1)
    names = sorted(SYLLABLES)
    counts = np.array([np.bincount(L.trigrams([say(rnd, n, 3000)])[0], minlength=1 << L.BUCKET_BITS) for n in names])
    model = L.LanguageModel(names, counts)
    texts = [say(rnd, "aa", 300) + " " + say(rnd, "bb", 100), say(rnd, "cc", 5), "", "12 34", say(rnd, "bb", 200) + " zz"]
    shares = model.proportions(texts)
    assert set(np.flatnonzero(shares[0])) == {0, 1} and shares[0][0] > shares[0][1] > 0.15
    assert shares[1].tolist() == [0, 0, 1] and not shares[2].any() and not shares[3].any()
    assert shares[4].tolist() == [0, 1, 0]
    one_by_one = np.concatenate([model.proportions([t]) for t in texts])
    assert np.allclose(shares, one_by_one, atol=5 * L.EM_STEP)


def test_long_texts_are_whole():
    rnd = random.Random(2)
    names = ["aa", "bb"]
    counts = np.array([np.bincount(L.trigrams([say(rnd, n, 3000)])[0], minlength=1 << L.BUCKET_BITS) for n in names])
    text = say(rnd, "aa", 60_000) + " " + say(rnd, "bb", 240_000)
    assert len(text) > L.RUN_BYTES
    share = L.LanguageModel(names, counts).proportions(["x", text])[1]
    assert 0.7 < share[1] < 0.9


def test_query(spark, documents, sf):
    rnd = random.Random(3)
    langs = [rnd.choice(sorted(SYLLABLES)) for _ in range(200)]
    texts = [say(rnd, lang, rnd.choice([3, 40])) for lang in langs] + [None, "", "!?", "ba ko", "ba ko"]
    ids = [*range(203), 202, None]
    docs = documents(texts, ids, [*langs, "aa", "cc", None, None, "aa"]).withColumn("score", F.lit("x"))
    rows = L.op1_language(spark, sf(documents=docs)).collect()
    assert len(rows) == 205
    right = held = 0
    for r in rows:
        if r.doc_id is None:
            assert not r.held_out
            continue
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id < 200 and r.held_out:
            held, right = held + 1, right + (r.lang_pred == langs[r.doc_id])
        if r.doc_id in (200, 201):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    assert held and right >= 0.97 * held


def test_nothing_learned_and_empty(spark, documents, sf):
    rows = L.op1_language(spark, sf(documents=documents(["a b"], langs=[None]))).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
    assert L.op1_language(spark, sf(documents=documents([]))).count() == 0


def test_too_many_languages_are_refused(spark, documents, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        L.train(documents(["a", "b"], langs=["x", "y"]))


def test_labels_are_never_read_for_a_prediction(spark, documents):
    model = L.train(documents(["ba ko " * 50, "sch ung " * 50], langs=["aa", "bb"]))
    a = L.predict(documents(["ba ko"], langs=["bb"]), model).first()
    assert a.lang_pred == "aa"
