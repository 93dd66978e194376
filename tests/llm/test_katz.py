import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricmart.llm import katz as K


def tokens_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lowered), None]  # None: the end


class Plain:
    """The model by dictionaries; every probability by the definition."""

    def __init__(self, texts):
        self.c, self.cc = Counter(), Counter()
        self.contexts = Counter()
        for t in texts:
            before = "<s> "
            for w in tokens_of(t):
                self.c[w] += 1
                self.cc[before, w] += 1
                self.contexts[before] += 1
                before = w
        self.N = sum(self.c.values())
        self.r1 = K.discounted(np.array([0, *[sum(v == r for v in self.c.values()) for r in range(1, 7)]]))
        self.r2 = K.discounted(np.array([0, *[sum(v == r for v in self.cc.values()) for r in range(1, 7)]]))
        self.unk = 1 - sum(self.star(v, self.r1) for v in self.c.values()) / (self.N + 1)

    @staticmethod
    def star(r, table):
        return table[r] if r <= K.CUTOFF else r

    def p1(self, w):
        return self.star(self.c[w], self.r1) / (self.N + 1) if self.c[w] else self.unk

    def p(self, w, before):
        if not self.contexts[before]:
            return self.p1(w)
        total = self.contexts[before] + 1
        if self.cc[before, w]:
            return self.star(self.cc[before, w], self.r2) / total
        follow = [x for (b, x) in self.cc if b == before]
        left = 1 - sum(self.star(self.cc[before, x], self.r2) for x in follow) / total
        return left / (1 - sum(map(self.p1, follow))) * self.p1(w)

    def row(self, text):
        base = score = known = 0
        before = "<s> "
        for w in tokens_of(text):
            base += math.log10((self.c[w] + 0.5) / (self.N + 0.5 * (len(self.c) + 1)))
            score += math.log10(self.p(w, before))
            known += self.c[w] > 0
            before = w
        return len(tokens_of(text)), known, self.N, base, score


def sample(seed, n=150):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["The", "É", "a\x85b", "|"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    texts = [" ".join(rnd.choices(vocab, weights, k=rnd.choice([0, 1, 5, 40]))) for _ in range(n)]
    texts += [None, "", " \n\t", "zz yy the", "the " * 3000] + [f"rare{i} w1" for i in range(40)]
    return texts + texts[-2:]


@pytest.mark.parametrize("seed, pack_bytes", [(1, 1 << 24), (2, 700)])
def test_against_plain_dictionaries(documents, seed, pack_bytes):
    texts = sample(seed)
    ids = [None, *range(1, len(texts) - 2), len(texts) - 4, len(texts) - 3]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids]
    model = Plain([t for t, h in zip(texts, held) if not h])
    docs = documents(texts, ids).withColumn("pack", F.lit("x")).withColumn("score", F.lit(0))
    rows = K.score_texts(docs, K.fold_of("doc_id", 5, 1), pack_bytes).collect()
    got = sorted([tuple(r) for r in rows], key=lambda r: (-1 if r[0] is None else r[0], r[-1]))
    want = sorted([(i, h, *model.row(t)) for i, t, h in zip(ids, texts, held)], key=lambda r: (-1 if r[0] is None else r[0], r[-1]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    for before in ("<s> ", "the", "w1", "rare3", "never"):
        assert abs(sum(model.p(w, before) for w in [*model.c, "unknown word"]) - 1) < 1e-9


def test_discounts():
    n = np.array([0, 1000, 400, 220, 140, 100, 70])
    table = K.discounted(n)
    common = 6 * 70 / 1000
    assert table[2] == pytest.approx(2 * (3 * 220 / (2 * 400) - common) / (1 - common))
    assert K.discounted(np.array([0, 0, 0, 0, 0, 0, 0])).tolist() == [0, 0.5, 1.5, 2.5, 3.5, 4.5]


def test_arrays_survive():
    for values in ([], [5], [3, 3, 2**40, -7]):
        assert K.expanded(K.squeezed(np.array(values, np.int64))).tolist() == values


def test_no_training_text_and_empty_table(spark, documents, sf):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = K.op9_katz(spark, sf(documents=documents(["a b"], [held]))).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert K.op9_katz(spark, sf(documents=documents([]))).count() == 0
