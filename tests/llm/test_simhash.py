import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from metricmart.llm import simhash as S


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, ids, max_bits=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {x: min([ids[k] for k in range(len(fps)) if label[k] == x and ids[k] is not None], default=None) for x in label}
    return [least[x] for x in label]


def near(rnd, fp, bits):
    for b in rnd.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_fingerprints_and_components(spark, documents, sf):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(50)] + ["É", "A\x85b", "Zz", "x y"]
    base = [rnd.choice(vocab) for _ in range(400)]
    texts = [None, "", " \n\t", "one", "One TWO", "one two three", "a b c d", "A\nB\tC\x0bd", " ".join(base)]
    for _ in range(60):
        words = list(base) if rnd.random() < 0.6 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 300))]
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    ids = [None, *range(900, 900 + len(texts) - 1)]
    rnd.shuffle(ids)
    docs = documents(texts, ids).withColumn("fp", F.lit("x")).withColumn("row", F.lit("y"))
    rows = S.op2_simhash(spark, sf(documents=docs)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    want = sorted(zip(map(str, ids), [f"{f:016x}" for f in fps], plain_components(fps, ids)), key=str)
    assert sorted([(str(r.doc_id), r.fingerprint, r.component_id) for r in rows], key=str) == want
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in plain_components(fps, ids)})


@pytest.mark.parametrize("block_rows", [2048, 7])
def test_links_of_close_and_random_fingerprints(spark, block_rows):
    rnd = random.Random(block_rows)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        center = rnd.getrandbits(64)
        fps |= {near(rnd, center, rnd.randint(0, 7)) for _ in range(rnd.choice([1, 3, 15]))}
    fps |= {(5 << 60) + i for i in range(40)}
    fps = sorted(fps)
    prints = S.materialise(spark.createDataFrame([(i, S._signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long"), "t")
    got = {r.doc_id: r.component_id for r in S.groups_of(prints, 4, block_rows).collect()}
    assert [got[i] for i in range(len(fps))] == plain_components(fps, list(range(len(fps))))


@pytest.mark.parametrize("leaf", [2, 256])
def test_index_finds_what_comparison_finds(monkeypatch, leaf):
    monkeypatch.setattr(S, "LEAF_ROWS", leaf)
    rnd = random.Random(leaf)
    center = rnd.getrandbits(64)
    fps = np.array(sorted({near(rnd, center, rnd.randint(0, 8)) for _ in range(300)}), np.uint64)
    fps = fps[np.argsort(S.gray_rank(fps))]
    labels = S.Forest(len(fps))
    for i, j in S.forest_of(fps, 0, 4):
        assert (int(fps[i]) ^ int(fps[j])).bit_count() <= 4
        labels.unite(i, j)
    want = plain_components([int(f) for f in fps], list(range(len(fps))))
    assert [labels.find(i) for i in range(len(fps))] == want
    assert len(S.forest_of(fps, 0, 4)) == len(fps) - len(set(want))


def test_gray_rank_orders_neighbours_by_one_bit():
    codes = np.arange(1 << 10, dtype=np.uint64)
    ordered = codes[np.argsort(S.gray_rank(codes))]
    assert set(np.bitwise_count(ordered[1:] ^ ordered[:-1]).tolist()) == {1}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(-5, -5), (100, 101)], "a long, b long")
    rows = {r.node: r.root for r in S.components(edges).collect()}
    assert rows == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_repeated_rows_and_empty_table(spark, documents, sf):
    docs = documents(["a b c d e"] * 3 + ["other words here"], [7, 7, 9, 8])
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == [7, 8]
    assert S.op2_simhash(spark, sf(documents=documents([]))).count() == 0
    assert S.keep_one(documents([])).count() == 0
