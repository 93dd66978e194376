import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricmart.llm import substring_dedup as D
from metricmart.llm.suffix_array import permuted_prefixes, suffix_array


def check_array(symbols):
    text = np.array([*symbols, 0])
    order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    array = suffix_array(text, int(text.max()) + 1)
    assert array.tolist() == order
    want = [0] * len(text)
    for a, b in zip(order, order[1:]):
        while max(a, b) + want[b] < len(text) and text[a + want[b]] == text[b + want[b]] >= 2:
            want[b] += 1
    assert permuted_prefixes(text, array, 2).tolist() == want


def test_induced_sorting_against_plain_sorting():
    rnd = random.Random(1)
    for _ in range(400):
        k = rnd.choice([1, 2, 3, 5, 30])
        check_array([rnd.randint(1, k) for _ in range(rnd.randint(0, 60))])
    for odd in ([1] * 50, [2, 1] * 40, list(range(1, 40)), list(range(40, 0, -1)), [3, 3, 2, 3, 3, 2, 1] * 20):
        check_array(odd)


def brute(texts, length):
    """Per text: bytes, removed, spans, digest."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i + 1:i + length + 1] = True
        kept = bytes(c for c, g in zip(d, gone[1:]) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def sample(seed):
    rnd = random.Random(seed)
    say = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    shared = [say(260), say(900), "ab" * 150, "x" * 400]
    texts = [None, "", "short", shared[1], shared[1], shared[0][:199], "x" * 150 + say(100), say(100) + "x" * 250]
    for _ in range(60):
        body = say(rnd.randint(0, 700))
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(shared)
            a = rnd.randint(0, len(p) - 50)
            at = rnd.randint(0, len(body))
            body = body[:at] + p[a:a + rnd.randint(50, len(p))] + body[at:]
        texts.append(body)
    return texts + texts[-4:]


def results(df):
    n_removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return [tuple(r) for r in df.select("doc_id", "n_bytes", n_removed, F.size("spans"), "kept_sha256").collect()]


@pytest.mark.parametrize("seed, shard_strings", [(1, 2000), (2, 2)])
def test_against_brute_force(documents, seed, shard_strings):
    texts = sample(seed)
    ids = [None, *range(1, len(texts) - 4), *range(len(texts) - 8, len(texts) - 4)]
    docs = documents(texts, ids).withColumn("first", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("packed", F.lit(3))
    want = [(i, *row) for i, row in zip(ids, brute(texts, D.LENGTH))]
    got = results(D.dedup_substrings(docs, shard_strings=shard_strings))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_anchor_above_the_threshold(documents, monkeypatch):
    # one passage in every text: whole, cut at either end, or a core shorter than a window; texts agree beside it
    rnd = random.Random(9)
    say = lambda n, of="ab": "".join(rnd.choice(of) for _ in range(n))
    passage = say(230, "abcdefgh")
    texts = []
    for i in range(150):
        a, b = rnd.choice([(0, 230), (0, 215), (20, 230), (30, 200), (40, 190), (0, 199)])
        texts.append(say(rnd.randint(0, 30)) + passage[a:b] + say(rnd.randint(0, 30)))
    texts += texts[:5]
    levels = []
    real = D._next_cells
    monkeypatch.setattr(D, "_next_cells", lambda *args: levels.append(1) or real(*args))
    got = results(D.dedup_substrings(documents(texts), shard_strings=10))
    assert sorted(got) == [(i, *row) for i, row in enumerate(brute(texts, D.LENGTH))]
    assert 2 < len(levels) <= 8


def test_halves_share_a_core_s_windows():
    for length, cores in ((200, (159, 180, 190, 199)), (7, range(1, 7))):
        for core in cores:
            for begin in range(length - core + 1):
                for windows in range(max(1, begin - (length - core) + 1), begin + 2):
                    parts = list(D.halves(windows, begin, core, length))
                    assert [w for _, a, b, _, _ in parts for w in range(a, b + 1)] == list(range(windows))
                    for _, a, b, start, size in parts:
                        assert core < size <= length and b <= start and start + size <= a + length


def test_segments_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 1 << 12)
    monkeypatch.setattr(D, "_PLACE", np.uint64((1 << 12) - 1))
    D._powers.cache_clear()
    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"ab \n") for _ in range(n)) for n in (0, 199, 200, 201, 3000, 4095, 4096, 20_000)]
    number, first, windows, offset, _, _ = D.segments(texts)
    for k, text in enumerate(texts):
        places = [p for n, f, w in zip(number, first, windows) if n == k for p in range(f, f + w)]
        assert sorted(places) == list(range(max(0, len(text) - 199)))
    # every window lies in one cell, and holds the cell's core
    core = D.LENGTH - D.cell_width(D.LENGTH) + 1
    for n, o in zip(windows.tolist(), offset.tolist()):
        seen = []
        for _, a, b, start in D.cells(o, n, D.LENGTH):
            seen += range(a, b + 1)
            assert b <= start and start + core <= a + D.LENGTH
        assert sorted(seen) == list(range(n))
    D._powers.cache_clear()


def test_query(spark, documents, sf):
    texts = sample(3)
    rows = D.op4_suffix_array(spark, sf(documents=documents(texts))).collect()
    assert sorted(tuple(r) for r in rows) == [(i, *row) for i, row in enumerate(brute(texts, 200))]


def test_empty_table(spark, documents, sf):
    assert D.op4_suffix_array(spark, sf(documents=documents([]))).count() == 0
