import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from metricmart.llm import decontaminate as D


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(texts, items):
    out = []
    for text in texts:
        words, hit, ids = plain_words(text), set(), set()
        for item, body in items:
            iw = plain_words(body)
            n = min(13, len(iw))
            for i in range(len(iw) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j:j + n] == iw[i:i + n]:
                        hit |= set(range(j, j + n))
                        ids.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((len(words), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(words)))
    return out


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(3)
    vocab = ["the", "of", "Été", "x", "b2", "ñandú"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice([1, 2, 5, 13, 20]) + 3)) for i in range(12)] + [(40, None), (41, " ?!"), (7, "zz top")]
    texts = [None, "", "??", "zz-TOP!", "zz topx", "azz top"]
    for _ in range(25):
        body = say(30)
        _, item = rnd.choice([x for x in items if x[1]])
        texts.append(f"{body}, ({item.upper()})\n{say(rnd.choice([0, 400]))}")
    return texts + texts[6:9], items


def rows(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_against_brute_force(spark, documents, case, block_bytes):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = D.benchmark_hits(documents(texts), bench, block_bytes=block_bytes)
    got = rows(hits.select("doc_id", "n_words", *[c.alias(n) for n, c in D.verdict_columns().items()]))
    assert got == [(i, *want) for i, want in enumerate(brute(texts, items))]


def test_signs_beyond_ascii_belong_to_words(spark, documents):
    bench = spark.createDataFrame([(1, "Alpha, BETA gamma")], "item_id long, text string")
    assert D.benchmark_hits(documents(["«alpha»... beta\nGAMMA!, alpha beta"]), bench).first().spans == []


def test_spans_of_plain_words(spark, documents):
    bench = spark.createDataFrame([(1, "Alpha, BETA gamma")], "item_id long, text string")
    text = "é 😀 (alpha)... beta\nGAMMA!, alpha beta"
    row = D.benchmark_hits(documents([text]), bench).first()
    assert [text[s.start:s.end] for s in row.spans] == ["alpha)... beta\nGAMMA"]


def test_filter_keeps_columns_and_clean_rows(spark, documents):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = documents(["alpha beta gamma", "clean", None, "alpha beta gamma " + "y " * 100], [1, None, 3, 4])
    docs = docs.withColumn("hits", F.lit(1)).withColumn("row", F.lit(2)).withColumn("n words", F.lit(3))
    for block in (1 << 20, 4):
        out = D.remove_contaminated(docs, bench, block_bytes=block)
        assert out.columns == docs.columns
        assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "4", "None"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_maps_ties_and_repeated_rows(spark, documents, block_bytes):
    bench = spark.createDataFrame([(i, f"alpha beta gamma item{i}") for i in range(30)], "item_id long, text string")
    texts = [f"alpha beta gamma item{i}" for i in range(4)] + ["clean", "clean", None, ""]
    docs = documents(texts, [1, 1, 2, 2, 5, 5, None, 6]).withColumn("row", F.create_map(F.lit("k"), F.col("n_chars")))
    docs = docs.withColumn("Hits", F.lit(None).cast("int"))
    out = D.remove_contaminated(docs, bench, block_bytes=block_bytes)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text), str(r.row)) for r in out.collect()) == sorted(
        [("5", "clean", "{'k': 5}")] * 2 + [("None", "None", "{'k': None}"), ("6", "", "{'k': 0}")])
    hits = D.benchmark_hits(docs, bench, block_bytes=block_bytes)
    assert sorted((str(r.doc_id), r.n_words, len(r["items"])) for r in hits.collect()) == sorted(
        [("1", 4, 1)] * 2 + [("2", 4, 1)] * 2 + [("5", 1, 0)] * 2 + [("None", 0, 0), ("6", 0, 0)])


def test_pieces_have_the_windows_of_their_items(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 12, 13, 14, 19, 20, 21, 200)]
    items = spark.createDataFrame([*enumerate(texts), (None, "x, Y"), (99, None)], "item_id long, text string")
    found = {}
    for r in D.pieces(items, 13, 7).collect():
        words = r.text.split()
        assert len(words) <= 19
        found.setdefault(r.item_id, set()).update(D.windows_of([w.encode() for w in words]))
    assert found.pop(None) == {b"x y"}
    assert found == {i: w for i, t in enumerate(texts) if (w := D.windows_of(D.words_of(t.encode())))}


def test_very_long_text_and_item_over_several_blocks(spark, documents):
    rnd = random.Random(6)
    say = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    item, text = say(9000), say(200_000)
    planted = text[:70_000] + item[4000:4200] + text[70_000:]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "q " * 14)], "item_id long, text string")
    row = D.benchmark_hits(documents([" ".join(planted)]), bench, block_bytes=20_000).first()
    assert row["items"] == ["7"] and [(h.first, h.last) for h in row.hits] == [(70_000, 70_199)]


def test_workers_keep_one_automaton(monkeypatch):
    monkeypatch.setattr(D, "_built", {})

    class Shared:
        value = [("1", b"a b")]

    first = D._worker_automaton("x", Shared, 13)
    assert D._worker_automaton("x", Shared, 13) is first
    assert D._worker_automaton("y", Shared, 13) is not first and list(D._built) == ["y"]


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.benchmark_hits(documents([]), bench).count() == 0
    row = D.benchmark_hits(documents(["a b"]), bench).first()
    assert row.n_words == 2 and row.hits == [] and row["items"] == []
