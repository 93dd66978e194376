import hashlib
import random

import pytest
from pyspark.sql import functions as F

from metricmart.llm import line_dedup as L


def line_hash(line):
    return int(hashlib.md5(line.encode()).hexdigest()[:15], 16) % L.MODULUS


def chunks(text):
    """(first line, lines) of each chunk."""
    lines = text.split("\n")
    hashes = [line_hash(line) for line in lines]
    return [
        (i, tuple(lines[i:j + 1])) for i in range(len(lines)) for j in range(i + 1, min(i + L.MAX_LINES, len(lines)))
        if all(h > max(hashes[i], hashes[j]) for h in hashes[i + 1:j]) and sum(map(len, lines[i:j + 1])) >= L.MIN_CHARS
    ]


def brute(docs):
    """docs: distinct (id, text), id not NULL; text left of each."""
    first, out = {}, {}
    for i, text in sorted(d for d in docs if d[1] is not None):
        lines, gone = text.split("\n"), set()
        for no, c in chunks(text):
            if first.setdefault(c, (i, no)) != (i, no):
                gone |= set(range(no, no + len(c)))
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return {i: out.get(i) for i, _ in docs}


def sample(seed=1, n=120):
    rnd = random.Random(seed)
    pool = [f"line {i} é" for i in range(40)] + ["", " ", "x"]
    passage = "\n".join(rnd.choice(pool) for _ in range(15))
    texts = [None, "", "\n", "a", "a\n", passage, passage, "same\n" * 500]
    for _ in range(n):
        own = [f"own {rnd.random()}" for _ in range(rnd.randint(0, 12))]
        own[rnd.randint(0, len(own)):0] = passage.split("\n")[:rnd.randint(0, 15)] if rnd.random() < 0.6 else []
        texts.append("\n".join(own))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(documents, seed):
    texts = sample(seed)
    docs = documents(texts).withColumn("gone", F.lit(1)).withColumn("first", F.lit(2)).withColumn("h1", F.lit(3))
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    want = brute(list(enumerate(texts)))
    assert len(rows) == len(texts) and {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_boundaries_withstand_shifts(spark, documents):
    passage = "\n".join(f"shared line {i}" for i in range(60))
    docs = documents([passage, "new first line\n" + passage, "a\nb\n" + passage + "\nc"])
    assert [r.text for r in L.dedup_lines(docs).orderBy("doc_id").collect()] == [passage, "new first line", "a\nb\nc"]


def test_short_lines_go_with_longer_chunks_only(documents):
    blank = "a first paragraph\n\n\nb"
    texts = [blank, blank.replace("first", "second"), "}\n}\nx", "}\n}\ny"]
    assert [r.text for r in L.dedup_lines(documents(texts)).orderBy("doc_id").collect()] == texts
    verse = "\n".join(f"word{i}" for i in range(40))
    texts = [verse, "before\n" + verse + "\nafter"]
    left = L.dedup_lines(documents(texts)).orderBy("doc_id").collect()[1].text
    # short lines at a passage's ends may stay
    assert left == brute(list(enumerate(texts)))[1] and left.count("\n") < L.MAX_LINES


def test_hash_collision_removes_nothing(documents, monkeypatch):
    places = L.multi_line_chunks
    monkeypatch.setattr(L, "multi_line_chunks", lambda docs: places(docs).withColumn("h1", F.lit(1).cast("bigint")).withColumn("h2", F.lit(2).cast("bigint")))
    texts = ["first line of a\nsecond line of a", "first line of b\nsecond line of b"]
    assert [r.text for r in L.dedup_lines(documents(texts)).orderBy("doc_id").collect()] == texts
    texts = [texts[0], texts[0]]
    assert [r.text for r in L.dedup_lines(documents(texts)).orderBy("doc_id").collect()] == [texts[0], ""]


def test_chunks_per_line_are_bounded(documents):
    rnd = random.Random(3)
    text = "\n".join(f"a line of some length {rnd.random()}" for _ in range(5000))
    assert L.multi_line_chunks(documents([text])).count() < 2 * 5000


def test_repeated_rows_and_null_ids(documents):
    text = "\n".join(f"line number {i}" for i in range(30))
    rows = L.dedup_lines(documents([text, text, text], [5, 5, 9])).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(5, text), (5, text), (9, "")]
    rows = L.dedup_lines(documents([text, text], [None, 9])).collect()
    assert sorted((str(r.doc_id), r.text) for r in rows) == [("9", ""), ("None", text)]


def test_very_long_text(documents):
    text = "\n".join(f"row {i % 20_000}" for i in range(100_000))
    assert L.dedup_lines(documents([text])).first().text == brute([(0, text)])[0]


def test_empty_table(spark, documents, sf):
    assert L.op10_line_chunks(spark, sf(documents=documents([]))).count() == 0


def test_no_python_in_the_plan(spark, documents, sf, capsys):
    L.op10_line_chunks(spark, sf(documents=documents(["a\nb\nc"]))).explain("formatted")
    assert "Python" not in capsys.readouterr().out


def brute_passages(docs):
    """docs: distinct (id, text); text left of each once the pairs with an earlier place are gone."""
    seen, out = set(), {}
    for i, text in sorted((d for d in docs if d[1] is not None)):
        lines, gone = text.split("\n"), set()
        for k, pair in enumerate(zip(lines, lines[1:])):
            gone |= {k, k + 1} if pair in seen else set()
            seen.add(pair)
        out[i] = "\n".join(line for k, line in enumerate(lines) if k not in gone)
    return {i: out.get(i) for i, _ in docs}


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_against_brute_force(documents, seed):
    texts = sample(seed)
    out = L.dedup_passages(documents(texts))
    rows = out.collect()
    assert len(rows) == len(texts) and {r.doc_id: r.text for r in rows} == brute_passages(list(enumerate(texts)))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def planted(per_length=20, lengths=range(2, 13), seed=9):
    """texts, and the planted lines by (number of the later text, length): each passage twice, in other surroundings."""
    rnd = random.Random(seed)

    def lines(n):
        return [" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(8)) for _ in range(n)]

    texts, passages = [], {}
    for length in lengths:
        for _ in range(per_length):
            passage = lines(length)
            texts.append("\n".join(lines(rnd.randint(1, 9)) + passage + lines(rnd.randint(1, 9))))
            passages[len(texts), length] = passage
            texts.append("\n".join(lines(rnd.randint(1, 9)) + passage + lines(rnd.randint(1, 9))))
    return texts, passages


@pytest.mark.parametrize("dedup", [L.dedup_lines, L.dedup_passages])
def test_passages_in_other_surroundings_go_whole(documents, dedup):
    texts, passages = planted()
    left = {r.doc_id: r.text.split("\n") for r in dedup(documents(texts)).collect()}
    for (i, _), passage in passages.items():
        assert left[i - 1] == texts[i - 1].split("\n")
        assert left[i] == [line for line in texts[i].split("\n") if line not in passage]


def test_passages_with_a_shared_hash_stay(documents, monkeypatch):
    monkeypatch.setattr(L, "_chunk_key", lambda: [F.lit(1).cast("bigint").alias("h1"), F.lit(2).cast("bigint").alias("h2")])
    texts = ["a\nb\nc", "d\ne\nf"]
    assert [r.text for r in L.dedup_passages(documents(texts)).orderBy("doc_id").collect()] == texts


def test_passages_of_repeated_rows_and_long_texts(spark, documents, sf):
    text = "\n".join(f"l{i}" for i in range(30))
    rows = L.dedup_passages(documents([text, text, text], [5, 5, 9])).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(5, text), (5, text), (9, "")]
    long_text = "\n".join(f"row {i % 20_000}" for i in range(100_000))
    assert L.dedup_passages(documents([long_text])).first().text == "\n".join(f"row {i}" for i in range(20_000))
    assert L.op10_line_passages(spark, sf(documents=documents([]))).count() == 0


def test_no_python_in_the_plan_of_passages(spark, documents, sf, capsys):
    L.op10_line_passages(spark, sf(documents=documents(["a\nb\nc"]))).explain("formatted")
    assert "Python" not in capsys.readouterr().out


def test_files_of_places_go_before_the_texts_are_written(spark, documents, tmp_path, monkeypatch):
    import os

    from metricmart.llm import common
    monkeypatch.setattr(common, "checkpoint_root", lambda spark: str(tmp_path))
    passage = "\n".join(f"a line of a passage, number {i}" for i in range(5))
    held = L.with_repeats(documents([passage, "before\n" + passage, "alone"]), "chunks")
    assert {r.doc_id: r.chunks is None for r in held.collect()} == {0: False, 1: False, 2: True}
    assert [n.rsplit("-", 1)[0] for n in os.listdir(f"{tmp_path}/metricmart-llm")] == ["line-chunks"]
