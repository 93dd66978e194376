import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as P  # noqa: E402
from metricmart.llm import byte_bpe, quality  # noqa: E402
from tests_brute import brute_contaminated, brute_lines, brute_one_of_each  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "simhash", "decontamination", "byte_bpe"]


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.op3_fertility(spark, SF).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = brute_lines(texts)
    texts = brute_one_of_each(texts)
    texts = {i: t for i, t in texts.items() if not brute_contaminated(t, items)}
    codec = byte_bpe.codec(*byte_bpe.public_vocabulary())
    got = P.run(spark, SF)
    assert {r.doc_id: r.ids for r in got.collect()} == {i: codec.encode(t) for i, t in texts.items()}


def test_stages_keep_the_columns(spark, documents):
    docs = documents(["a b", None, ""])
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_empty_table(spark, documents):
    for _, stage in P.STAGES:
        assert stage(spark, documents([]), SF).count() == 0
