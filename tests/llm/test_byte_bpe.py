import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from metricmart.llm import byte_bpe as B

pytest.importorskip("public_tokenizers")
CHARS = " \n\t\r\x0b\x0c\x1c\x85\xa0　 abcXYZ'stdmlr0129²½Ⅷ_.,!?|#éàß日本語😀́\x00\x7f"


@pytest.fixture(scope="module")
def codec():
    return B.codec(*B.public_vocabulary())


@pytest.fixture(scope="module")
def reference():
    path, pattern = B.public_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.read_ranks(path), special_tokens={})


def test_every_token_is_reached(codec):
    for token, rank in B.read_ranks(B.public_vocabulary()[0]).items():
        assert codec.model.encode(token.decode("latin-1").translate(codec.to_chars)) == [rank]


def test_same_ids_as_the_rank_library(codec, reference):
    rnd = random.Random(7)
    texts = ["", " ", "a", "  a", "a ", "<|endoftext|>", "x" * 5000, "a b" * 3000, " " * 300 + "\n"]
    texts += ["".join(rnd.choice(CHARS) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        assert codec.encode(text) == reference.encode_ordinary(text), repr(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_bad_ranks_are_refused():
    with pytest.raises(ValueError):
        B.serialise_model({b"a": 0})


def test_query_on_odd_rows(spark, documents, sf, reference):
    texts = ["The cat's  42 hats.", None, "", "É" * 9, "The cat's  42 hats.", "z" * 200_000]
    docs = documents(texts, [3, 4, None, 5, 3, 6]).withColumn("n_tokens", F.lit("mine"))
    rows = B.op7_byte_bpe(spark, sf(documents=docs)).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    by_id = {r.doc_id: r for r in rows}
    for i, text in zip([3, 4, None, 5, 3, 6], texts, strict=True):
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        assert by_id[i].n_tokens == len(ids)
        assert by_id[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert by_id[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(spark, documents, sf):
    assert B.op7_byte_bpe(spark, sf(documents=documents([]))).count() == 0


def test_ids_column(documents, reference):
    path, pattern = B.public_vocabulary()
    row = B.encode_documents(documents(["hello world"]), path, pattern).first()
    assert row.ids == reference.encode_ordinary("hello world")
