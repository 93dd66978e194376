import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricmart.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
CHARS = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　᠎​ abcXYZ'stdmlr0129²½Ⅷ_.,!?|#éàß日本語😀́\x00\x7f"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_same_ids_as_the_library(tokenizer):
    rnd = random.Random(5)
    texts = ["", " ", "a", "  a", "a ", "a <|endoftext|> b", "x<|endoftext|>", "x" * 5000, "a b" * 3000, " " * 300 + "\n", "a  b c d"]
    texts += ["".join(rnd.choice(CHARS) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rnd.choice("ab .\n'") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    for text, ids in zip(texts, P.PartEncoder(PATH).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_part_of_many_occurrences_is_looked_up_once(tokenizer):
    class Counted(dict):
        lookups = 0

        def get(self, key, default=None):
            self.lookups += 1
            return super().get(key, default)

        def __getitem__(self, key):
            self.lookups += 1
            return super().__getitem__(key)

        def __contains__(self, key):
            self.lookups += 1
            return super().__contains__(key)

    encoder = P.PartEncoder(PATH)
    encoder.kept = Counted()
    texts = ["to be or not to be " * 300 + "!", "be" + " not to" * 500, "be  to" + " or not" * 200 + " ", "", "be"]
    for _ in range(2):  # the second time all parts are kept
        encoder.kept.lookups = 0
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.kept.lookups < 50


def check_whole(rows, docs, size):
    """docs: id -> ids. Every id lies in one piece; sequences are gapless and not padded."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(docs)
    for doc_id, ids in docs.items():
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            own = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(own)) and r.length > 0
            at += r.length
        assert at == len(ids)
    short = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and at & at - 1 == 0
        short += at < size
    assert short <= size.bit_length()


@pytest.mark.parametrize("partitions", [1, 3, 70])
def test_pieces_cover_every_id_without_padding(spark, documents, sf, tokenizer, partitions):
    rnd = random.Random(partitions)
    texts = [None, "", "word " * 9000, "z" * 30_000, "same text", "same text"]
    texts += [" ".join(rnd.choice(["alpha", "beta,", "gämma\n", "delta  x"]) for _ in range(int(rnd.paretovariate(0.9) * 20) % 4000))
              for _ in range(400)]
    docs = documents(texts).withColumns({"start": F.lit("x"), "ids": F.lit(1), "from_group": F.lit(2)})
    out = P.pack(docs.repartition(partitions), PATH, 1)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_whole(out.collect(), {i: ids_of(tokenizer, t) for i, t in enumerate(texts)}, 2048)
    assert partitions > 1 or P.op12_packing(spark, sf(documents=docs)).count() >= len(texts)


def test_best_fit_and_fullest_window():
    done = []
    packer = P.Packer(8, 2, done.append)

    def add(name, n):
        packer.add(name, bytes(4 * n))

    add("a", 5)
    add("b", 4)
    add("c", 3)  # fits the fuller window exactly
    assert [[p[0] for p in w] for w in done] == [["a", "c"]]
    add("d", 6)
    add("e", 5)  # fits none: the fullest window (room 2) takes its start, the rest goes beside b
    assert [[(p[0], p[1], len(p[2]) // 4) for p in w] for w in done[1:]] == [[("d", 0, 6), ("e", 0, 2)]]
    assert [(p[0], p[1], len(p[2]) // 4) for p in packer.leftover()] == [("b", 0, 4), ("e", 2, 3)]


def test_powers():
    pieces = [("a", 0, bytes(4 * 7), 7), ("b", 3, bytes(4 * 6), 9)]
    assert [[(p[0], p[1], len(p[2]) // 4) for p in s] for s in P._powers(pieces, 16)] == [
        [("a", 0, 7), ("b", 3, 1)], [("b", 4, 4)], [("b", 8, 1)]]


def test_repeated_rows_null_ids_and_empty_table(documents):
    rows = P.pack(documents(["x y", "x y", None], [1, 1, None]), PATH, 1).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows if r.start == 0)[0][0] == 0
    assert sum(r.length for r in rows if r.doc_id == 1) == 6
    assert P.pack(documents([]), PATH, 1).count() == 0
    with pytest.raises(ValueError):
        P.pack(documents([]), PATH, 1, size=1000)
