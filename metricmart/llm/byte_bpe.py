"""Byte-level BPE encoding and decoding through a sentencepiece model.

A rank file (one base64 token and its rank a line) is serialised directly as a
sentencepiece BPE model: each token's bytes are mapped to printable characters,
its score is the negative rank, and normalisation is the identity. Texts are
split by the vocabulary's pattern, each match is encoded by that model, and ids
are decoded through the inverse byte mapping.

Defined results: a NULL or empty text has no ids; ids equal the ranks; decoding
gives back the UTF-8 bytes of any text; rows are independent, so repeated rows
give repeated results and an empty table an empty one; only the text column is
read, and output columns replace nothing of the input.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from metricmart.llm.common import runs, table

#: Distinct chunks, and distinct matches, whose ids a Python worker keeps; a full cache starts anew.
CACHE_CHUNKS = 400_000
#: Longer chunks are encoded anew each time.
CACHE_CHARS = 48


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is one, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank file.

    Field numbers are those of the public sentencepiece_model.proto: pieces 1
    (piece 1, score 2, type 3), trainer_spec 2 (model_type 3, vocab_size 4,
    unk_id 40, bos_id 41, eos_id 42, pad_id 43), normalizer_spec 3 (name 1,
    add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5).
    Ranks must be 0..n-1; the unknown piece follows them, so ids are ranks."""
    alphabet = byte_alphabet()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be 0..n-1 and hold every single byte")
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(alphabet[b] for b in token).encode()
        out += _bytes_field(1, _bytes_field(1, piece) + b"\x15" + struct.pack("<f", -rank) + _int_field(3, 1))
    out += _bytes_field(1, _bytes_field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _int_field(3, 2))
    no = (1 << 64) - 1  # -1: the model has no such symbol
    trainer = _int_field(3, 2) + _int_field(4, len(tokens) + 1) + _int_field(40, len(tokens))
    trainer += b"".join(_int_field(n, no) for n in (41, 42, 43))
    out += _bytes_field(2, trainer)
    out += _bytes_field(3, _bytes_field(1, b"identity") + b"".join(_int_field(n, 0) for n in (3, 4, 5)))
    return bytes(out)


class BytePairCodec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        alphabet = byte_alphabet()
        self.to_chars = {b: alphabet[b] for b in range(256)}
        self.to_byte = {ord(c): b for b, c in enumerate(alphabet)}
        self.pattern = regex.compile(pattern)
        self.pieces = [self._piece_bytes(i) for i in range(self.model.get_piece_size() - 1)]
        self.chunks: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def _piece_bytes(self, i: int) -> bytes:
        return bytes(self.to_byte[ord(c)] for c in self.model.id_to_piece(i))

    def _encode_match(self, match: str) -> bytes:
        # latin-1 turns each UTF-8 byte into one character, which the table then maps
        # (one call a match: a list would start a thread pool each time)
        ids = self.model.encode(match.encode().decode("latin-1").translate(self.to_chars))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode_matches(self, text: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of each pattern match by itself."""
        return b"".join([self._kept(self.matches, m, self._encode_match) for m in self.pattern.findall(text)])

    @staticmethod
    def _kept(cache: dict[str, bytes], key: str, make) -> bytes | None:
        value = cache.get(key)
        if value is None:
            value = make(key)
            if value is not None and len(key) <= CACHE_CHARS:
                if len(cache) >= CACHE_CHUNKS:
                    cache.clear()
                cache[key] = value
        return value

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk after a space, or None where white space may reach over its edge."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return b"".join([self._encode_match(m) for m in self.pattern.findall(" " + chunk)])

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        A lone space before a visible character always starts a match, and no
        match holds one further in, so such chunks are encoded (and kept) one by
        one; a text with other white space beside a space is matched as a whole."""
        head, *rest = text.split(" ")
        if not head or head[-1].isspace():
            return self._encode_matches(text)
        out = [self._encode_matches(head)]
        for chunk in rest:
            ids = self.chunks.get(chunk) or self._kept(self.chunks, chunk, self._chunk)
            if ids is None:
                return self._encode_matches(text)
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec for each vocabulary and Python worker."""
    return BytePairCodec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (if asked for), ids_sha256, decoded_sha256, round_trip of each row.

    ``vocabulary`` is a path that every executor can open (an installed package's file).
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary, pattern)
        for batch in batches:
            for run in runs(batch, "text"):
                n, ids, ids_sha, decoded_sha, same = [], [], [], [], []
                for text in run.column("text").to_pylist():
                    raw = bpe.encode_bytes(text or "")
                    values = np.frombuffer(raw, "<u4")
                    decoded = bpe.decode(values.tolist())
                    n.append(len(values))
                    if with_ids:
                        ids.append(values.astype(np.int32))
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                    same.append(decoded == (text or "").encode())
                columns = [run.column("doc_id"), pa.array(n, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                columns += [pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n_tokens", T.LongType())
    schema = schema.add("ids", T.ArrayType(T.IntegerType())) if with_ids else schema
    schema = schema.add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType()).add("round_trip", T.BooleanType())
    names = schema.names
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the installed 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes for every document."""
    path, pattern = public_vocabulary()
    out = encode_documents(table(spark, sf_dir, "documents"), path, pattern, with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
