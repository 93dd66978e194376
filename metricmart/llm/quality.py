"""Quality rules: base counts and tokeniser fertility.

Each text's words go through two public vocabularies. Measured are characters
per token under both, the share of byte-fallback tokens and the entropy of the
token distribution. Rejection bands are kept for each group: the row's language,
or, where that is NULL, the script of most of its letters. A band is the median
plus and minus ``BAND_SIGMAS`` robust standard deviations of all the group's
documents that pass the base rules, and never narrower than ``BAND_FLOOR`` of
the median below it and ``BAND_CEILING`` above it, so that a small or uniform
group, or a few texts of another language in it, are not rejected.

Entropy grows with length, so it is judged as a share of the most that a text's
tokens could have: log2 of their number, or of the vocabulary's size if that is
less. A least-squares line through the group's shares, over that logarithm, gives
what its texts of a length have; the band holds the difference from the line, and
is never narrower than ``ENTROPY_FLOOR`` to either side.

Defined results: NULL and empty texts have no words and fail the base rules; a
text whose words give no token has no measures and no band; very long texts are measured whole, and
the line isn't followed beyond log2 of the vocabulary's size; a value that ties
with a limit is accepted; repeated rows get equal results and count each for the
bands; an empty table gives an empty result; a group without a passing document
has no band and rejects nothing more; a group whose texts all have one length has
a level line; all other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmart.llm.byte_bpe import public_vocabulary, read_ranks
from metricmart.llm.common import byte_values, fresh_name, materialise, runs, table

MIN_WORDS = 50
#: Words in repeated 3-word windows, per 100 words, above which a text fails.
MAX_REPEAT_PERCENT = 50
BAND_SIGMAS = 6.0
BAND_FLOOR = 0.15
#: The same for the upper side: another language that a vocabulary covers better is no fault.
BAND_CEILING = 0.35
#: Least width of the entropy band to each side, as a share of the highest possible entropy.
ENTROPY_FLOOR = 0.12
#: Share of fallback tokens that any group may have.
FALLBACK_SHARE = 0.10
#: Accuracy of the quartiles' ranks: 1 / QUARTILE_ACCURACY.
QUARTILE_ACCURACY = 10_000
#: Distinct words whose tokens a Python worker keeps; then the cache starts anew.
CACHE_WORDS = 400_000
CACHE_BYTES = 48

SYMBOLS = b"#*$%&|<>"
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Measures with a band around their median; entropy has one around its line.
BANDED = ("chars_per_piece", "chars_per_byte_token", "fallback_share")
MEASURES = (*BANDED, "token_entropy")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = T.StructType([
    *[T.StructField(c, T.LongType()) for c in COUNTS],
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("fertility_group", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in (*MEASURES, "highest_entropy")],
])
_ARROW = pa.struct([
    *[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), ("fertility_group", pa.string()),
    *[(c, pa.float64()) for c in (*MEASURES, "highest_entropy")],
])


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(WHITE_SPACE)]
    return len(lines) - len(set(lines))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = ids[:-2] * len(number) + ids[1:-1]
    if len(number) >= 1 << 21:  # three numbers no longer fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, n = np.unique(pairs * len(number) + ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[which] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


@lru_cache(maxsize=100_000)
def _script(char: str) -> str:
    return unicodedata.name(char, "").split(" ")[0].split("-")[0] if char.isalpha() else ""


def script_of(text: str) -> str:
    """The script of most letters ("none" without a letter); the first by name on a tie."""
    seen: Counter = Counter()
    for char, n in Counter(text).items():
        if script := _script(char):
            seen[script] += n
    return min(seen, key=lambda s: (-seen[s], s)) if seen else "none"


class Fertility:
    """Token measures of word lists under a piece and a byte-level vocabulary."""

    def __init__(self, piece_model: str, rank_file: str, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.byte_level = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=read_ranks(rank_file), special_tokens={})
        self.size = self.pieces.get_piece_size()
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        self.cache: dict[bytes, tuple[bytes, int]] = {}

    def _word(self, word: bytes) -> tuple[bytes, int]:
        text = word.decode()
        found = np.array(self.pieces.encode(text), "<u4").tobytes(), len(self.byte_level.encode_ordinary(" " + text))
        if len(word) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def measure(self, words: list[bytes], chars: int) -> tuple[float | None, ...]:
        """MEASURES of a text's words; None without a word or a token."""
        if not words:
            return (None,) * len(MEASURES)
        get, make = self.cache.get, self._word
        found = [get(w) or make(w) for w in words]
        counts = np.bincount(np.frombuffer(b"".join([ids for ids, _ in found]), "<u4"), minlength=self.size)
        total = int(counts.sum())
        if not total:  # the vocabulary drops some control characters
            return (None,) * len(MEASURES)
        share = counts[counts > 0] / total
        return (
            chars / total, chars / sum([n for _, n in found]),
            float(counts[self.fallback].sum()) / total, float(-(share * np.log2(share)).sum()),
        )

    def highest_entropy(self, chars: int, per_piece: float | None) -> float | None:
        """The most entropy that the pieces of a text can have."""
        return None if per_piece is None else math.log2(min(round(chars / per_piece), self.size))


@lru_cache(maxsize=2)
def _fertility(piece_model: str, rank_file: str, pattern: str) -> Fertility:
    return Fertility(piece_model, rank_file, pattern)


def measure(docs: DataFrame, column: str, piece_model: str, rank_file: str, pattern: str) -> DataFrame:
    """``docs`` (text, lang and whatever else) with a struct ``column`` of counts, group and measures."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = _fertility(piece_model, rank_file, pattern)
        for batch in batches:
            for run in runs(batch, "text"):
                rows = []
                for raw, lang in zip(byte_values(run.column("text")), run.column("lang").to_pylist()):
                    text, words = raw.decode(), raw.split()
                    n, chars = len(words), len(text) - sum(map(text.count, WHITE_SPACE))
                    again, found = repeated_words(words), fertility.measure(words, chars)
                    rows.append((
                        n, chars, sum(raw.count(s) for s in SYMBOLS), duplicate_lines(text), again,
                        n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n,
                        f"lang {lang}" if lang is not None else f"script {script_of(text)}",
                        *found, fertility.highest_entropy(chars, found[0]),
                    ))
                fields = [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)]
                yield pa.RecordBatch.from_arrays([*run.columns, pa.StructArray.from_arrays(fields, fields=list(_ARROW))], names=schema.names)

    schema = T.StructType([*docs.schema.fields, T.StructField(column, MEASURED)])
    return docs.mapInArrow(add, schema)


def _from_line(measured: str, line: str) -> Column:
    """Share of the highest entropy that a text has, less what its group's line gives for its length."""
    highest = F.col(f"{measured}.highest_entropy")
    share = F.try_divide(F.col(f"{measured}.token_entropy"), highest)
    return share - (F.col(f"{line}.slope") * highest + F.col(f"{line}.level"))


def _limits(quartiles: str, below: Column | float, above: Column | float) -> tuple[Column, Column]:
    """Lowest and highest accepted value, no nearer to the median than ``below`` and ``above``."""
    low, middle, high = (F.col(quartiles)[i] for i in range(3))
    spread = BAND_SIGMAS * (high - low) / 1.349
    return middle - F.greatest(spread, F.lit(below)), middle + F.greatest(spread, F.lit(above))


def bands(measured: DataFrame, column: str) -> DataFrame:
    """band_group, the lowest and highest accepted value of each of BANDED, and the entropy's line
    (slope, level) with the lowest and highest accepted difference from it.

    Two aggregations, each of a row a task and group: medians and lines, then differences from lines."""
    quartiles = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], QUARTILE_ACCURACY)
    m = measured.select(F.col(column).alias("m")).filter("NOT m.base_failed")
    share, highest = F.try_divide("m.token_entropy", "m.highest_entropy"), F.col("m.highest_entropy")
    slope = F.coalesce(F.regr_slope(share, highest), F.lit(0.0))
    lines = m.groupBy(F.col("m.fertility_group").alias("band_group")).agg(
        *[quartiles(f"m.{c}").alias(c) for c in BANDED],
        slope.alias("slope"), (F.avg(share) - slope * F.avg(F.when(share.isNotNull(), highest))).alias("level"))
    lines = materialise(lines, "lines")
    line = lines.select(F.struct("band_group", "slope", "level").alias("line"))
    differences = m.join(line, F.col("m.fertility_group") == F.col("line.band_group")).groupBy(
        F.col("line.band_group").alias("band_group")).agg(quartiles(_from_line("m", "line")).alias("entropy"))
    out = []
    for c in BANDED:
        low, high = _limits(c, BAND_FLOOR * F.col(c)[1], BAND_CEILING * F.col(c)[1])
        if c == "fallback_share":  # any text may hold a few fallback tokens, or none
            out.append(F.greatest(high, F.lit(FALLBACK_SHARE)).alias(f"high_{c}"))
        else:
            out += [low.alias(f"low_{c}"), high.alias(f"high_{c}")]
    low, high = _limits("entropy", ENTROPY_FLOOR, ENTROPY_FLOOR)
    return lines.join(differences, "band_group").select(
        "band_group", *out, "slope", "level", low.alias("low_entropy"), high.alias("high_entropy"))


def judge(measured: DataFrame, column: str, limits: DataFrame, verdict: str) -> DataFrame:
    """``measured`` with a boolean ``verdict``: passes the base rules and every band of its group."""
    box = fresh_name(measured, "band")
    m = measured.join(limits.select(F.struct("*").alias(box)), F.col(f"{column}.fertility_group") == F.col(f"{box}.band_group"), "left")
    limit = lambda c: F.col(f"{box}.{c}")
    from_line = _from_line(column, box)
    checks = [from_line >= limit("low_entropy"), from_line <= limit("high_entropy")]
    for c in BANDED:
        checks.append(F.col(f"{column}.{c}") <= limit(f"high_{c}"))
        if c != "fallback_share":
            checks.append(F.col(f"{column}.{c}") >= limit(f"low_{c}"))
    within = F.lit(True)
    for check in checks:
        within = within & F.coalesce(check, F.lit(True))
    return m.select(*measured.columns, (~F.col(f"{column}.base_failed") & within).alias(verdict))


def public_files() -> tuple[str, str, str]:
    """Piece model, rank file and pattern of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), *public_vocabulary()


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; each text is tokenised once."""
    column, verdict = fresh_name(docs, "measured"), fresh_name(docs, "verdict")
    measured = materialise(measure(docs, column, *public_files()), "quality")
    judged = judge(measured, column, materialise(bands(measured, column), "bands"), verdict)
    return judged.filter(F.col(verdict)).select(*docs.columns)


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, token measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured = materialise(measure(docs, "m", *public_files()).select("doc_id", "m"), "quality")
    judged = judge(measured, "m", materialise(bands(measured, "m"), "bands"), "kept")
    return judged.select("doc_id", "m.*", "kept")
