import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from metricmart.llm import quality as Q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed


def prose(rnd, n):
    return " ".join("".join(rnd.choice("aeiounrst") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_base_counts(spark, documents, sf):
    rnd = random.Random(5)
    signs = ["a", "b", "é", "\x1c", "\x85", "#", "<b>", "　", " ", "\n", "\t", "  ", "\x0b", "\r\n"]
    texts = [None, "", " \n ", "a b c a b c", "x\nx\n\n\nx \nx", "one two", "w " * 60, prose(rnd, 5000)]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.choice([5, 60, 300]))) for _ in range(80)]
    texts += texts[-3:]
    docs = documents(texts, [None, *range(1, len(texts))]).withColumn("m", F.lit(1)).withColumn("kept", F.lit("x"))
    rows = Q.op3_fertility(spark, sf(documents=docs)).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                  r.n_repeat_words, r.base_failed) for r in rows)
    assert got == [(i or -1, *brute(t)) for i, t in enumerate(texts)]
    assert not any(r.kept and r.base_failed for r in rows)


def test_three_numbers_beyond_63_bits():
    words = [str(i).encode() for i in range((1 << 21) + 5)]
    assert Q.repeated_words(words + words[7:12] + [b"x"] + words[7:9]) == 10


def test_measures_against_the_libraries():
    f = Q.Fertility(*Q.public_files())
    words = "the quick été 日本語 brown the".split()
    raw = [w.encode() for w in words]
    piece, byte, fallback, entropy = f.measure(raw, sum(map(len, words)))
    ids = [i for w in words for i in f.pieces.encode(w)]
    assert piece == sum(map(len, words)) / len(ids)
    assert byte == sum(map(len, words)) / sum(len(f.byte_level.encode_ordinary(" " + w)) for w in words)
    assert fallback == sum(f.pieces.is_byte(i) for i in ids) / len(ids)
    assert 0 < entropy <= 4


def test_bands_reject_other_fertility(spark, documents, sf):
    rnd = random.Random(6)
    good = [prose(rnd, 120) for _ in range(60)]
    bad = [" ".join(chr(rnd.randint(0x13A0, 0x13EF)) for _ in range(200)), " ".join(["aqzxj" * 3 + str(i) for i in range(90)])]
    docs = documents(good + bad, langs=["en"] * 62)
    rows = {r.doc_id: r for r in Q.op3_fertility(spark, sf(documents=docs)).collect()}
    assert all(rows[i].kept for i in range(60))
    assert not rows[60].kept and not rows[61].kept and not rows[60].base_failed
    kept = Q.keep_good(docs.withColumn("measured", F.lit(1)).withColumn("Verdict", F.lit(2)))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert kept.columns == [*docs.columns, "measured", "Verdict"]


def plain_verdicts(rows):
    """kept of each row (measures and group), by a plain model of bands and lines."""
    def limits(values, below, above):
        values = sorted(values)
        low, mid, high = (values[math.ceil(p * len(values)) - 1] for p in (0.25, 0.5, 0.75))
        spread = Q.BAND_SIGMAS * (high - low) / 1.349
        return mid - max(spread, below(mid)), mid + max(spread, above(mid))

    kept = {}
    for group in {r.fertility_group for r in rows}:
        own = [r for r in rows if r.fertility_group == group]
        good = [r for r in own if not r.base_failed]
        band = {c: limits([r[c] for r in good], lambda m: Q.BAND_FLOOR * m, lambda m: Q.BAND_CEILING * m) for c in Q.BANDED}
        band["fallback_share"] = -1, max(Q.FALLBACK_SHARE, band["fallback_share"][1])
        x, y = [r.highest_entropy for r in good], [r.token_entropy / r.highest_entropy for r in good]
        slope, level = np.polyfit(x, y, 1)
        away = {r.doc_id: r.token_entropy / r.highest_entropy - slope * r.highest_entropy - level for r in good}
        low, high = limits(away.values(), lambda m: Q.ENTROPY_FLOOR, lambda m: Q.ENTROPY_FLOOR)
        for r in own:
            kept[r.doc_id] = not r.base_failed and low <= away[r.doc_id] <= high and all(
                band[c][0] <= r[c] <= band[c][1] for c in Q.BANDED)
    return kept


def test_outliers_on_both_sides_of_each_measure(spark, documents, sf):
    rnd = random.Random(8)
    vocab = [prose(rnd, 1) for _ in range(400)]
    clean = [" ".join(rnd.choices(vocab, k=rnd.choice([60, 150, 400, 1500]))) for _ in range(300)]
    pieces = Q.Fertility(*Q.public_files()).pieces
    whole = [p[1:] for p in map(pieces.id_to_piece, range(pieces.get_piece_size())) if re.fullmatch("▁[a-z]+", p)]
    long, short = [w for w in whole if len(w) >= 9], [w for w in whole if len(w) <= 4]
    signs = "qxzjkwvQXZJKWV0123456789"
    planted = {  # what is out of its band, on which side
        ("chars_per_piece", 1): " ".join(rnd.sample(long, 150)),
        ("chars_per_byte_token", 1): " ".join(rnd.sample(long, 200)),
        ("chars_per_piece", -1): " ".join("".join(rnd.choices(signs, k=6)) for _ in range(150)),
        ("chars_per_byte_token", -1): " ".join("".join(rnd.choices(signs, k=5)) for _ in range(200)),
        ("fallback_share", 1): " ".join("".join(chr(rnd.randint(0x13A0, 0x13EF)) for _ in range(4)) for _ in range(90)),
        ("entropy", 1): " ".join(rnd.sample(short, 700)),
        ("entropy", -1): " ".join(rnd.choices(vocab[:9], k=60)),
    }
    docs = documents(clean + list(planted.values()))
    rows = Q.op3_fertility(spark, sf(documents=docs)).collect()
    got = {r.doc_id: r for r in rows}
    assert sum(got[i].kept for i in range(300)) >= 0.99 * 300
    measured = Q.measure(docs, "m", *Q.public_files())
    band = Q.bands(measured, "m").first()
    for i, (measure, side) in enumerate(planted):
        r = got[300 + i]
        assert not r.kept and not r.base_failed, (measure, side)
        away = r.token_entropy / r.highest_entropy - band.slope * r.highest_entropy - band.level
        value = away if measure == "entropy" else r[measure]
        assert value > band[f"high_{measure}"] if side > 0 else value < band[f"low_{measure}"], (measure, side)
    assert {r.doc_id: r.kept for r in rows} == plain_verdicts(rows)
    # an upper limit that no text can reach would be none
    assert band.level + band.slope * 9 + band.high_entropy < 1


def test_one_length_one_document_and_words_without_tokens(spark, documents, sf):
    same = " ".join(f"word{i}" for i in range(60))
    docs = documents([same] * 3 + [prose(random.Random(1), 90), None], langs=["en"] * 3 + ["de", "xx"])
    rows = Q.op3_fertility(spark, sf(documents=docs)).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True] * 4 + [False]
    f = Q.Fertility(*Q.public_files())
    f.cache[b"none"] = b"", 1
    assert f.measure([b"none"], 4) == (None,) * len(Q.MEASURES)


def test_very_long_text(spark, documents, sf):
    rnd = random.Random(9)
    vocab = [prose(rnd, 1) for _ in range(3000)]
    texts = [" ".join(rnd.choices(vocab, k=rnd.choice([100, 1000, 8000]))) for _ in range(30)]
    texts.append(" ".join(rnd.choices(vocab, k=300_000)))
    row = Q.op3_fertility(spark, sf(documents=documents(texts))).filter("doc_id = 30").first()
    assert row.n_words == 300_000 and row.highest_entropy == math.log2(32000)
    assert row.base_failed == brute_repeats(texts[30]) and row.token_entropy < row.highest_entropy


def brute_repeats(text):
    words = text.split(" ")
    windows = list(zip(words, words[1:], words[2:]))
    n = Counter(windows)
    return 100 * len({j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}) > 50 * len(words)


def test_group_by_script_without_language(documents, spark, sf):
    docs = documents(["слово " * 9, "word " * 9, "12", None], langs=[None] * 4)
    groups = [r.fertility_group for r in Q.op3_fertility(spark, sf(documents=docs)).orderBy("doc_id").collect()]
    assert groups == ["script CYRILLIC", "script LATIN", "script none", "script none"]


def test_empty_table(spark, documents, sf):
    assert Q.op3_fertility(spark, sf(documents=documents([]))).count() == 0
    assert Q.keep_good(documents([])).count() == 0
