"""Brute-force forms of the pipeline's stages for small tables."""

from test_decontaminate import brute as contaminated_rows
from test_line_dedup import brute as lines_left
from test_simhash import plain_components, plain_fingerprint


def brute_lines(texts):
    return lines_left(list(texts.items()))


def brute_one_of_each(texts):
    ids = list(texts)
    kept = set(plain_components([plain_fingerprint(texts[i]) for i in ids], ids))
    return {i: t for i, t in texts.items() if i in kept}


def brute_contaminated(text, items):
    return contaminated_rows([text], items)[0][-1]
