"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The steps are those of induced sorting (classify suffixes, sort the
leftmost-smaller substrings, name them, recurse, induce); each scan goes over
batches of buckets instead of single suffixes. A batch of buckets is a range
within which no suffix induces one in another bucket of the range, so a whole
batch can be induced by array operations; suffixes that induce into their own
bucket (runs of one symbol) take a round each.
"""

from __future__ import annotations

import numpy as np


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last (the sentinel) counts as smaller."""
    n = len(text)
    step = np.append(np.sign(text[1:].astype(np.int64) - text[:-1]), 1)
    decides = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    return step[decides] > 0


def _places(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For grouped bucket numbers: rank inside the group, and the groups with their sizes."""
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(starts, len(bucket)))
    return np.arange(len(bucket)) - np.repeat(starts, sizes), bucket[starts], sizes


def _put(suffixes: np.ndarray, bucket: np.ndarray, array: np.ndarray, edge: np.ndarray, direction: int) -> None:
    """Append suffixes, grouped by bucket, at their buckets' moving edges."""
    rank, groups, sizes = _places(bucket)
    if direction > 0:
        array[edge[bucket] + rank] = suffixes
    else:
        array[edge[bucket] - 1 - rank] = suffixes
    edge[groups] += direction * sizes


def runs_before(text: np.ndarray) -> np.ndarray:
    """How many symbols right before each place equal its own."""
    at = np.arange(len(text))
    return at - np.maximum.accumulate(np.where(np.append(True, text[1:] != text[:-1]), at, 0))


def _along_runs(front: np.ndarray, text: np.ndarray, run: np.ndarray) -> np.ndarray:
    """What suffixes induce into their own buckets: for each bucket, first the one symbol longer
    suffixes of all of them in their order, then the two symbols longer ones, and so on."""
    n = run[front]
    some = np.flatnonzero(n)
    if not len(some):
        return front[:0]
    n = n[some]
    number = np.repeat(some, n)
    longer = np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n) + 1
    suffix = front[number] - longer
    return suffix[np.lexsort((number, longer, text[suffix]))]


def _induce_larger(text, smaller, run, array, starts):
    """Place every larger-type suffix, by a scan to the right over batches of buckets."""
    symbols = len(starts) - 1
    head = starts[:-1].copy()
    at = np.flatnonzero(text[:-1] > text[1:])
    target = np.full(symbols + 1, symbols, np.int64)  # least other bucket that a bucket induces into
    np.minimum.at(target, text[at + 1], text[at])
    stop = np.minimum.accumulate(target[::-1])[::-1]
    low = 0
    while low < symbols:
        high = int(stop[low])
        region = array[starts[low] : starts[high]]
        front = region[region >= 0]
        front = _along_runs(front[~smaller[front]], text, run)
        if len(front):
            _put(front, text[front], array, head, 1)
        front = region[region > 0] - 1
        front = front[text[front] > text[front + 1]]
        if len(front):
            front = front[np.argsort(text[front], kind="stable")]
            _put(front, text[front], array, head, 1)
        low = high


def _induce_smaller(text, smaller, run, array, starts):
    """Place every smaller-type suffix, by a scan to the left over batches of buckets."""
    symbols = len(starts) - 1
    tail = starts[1:].copy()
    at = np.flatnonzero(text[:-1] < text[1:])
    target = np.full(symbols, -1, np.int64)
    np.maximum.at(target, text[at + 1], text[at])
    stop = np.maximum.accumulate(target)
    high = symbols
    while high > 0:
        low = int(stop[high - 1]) + 1
        region = array[starts[low] : starts[high]]
        front = region[region >= 0][::-1]
        front = _along_runs(front[smaller[front]], text, run)
        if len(front):
            _put(front, text[front], array, tail, -1)
        front = region[region > 0][::-1] - 1
        front = front[text[front] < text[front + 1]]
        if len(front):
            front = front[np.argsort(text[front], kind="stable")]
            _put(front, text[front], array, tail, -1)
        high = low


def _induce(text, smaller, run, seeds, starts):
    """The array that the given leftmost-smaller suffixes (ordered within their buckets) induce."""
    array = np.full(len(text), -1, np.int64)
    last_first = seeds[::-1]
    last_first = last_first[np.argsort(text[last_first], kind="stable")]
    _put(last_first, text[last_first], array, starts[1:].copy(), -1)
    _induce_larger(text, smaller, run, array, starts)
    array[(array >= 0) & smaller[array]] = -1
    _induce_smaller(text, smaller, run, array, starts)
    array[0] = len(text) - 1
    return array


def _names(text: np.ndarray, ordered: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Ascending names of sorted leftmost-smaller substrings; equal ones share a name."""
    following = np.append(leftmost[1:], len(text) - 1)
    length = following[np.searchsorted(leftmost, ordered)] - ordered + 1
    differ = np.append(True, length[1:] != length[:-1])
    open_ = np.flatnonzero(~differ)
    d = 0
    while len(open_):
        open_ = open_[length[open_] > d]
        other = text[ordered[open_] + d] != text[ordered[open_ - 1] + d]
        differ[open_[other]] = True
        open_ = open_[~other]
        d += 1
    return np.cumsum(differ) - 1


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Start places of the sorted suffixes of integers 0..symbols-1; the last is the only 0."""
    text = np.ascontiguousarray(text, np.int64)
    if len(text) == 1:
        return np.zeros(1, np.int64)
    smaller, run = smaller_types(text), runs_before(text)
    starts = np.append(0, np.cumsum(np.bincount(text, minlength=symbols)))
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    array = _induce(text, smaller, run, leftmost, starts)
    is_leftmost = np.zeros(len(text), bool)
    is_leftmost[leftmost] = True
    ordered = array[is_leftmost[array]]
    names = _names(text, ordered, leftmost)
    if names[-1] + 1 < len(names):
        name_at = np.zeros(len(text), np.int64)
        name_at[ordered] = names
        ordered = leftmost[suffix_array(name_at[leftmost], int(names[-1]) + 1)]
    return _induce(text, smaller, run, ordered, starts)


def permuted_prefixes(text: np.ndarray, array: np.ndarray, separators: int) -> np.ndarray:
    """For each place, the symbols (from ``separators`` on) it shares with the suffix sorted before it.

    Where the suffix before moved along by one, so did the shared prefix, which
    is one shorter; only elsewhere are symbols compared."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[array[1:]] = array[:-1]
    before[array[0]] = -1
    place = np.arange(n)
    compared = np.ones(n, bool)
    moved = (before[1:] > 0) & (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    at = np.flatnonzero(moved) + 1
    same = (text[at - 1] == text[before[at] - 1]) & (text[at - 1] >= separators)
    compared[at[same]] = False
    compared[array[0]] = True
    shared = np.zeros(n, np.int64)
    open_ = np.flatnonzero(compared & (before >= 0))
    d = 0
    while len(open_):
        open_ = open_[np.maximum(open_, before[open_]) + d < n]
        own = text[open_ + d]
        open_ = open_[(own == text[before[open_] + d]) & (own >= separators)]
        d += 1
        shared[open_] = d
    origin = np.maximum.accumulate(np.where(compared, place, 0))
    return shared[origin] - (place - origin)
