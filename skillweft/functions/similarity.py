"""Text similarity scores on a 0-100 scale, computed for already selected pairs.

All scores rest on the length of the longest common subsequence:
``ratio = 200 * lcs / (len(a) + len(b))``.  Spark has no such expression, so the
scores are pandas UDFs; they see candidate pairs only, never whole tables.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# ship the scoring code with the tasks: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def letter_places(text: str) -> dict[str, int]:
    """Positions of every letter as bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(text):
        where[ch] = where.get(ch, 0) | (1 << i)
    return where


def lcs_length(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Longest common subsequence with one bit per character of ``a``."""
    if not a or not b:
        return 0
    where = letter_places(a) if where is None else where
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Compares shared words and the rest; a word set inside the other scores 100."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = left & right
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and (not only_left or not only_right):
        return 100.0
    shared = len(" ".join(both))
    gap = 1 if shared else 0
    len_left, len_right = shared + gap + len(only_left), shared + gap + len(only_right)
    distance = len(only_left) + len(only_right) - 2 * lcs_length(only_left, only_right)
    scores = [100.0 * (1 - distance / (len_left + len_right))]
    if shared:
        scores.append(100.0 * (1 - (gap + len(only_left)) / (shared + len_left)))
        scores.append(100.0 * (1 - (gap + len(only_right)) / (shared + len_right)))
    return max(scores)


def _best_window(short: str, long: str) -> float:
    size, best, where = len(short), 0.0, letter_places(short)
    spans = [long[i:i + size] for i in range(len(long) - size + 1)]
    # shorter windows at both ends, longest first: a window of n letters scores at most 200n / (size + n)
    for n in range(size - 1, 0, -1):
        spans += [long[:n], long[-n:]]
    for span in spans:
        total = size + len(span)
        if 200.0 * min(size, len(span)) / total <= best:
            break
        best = max(best, 200.0 * lcs_length(short, span, where) / total)
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _best_window(short, long)
    return max(best, _best_window(long, short)) if len(a) == len(b) and best < 100.0 else best


def skill_score(a: str, b: str, threshold: float) -> float:
    """Word-set score if it reaches the threshold, else the window score if that does, else 0."""
    if a == b:
        return 100.0
    shared, size = lcs_length(a, b), min(len(a), len(b))
    if " " in a or " " in b:
        score = token_set_ratio(a, b)
    else:  # one word each: the word-set score is the plain ratio
        score = 200.0 * shared / (len(a) + len(b)) if a and b else 0.0
    if score >= threshold:
        return score
    # no window shares more letters than the whole texts do
    if 200.0 * shared < threshold * (size + shared):
        return 0.0
    score = partial_ratio(a, b)
    return score if score >= threshold else 0.0


def skill_score_udf(threshold: float):
    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([skill_score(x, y, threshold) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score


@F.pandas_udf(DoubleType())
def token_sort_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
