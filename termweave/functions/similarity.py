"""String similarity on a scale of 0 to 100, from the published definitions; code points, bit-parallel."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-integer step a character of ``b``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths."""
    if a == b:
        return 100.0
    total = len(a) + len(b)
    return 200.0 * _lcs(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ``ratio`` of the shorter text with a stretch of the longer that is no longer than it."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    best = max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))
    if len(b) == n and best < 100.0:
        best = max(best, max(ratio(b, a[max(0, i) : i + n]) for i in range(1 - n, n)))
    return best


@functools.lru_cache(maxsize=100_000)
def _words(text: str) -> tuple[str, frozenset[str]]:
    words = text.split()
    return " ".join(sorted(words)), frozenset(words)


def _token_ratio(a: str, b: str) -> float:
    (sorted_a, set_a), (sorted_b, set_b) = _words(a), _words(b)
    best = ratio(sorted_a, sorted_b)
    both = set_a & set_b
    if not set_a or not set_b:
        return best
    only_a, only_b = " ".join(sorted(set_a - both)), " ".join(sorted(set_b - both))
    if both and (not only_a or not only_b):
        return 100.0
    shared = " ".join(sorted(both))
    with_a, with_b = (f"{shared} {x}".strip() for x in (only_a, only_b))
    best = max(best, ratio(with_a, with_b))
    return max(best, ratio(shared, with_a), ratio(shared, with_b)) if both else best


def _partial_token_ratio(a: str, b: str) -> float:
    (sorted_a, set_a), (sorted_b, set_b) = _words(a), _words(b)
    if set_a & set_b:
        return 100.0
    return max(partial_ratio(sorted_a, sorted_b), partial_ratio(" ".join(sorted(set_a)), " ".join(sorted(set_b))))


def weighted_ratio(a: str, b: str) -> float:
    """The best of whole, word-wise and partial ratios, weighted by how far the lengths differ."""
    if not a or not b:
        return 0.0
    whole = ratio(a, b)
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    if lengths < 1.5:
        return max(whole, 0.95 * _token_ratio(a, b))
    part = 0.9 if lengths <= 8.0 else 0.6
    return max(whole, part * partial_ratio(a, b), 0.95 * part * _partial_token_ratio(a, b))


def similarity_cap(a: Column, b: Column) -> Column:
    """A native upper bound of ``weighted_ratio`` (0 to 1), for a first choice among pairs.

    Of a one-word ``b`` that is no word of ``a``, no more letters can be in common than stand in both, in
    whatever order or stretch; with words in common, or of several words, the bound is 1.
    """
    kept = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))  # noqa: E731  # letters of x that y has
    la, lb = F.length(a), F.length(b)
    short, long = F.least(la, lb), F.greatest(la, lb)
    both = F.least(kept(a, b), kept(b, a))
    part = F.when(long < 1.5 * short, 1.0).when(long <= 8 * short, 0.9).otherwise(0.6)
    bound = F.greatest(2.0 * both / (la + lb), part * 2.0 * both / (short + both))
    return F.when((short == 0) | (both == 0), F.when(short == 0, 1.0).otherwise(0.0)).when(F.contains(b, F.lit(" ")) | F.array_contains(F.split(a, " "), b), 1.0).otherwise(bound)


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def weighted_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else weighted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
