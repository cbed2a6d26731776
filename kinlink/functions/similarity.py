"""Similarity of strings and token sets.

Set measures and the edit distance are expressions.  Measures built on the longest common
subsequence, and Jaro-Winkler, need loops Spark lacks and run as Arrow-batched UDFs.
Scores are 0 to 100 except Jaro-Winkler (0 to 1) and distances.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import joined, tokens


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        m = row & at.get(ch, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 * 2 * _lcs(a, b) / n if n else 100.0


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of its length in the longer, cut at both ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(_ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def _sorted(a: str) -> str:
    return " ".join(sorted(a.split()))


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = " ".join(filter(None, [both, " ".join(sorted(x - y))])), " ".join(filter(None, [both, " ".join(sorted(y - x))]))
    best = _ratio(left, right)
    return max(best, _ratio(both, left), _ratio(both, right)) if both else best


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, u in zip(b, used) if u]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@lru_cache
def remembered(fn):
    """fn with its last values at hand, in each Python worker: names and streets meet again and again."""
    return lru_cache(1 << 15)(fn)


def _pairwise(fn):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        each = remembered(fn)
        return pd.Series([None if x is None or y is None else each(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def ratio(a: Column, b: Column) -> Column:
    return _pairwise(_ratio)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(joined(F.array_sort(tokens(a))), joined(F.array_sort(tokens(b))))


def token_set_ratio(a: Column, b: Column) -> Column:
    return _pairwise(_token_set)(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _pairwise(_partial)(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _pairwise(_jaro_winkler)(a, b)


def distance_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def contains_either(a: Column, b: Column, least: int = 5) -> Column:
    """1 if one text holds the other and both have ``least`` characters."""
    return F.when((F.length(a) >= least) & (F.length(b) >= least) & (F.contains(a, b) | F.contains(b, a)), 1).otherwise(0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def weighted(toks: Column, idf: Column) -> Column:
    """The weights of tokens in a map column; unknown tokens weigh 0."""
    return F.transform(toks, lambda t: F.coalesce(F.element_at(idf, t), F.lit(0.0)))


def idf_features(a: Column, b: Column, idf: Column) -> dict[str, Column]:
    """Weighted Jaccard, the rarest shared token, the rarest token that isn't shared."""
    both, union = F.array_intersect(a, b), F.array_union(a, b)
    total = _sum(weighted(union, idf))
    apart = F.array_except(union, both)
    return {
        "idf_jac": F.when(total > 0, _sum(weighted(both, idf)) / total).otherwise(0.0),
        "idf_maxshared": F.coalesce(F.array_max(weighted(both, idf)), F.lit(0.0)),
        "idf_maxunshared": F.coalesce(F.array_max(weighted(apart, idf)), F.lit(0.0)),
    }


def number_features(a: Column, b: Column) -> dict[str, Column]:
    """Of two arrays of numbers, first numbers first: shared, Jaccard (-1 if both are empty), difference, equality of the first (-1 if one is missing), first of either among the other's."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    shared, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    first_a, first_b = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    return {
        "num_shared": shared,
        "num_jac": F.when(union > 0, shared / union).otherwise(-1.0),
        "num_symdiff": union - shared,
        "num_first_eq": F.when((F.size(a) == 0) | (F.size(b) == 0), -1).otherwise((first_a == first_b).cast("int")),
        "num_first_in": F.when(F.coalesce(F.array_contains(y, first_a), F.lit(False)) | F.coalesce(F.array_contains(x, first_b), F.lit(False)), 1).otherwise(0),
    }


def equal_if_known(a: Column, b: Column) -> Column:
    """-1 if one side is empty, else 1 or 0."""
    return F.when((a == "") | (b == ""), -1).otherwise((a == b).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
