"""Pair similarities: set and number features as Column expressions, string metrics as Arrow-batched UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_distinct(a)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(0.0)


def conflict(a: Column, b: Column) -> Column:
    """1 if both have members and none in common, 0 if one is shared, -1 if they cannot be compared."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.when(F.arrays_overlap(a, b), 0).otherwise(1)).otherwise(-1)


def house(a: Column, b: Column) -> dict[str, Column]:
    """Prefix, log distance, edit distance and equal length of two house numbers; -1 if one is missing."""
    both = (F.length(a) > 0) & (F.length(b) > 0)
    near = lambda x: F.substring(x, 1, 9).cast("int")
    flag = lambda c: F.when(both, F.when(c, 1.0).otherwise(0.0)).otherwise(-1.0)
    return {
        "house_prefix": flag((a != b) & (a.startswith(b) | b.startswith(a))),
        "house_absdiff": F.when(both, F.log1p(F.abs(near(a) - near(b)).cast("double"))).otherwise(-1.0),
        "house_lev": F.when(both, F.levenshtein(a, b).cast("double")).otherwise(-1.0),
        "house_samelen": flag(F.length(a) == F.length(b)),
    }


def indel(a: str, b: str) -> float:
    """2 * LCS / (len a + len b), the LCS by bit-parallel rows."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def partial(a: str, b: str) -> float:
    """The best indel similarity of the shorter string with a stretch of the longer as long, or its cut ends."""
    if len(a) == len(b) and a != b:
        return max(_partial(a, b), _partial(b, a))
    return _partial(a, b) if len(a) <= len(b) else _partial(b, a)


def _partial(a: str, b: str) -> float:
    if not a:
        return 1.0 if not b else 0.0
    spans = [(i, i + len(a)) for i in range(len(b) - len(a) + 1)] + [(0, k) for k in range(1, len(a))] + [(len(b) - k, len(b)) for k in range(1, len(a))]
    return max(indel(a, b[x:y]) for x, y in spans)


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best of the common words against each side's words, and the sides against each other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if common and (not x - y or not y - x):
        return 1.0
    left, right = (" ".join([common, *sorted(s)]).strip() for s in (x - y, y - x))
    return max([indel(left, right), *([indel(common, left), indel(common, right)] if common else [])])


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, lifted by a common prefix of up to four where it is over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(matched, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def _batched(f):  # noqa: ANN001, ANN202
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for key in zip(a.fillna(""), b.fillna(""), strict=True):
            if key not in seen:
                seen[key] = f(*key)
            out.append(seen[key])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")


def ratio(a: Column, b: Column) -> Column:
    return _batched(indel)(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _batched(partial)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _batched(token_sort)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _batched(token_set)(a, b)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    return _batched(jaro_winkler)(a, b)


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
