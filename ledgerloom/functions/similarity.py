"""String similarity on Spark columns.

Everything rests on the length of the longest common subsequence.  It is the
one thing that needs Python: an Arrow UDF, bit-parallel, one evaluation for a
distinct pair as long as the worker remembers it.  Scores around it are native expressions.  Columns
passed in should be materialised after native filters, since Spark evaluates
Python UDFs before CASE branches.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Bit-parallel: bit j of ``v`` is 0 where the row grows at place j of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        m = where.get(ch)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


#: Answers that a worker remembers for each score; it forgets them all when there are more.
REMEMBERED = 1 << 19


def _remembered(score, pairs) -> list:
    """``score`` of each pair, once for a distinct pair as long as the worker remembers it."""
    seen = _ANSWERS.setdefault(score.__qualname__, {})
    if len(seen) > REMEMBERED:
        seen.clear()
    out = []
    for pair in pairs:
        got = seen.get(pair)
        if got is None:
            got = seen[pair] = score(*pair)
        out.append(got)
    return out


_ANSWERS: dict[str, dict] = {}


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_remembered(lcs, zip(a.fillna(""), b.fillna(""), strict=True)), dtype="int32")


def ratio_of(common: Column, a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * common / total)


def ratio(a: Column, b: Column) -> Column:
    """F30, 0 to 100."""
    return ratio_of(lcs_length(a, b), a, b)


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """F31."""
    return ratio(sorted_tokens(a), sorted_tokens(b))


def token_set(c: Column) -> Column:
    """Distinct tokens in order; worth keeping as a column, since a score reads it many times."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """F32."""
    return token_set_score(token_set(a), token_set(b))


def token_set_score(sa: Column, sb: Column) -> Column:
    """F32 on token sets."""
    both = F.array_join(F.array_sort(F.array_intersect(sa, sb)), " ")
    da, db = (F.array_join(F.array_sort(F.array_except(x, y)), " ") for x, y in ((sa, sb), (sb, sa)))
    s, x, y = F.length(both), F.length(da), F.length(db)
    sep = F.when(s > 0, 1).otherwise(0)
    indel = x + y - 2 * lcs_length(da, db)
    r1 = 100.0 * (1 - indel / F.nullif(2 * s + 2 * sep + x + y, F.lit(0)))
    r2 = 100.0 * (1 - (sep + x) / F.nullif(2 * s + sep + x, F.lit(0)))
    r3 = 100.0 * (1 - (sep + y) / F.nullif(2 * s + sep + y, F.lit(0)))
    return (
        F.when((F.size(sa) == 0) | (F.size(sb) == 0), 0.0)
        .when((s > 0) & ((x == 0) | (y == 0)), 100.0)
        .when(s == 0, r1)
        .otherwise(F.greatest(r1, r2, r3))
    )


def _ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def _partial(a: str, b: str) -> float:
    """The shorter against every window of the longer, cut windows at both ends included."""
    if len(a) == len(b):
        return max(_partial_of(a, b), _partial_of(b, a))
    return _partial_of(*sorted((a, b), key=len))


def _partial_of(short: str, long: str) -> float:
    n = len(short)
    if not n:
        return 100.0 if not long else 0.0
    return max(_ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def _token_scores(a: str, b: str) -> tuple[float, float, float]:
    ta, tb = sorted(a.split()), sorted(b.split())
    sort = _ratio(" ".join(ta), " ".join(tb))
    sa, sb = set(ta), set(tb)
    both, da, db = (" ".join(sorted(x)) for x in (sa & sb, sa - sb, sb - sa))
    if not sa or not sb:
        return sort, 0.0, 0.0
    if both and (not da or not db):
        return sort, 100.0, 100.0
    s, x, y = len(both), len(da), len(db)
    sep = 1 if s else 0
    full = 100.0 * (1 - (x + y - 2 * lcs(da, db)) / (2 * s + 2 * sep + x + y))
    if s:
        full = max(full, 100.0 * (1 - (sep + x) / (2 * s + sep + x)), 100.0 * (1 - (sep + y) / (2 * s + sep + y)))
    partial = 100.0 if both else max(_partial(" ".join(ta), " ".join(tb)), _partial(da, db))
    return sort, full, partial


def weighted(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    r = _ratio(a, b)
    spread = max(len(a), len(b)) / min(len(a), len(b))
    sort, full, partial_tokens = _token_scores(a, b)
    if spread < 1.5:
        return max(r, 0.95 * max(sort, full))
    scale = 0.9 if spread <= 8 else 0.6
    return max(r, scale * _partial(a, b), 0.95 * scale * partial_tokens)


def _pairwise(score):
    """A score of two texts as an Arrow UDF; ``score`` has a name of its own in its module or function."""

    @F.pandas_udf(T.DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_remembered(score, zip(a.fillna(""), b.fillna(""), strict=True)), dtype="float64")

    return udf


#: F33, F34, F37.
partial_ratio = _pairwise(_partial)
weighted_ratio = _pairwise(weighted)


def _sequence(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


sequence_ratio = _pairwise(_sequence)


def jaro_winkler(a: str, b: str) -> float:
    """L-F44's variant, 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    m, swaps = len(hits), sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return jaro + start * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


jaro_winkler_similarity = _pairwise(jaro_winkler)


def length_allows(a: Column, b: Column, percent: int) -> Column:
    """False only if no pair of such lengths reaches the ratio: a native filter ahead of the UDF."""
    total = F.length(a) + F.length(b)
    return 200 * F.least(F.length(a), F.length(b)) >= percent * total


def best_choice(word: Column, choices: Column, score) -> Column:
    """F36 on arrays: the first best (score, choice); null without choices."""
    scored = F.transform(choices, lambda c, i: F.struct(score(word, c).alias("score"), (-i).alias("place"), c.alias("choice")))
    return F.array_max(scored)


def substring_match(a: Column, b: Column) -> Column:
    """F41 on normalised names."""
    return (a != "") & (b != "") & F.when(F.length(a) <= F.length(b), F.contains(b, a)).otherwise(F.contains(a, b))
