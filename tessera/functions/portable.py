"""Column helpers that give the same values in Spark and in other SQL engines."""

from __future__ import annotations

import functools
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bucket(value: Column, n: int) -> Column:
    """A hash bucket from md5, equal in every engine."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("long") % n


def share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def title_norm(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of three letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b))


def all_words(text: Column, words: list[str]) -> Column:
    """AND of ILIKE for each word, with the wildcards of LIKE taken literally."""
    escape = lambda w: w.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return functools.reduce(operator.and_, [text.ilike(f"%{escape(w)}%") for w in words])


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used, strict=True) if u), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity, raised for a common prefix of up to four letters where it is above 0.7."""
    s = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return s + prefix * 0.1 * (1 - s) if s > 0.7 else s


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
