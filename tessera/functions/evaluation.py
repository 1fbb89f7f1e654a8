"""Measures over the answers of an evaluation: few rows, on the driver, but for ROUGE-L, which is a column."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bootstrap(values, resamples: int = 10_000, level: float = 0.95, seed: int = 42) -> tuple[float, float, float]:
    """(Mean, low, high) by percentiles of the means of resamples; for paired arms give the differences."""
    x = np.asarray(values, float)
    rng = np.random.default_rng(seed)
    means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(resamples)])
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(x.mean()), float(low), float(high)


def sign_test(better: int, worse: int) -> float:
    """Two-sided exact p-value of so uneven a split; ties do not count."""
    n = better + worse
    tail = sum(math.comb(n, i) for i in range(min(better, worse) + 1))
    return min(1.0, 2 * tail / 2**n)


def rouge_l_of(answer: str | None, reference: str | None) -> float:
    """F1 of the longest common subsequence of words."""
    a, b = (re.findall(r"\w+", (x or "").lower()) for x in (answer, reference))
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for w in a:
        corner = 0
        for j, v in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if w == v else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def rouge_l(answer: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_of(a, b) for a, b in zip(answer, reference, strict=True)], dtype="float64")
