"""Trees on counted rows, and link models and features without a row of Spark's for what is not returned."""

import numpy as np
import pytest

from tessera.operators import boosting, learning
from tessera.plans import staging
from tessera.plans.registry import all_queries
from tessera.plans.tables import Tables


def test_as_spark(spark):
    """On values that all have a bin, Spark's own trees give the same chances; on rows counted by cells, the same as on rows."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (3, 4000))
    y = (rng.random(4000) < 1 / (1 + np.exp(3 - 0.3 * x[0] - 0.05 * x[1] * (x[2] > 5)))).astype(int)
    df = spark.createDataFrame([(*map(float, c), float(l)) for c, l in zip(x.T, y, strict=True)], "p double, q double, r double, y double").coalesce(1)
    df = VectorAssembler(inputCols=["p", "q", "r"], outputCol="features").transform(df)
    model = GBTClassifier(labelCol="y", maxIter=6, maxDepth=4, seed=7).fit(df)
    want = np.array([r[0] for r in model.transform(df).select(vector_to_array("probability")[1]).collect()])
    bins = np.stack([boosting.bins_of(np.bincount(boosting.steps(c), minlength=boosting.STEPS)) for c in x])
    cell = boosting.cells(list(x), bins)
    kinds, at = np.unique(cell, return_inverse=True)
    counted = boosting.boost(boosting.apart(kinds, 3), np.bincount(at, y), np.bincount(at, 1 - y), 6)
    assert np.allclose(counted.chance(boosting.apart(kinds, 3))[at], want, atol=1e-6)


def test_bins():
    """Few values have a bin each; many are cut into bins of about equal numbers of rows, in order."""
    few = boosting.bins_of(np.bincount(boosting.steps(np.array([1, 2, 5, 5, 900])), minlength=boosting.STEPS))
    assert few[boosting.steps(np.array([1.0, 2, 5, 900]))].tolist() == [0, 1, 2, 3]
    x = np.random.default_rng(1).lognormal(0, 2, 100_000)
    many = boosting.bins_of(np.bincount(boosting.steps(x), minlength=boosting.STEPS))[boosting.steps(np.sort(x))]
    n = np.bincount(many)
    assert len(n) == boosting.BINS and (np.diff(many.astype(int)) >= 0).all() and n.max() < 1.2 * len(x) / boosting.BINS
    assert (boosting.bins_of(np.zeros(boosting.STEPS, np.int64)) == 0).all()


def test_no_pair_is_written(spark, sf, monkeypatch):
    """The model writes teams and their blocks and nothing a pair, deals no pair, and tells those that come true better than chance."""
    written = []
    kept = staging.new_path
    monkeypatch.setattr(staging, "new_path", lambda spark, name: written.append(name) or kept(spark, name))
    df = all_queries()["gbt_train"].on(Tables(spark, sf))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(set(written)) == ["homes", "teams"] and not any(x in plan for x in ("Join", "Window", "Aggregate", "InMemory"))
    rows = df.collect()
    ones, zeros = np.array([r["p"] for r in rows if r["y"]]), np.array([r["p"] for r in rows if not r["y"]])
    assert len(ones) and all(0 < r["p"] < 1 for r in rows)
    assert ((ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2) > 0.5


@pytest.mark.parametrize("name", ["link_features", "gbt_train"])
def test_rows_as_returned(spark, sf, name):
    """What a task finds is what is returned: Spark computes and rounds nothing."""
    plan = all_queries()[name].on(Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow") and "round(" not in plan


def test_rounded():
    from tessera.operators.joins import rounded

    assert rounded(np.array([1 / 128, 1 / 3, 0.5, 0.0, 1.0])).tolist() == [0.007813, 0.333333, 0.5, 0.0, 1.0]
    assert learning.tested(7) == (int(__import__("hashlib").md5(b"8").hexdigest()[:8], 16) % 10 < 3)
