"""Trees that are grown once for all depths, against Spark ML's own fits."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from wardstats.operators import models as G
from wardstats.operators import trees as T

GRID = {"maxDepth": [2, 4, 30], "minInstancesPerNode": [1, 3]}


def _rows(spark, n=600, gaps=False):
    """Labels are whole numbers, so that sums don't depend on their order."""
    r = np.random.default_rng(5)
    x = np.stack([r.integers(0, 7, n), r.integers(0, 500, n), r.normal(size=n).round(3), np.full(n, 3)], 1).astype(float)
    y = (x[:, 0] * 3 + x[:, 1] // 40 + r.integers(0, 9, n)).astype(float)
    rows = [(int(i), "train" if i % 6 else "test", *(None if gaps and (i + j) % 11 == 0 else float(v) for j, v in enumerate(x[i])), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, split string, a double, b double, c double, d double, y double").coalesce(1)


def _separate(df, folds=3):
    data = G.assemble(df.filter("split = 'train'").withColumn("fold", G.fold_col("id", folds)).withColumnRenamed("y", "label"), list("abcd")).cache()
    ev = RegressionEvaluator(metricName="r2", labelCol="label")
    out = {}
    for d in GRID["maxDepth"]:
        for m in GRID["minInstancesPerNode"]:
            est = G.estimator("Decision Tree", maxDepth=d, minInstancesPerNode=m)
            r2 = [ev.evaluate(est.fit(data.filter(F.col("fold") != k)).transform(data.filter(F.col("fold") == k))) for k in range(folds)]
            out[f"maxDepth={d}, minInstancesPerNode={m}"] = np.mean(r2), np.std(r2)
    return out


@pytest.mark.parametrize("local", [T.LOCAL_ROWS, 40])
def test_grid_of_trees_equals_separate_fits(spark, monkeypatch, local):
    monkeypatch.setattr(T, "LOCAL_ROWS", local)
    df = _rows(spark)
    expected = _separate(df)

    def no_fit(*_, **__):
        raise AssertionError("one fit per grid point")

    monkeypatch.setattr(G, "CrossValidator", no_fit)
    got = {r.params: (r.cv_r2, r.cv_std) for r in G.grid_search(df, list("abcd"), "y", "Decision Tree", GRID, folds=3).collect()}
    assert list(got) == list(expected)
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


def test_one_value_makes_a_leaf_and_gaps_and_an_empty_fold_are_errors(spark):
    df = spark.createDataFrame([(i, "train", 1.0, float(i % 3)) for i in range(60)], "id long, split string, a double, y double")
    got = G.grid_search(df, ["a"], "y", "Decision Tree", {"maxDepth": [30]}, folds=3).first()
    assert got.cv_r2 <= 0 and got.best
    with pytest.raises(ValueError, match="NULL"):
        G.grid_search(_rows(spark, gaps=True), list("abcd"), "y", "Decision Tree", {"maxDepth": [2]}, folds=3)
    with pytest.raises(ValueError, match="empty"):
        G.grid_search(df.limit(1), ["a"], "y", "Decision Tree", {"maxDepth": [30]}, folds=3)
