"""Grids with ensemble prefixes, tuning inside training, and the
epsilon-insensitive fit against an exact small solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wardstats.operators import models as G
from wardstats.operators import tuning as T
from wardstats.plans.model_queries import MODEL_FEATURES, model_input


def _rows(spark):
    mi = model_input(spark, SF_SMALL).select("id", "split", F.col("wait_min").cast("double").alias("label"), *MODEL_FEATURES)
    return G.assemble(mi, MODEL_FEATURES).cache()


def _gap(df, a, b):
    return df.agg(F.max(F.abs(F.col(a) - F.col(b)))).first()[0]


def test_boosting_prefixes_equal_separate_fits(spark):
    rows = _rows(spark)
    train = rows.filter("split = 'train'")
    params = {"maxDepth": 3, "subsamplingRate": 0.8}
    got = T.prefix_predictions(G.estimator(G.BOOSTING, maxIter=6, **params).fit(train), rows, [2, 6], G.BOOSTING)
    for k, n in enumerate((2, 6)):
        alone = G.estimator(G.BOOSTING, maxIter=n, **params).fit(train).transform(got)
        assert _gap(alone, "prediction", f"_p{k}") < 1e-9, n


def test_forest_prefixes_are_the_mean_of_their_trees(spark):
    rows = _rows(spark)
    model = G.estimator(G.RANDOM_FOREST, numTrees=6, maxDepth=4).fit(rows.filter("split = 'train'"))
    got = model.transform(T.prefix_predictions(model, rows, [2, 6], G.RANDOM_FOREST))
    assert _gap(got, "prediction", "_p1") < 1e-9
    first, second = (t.setPredictionCol(f"t{i}") for i, t in enumerate(model.trees[:2]))
    both = second.transform(first.transform(got)).withColumn("mean", (F.col("t0") + F.col("t1")) / 2)
    assert _gap(both, "mean", "_p0") < 1e-9
    with pytest.raises(ValueError):
        T.prefix_predictions(model, rows, [7], G.RANDOM_FOREST)


def test_search_covers_the_grid_and_marks_one_best(spark):
    mi = model_input(spark, SF_SMALL)
    grid = {"numTrees": [1, 3], "maxDepth": [2, 4], "minInstancesPerNode": [1]}
    got = T.search(mi, MODEL_FEATURES, "wait_min", G.RANDOM_FOREST, grid, folds=3).collect()
    assert [r.point for r in got] == [0, 1, 2, 3] and all(r.n_folds == 3 for r in got)
    best = [r for r in got if r.best]
    assert len(best) == 1 and best[0].cv_r2 == max(r.cv_r2 for r in got)
    assert T.best_params(mi, MODEL_FEATURES, "wait_min", G.LINEAR) == {}
    assert len(T._points(T.reference_grid(G.BOOSTING))) == 81


def test_tuning_inside_training(spark):
    mi = model_input(spark, SF_SMALL)
    grids = {G.BOOSTING: {"maxIter": [1, 2], "maxDepth": [2]}}
    options = G.TrainOptions(enable_tuning=True, cv_folds=2)
    got = G.train_models(mi, MODEL_FEATURES, "wait_min", (G.BOOSTING, G.LINEAR), options=options, grids=grids)
    assert {r.status for r in got.status.collect()} == {"ok"}, got.status.collect()


def test_insensitive_fit_near_the_exact_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = x @ [1.5, -2.0, 0.3, 0.0] + 4 + rng.standard_t(2, 300)
    c, eps = 1.0, 0.1

    def loss(w, b):
        return 0.5 * w @ w + c * np.maximum(0, np.abs(y - x @ w - b) - eps).sum()

    # subgradient descent of the exact loss, averaged, as the small reference solver
    w, b, best = np.zeros(4), 0.0, np.inf
    for k in range(60_000):
        r = y - x @ w - b
        g = np.where(np.abs(r) > eps, np.sign(r), 0)
        gw, gb = w - c * x.T @ g, -c * g.sum()
        size = 0.5 / np.sqrt(k + 1) / max(np.sqrt(gw @ gw + gb * gb), 1e-9)
        w, b = w - size * gw, b - size * gb
        best = min(best, loss(w, b))
    rows = G.assemble(spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, d double, label double"), list("abcd"))
    model = G.insensitive_fit(rows, c, eps)
    got = loss(model.coefficients.toArray(), model.intercept)
    assert got <= best * 1.01
    assert abs(T.insensitive_loss(rows, model.coefficients.toArray(), model.intercept, c, eps) - got) < 1e-6 * got


def test_insensitive_fit_of_constant_labels(spark):
    rows = G.assemble(spark.createDataFrame([(float(i), 5.0) for i in range(20)], "a double, label double"), ["a"])
    model = G.insensitive_fit(rows)
    assert abs(model.intercept + 3 * model.coefficients[0] - 5.0) <= 0.1 + 1e-6
