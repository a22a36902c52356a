"""Invariants of the full model configurations: seed
reproducibility, predictions inside the label range, importances summing
to 1, fold scores for every fold, the comparison table shape."""

import math

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wardstats.operators import models as G
from wardstats.plans.model_queries import MODEL_FEATURES, model_input


def test_forest_reproducible_and_in_range(spark):
    mi = model_input(spark, SF_SMALL)
    s1, tr = G.fit_predict(mi, MODEL_FEATURES, "wait_min", G.RANDOM_FOREST, numTrees=10)
    s2, _ = G.fit_predict(mi, MODEL_FEATURES, "wait_min", G.RANDOM_FOREST, numTrees=10)
    a = sorted((r.id, r.y_pred) for r in s1.collect())
    b = sorted((r.id, r.y_pred) for r in s2.collect())
    assert a == b
    lo, hi = mi.agg(F.min("wait_min"), F.max("wait_min")).first()
    assert all(lo - 1e-9 <= p <= hi + 1e-9 for _, p in a)
    imp = G.feature_importance(tr, MODEL_FEATURES)
    assert math.isclose(sum(r.score for r in imp.collect()), 1.0, rel_tol=1e-9)


def test_boosting_and_kernel_models_fit(spark):
    mi = model_input(spark, SF_SMALL)
    s, tr = G.fit_predict(mi, MODEL_FEATURES, "wait_min", G.BOOSTING, maxIter=5)
    assert s.filter(F.col("y_pred").isNull()).count() == 0 and tr.seconds >= 0
    k, _ = G.fit_predict(mi, MODEL_FEATURES, "wait_min", G.KERNEL, options=G.TrainOptions(rff_components=16))
    assert k.count() == mi.count()


def test_cv_scores_every_fold(spark):
    out = G.cv_fold_r2(model_input(spark, SF_SMALL), ["triage_time_min"], "wait_min", G.LINEAR, 5).collect()
    assert sorted(r.fold for r in out) == [0, 1, 2, 3, 4]
    assert all(r.r2 is not None and r.r2 <= 1.0 for r in out)


def test_train_compare_table(spark):
    _, cmp, imp, status = G.train_models(model_input(spark, SF_SMALL), MODEL_FEATURES, "wait_min",
                                         names=(G.LINEAR, "Decision Tree", "no such model"), dataset="visits")
    rows = cmp.collect()
    assert {r.model: (r.status, r.message is None) for r in status.collect()} == {
        G.LINEAR: ("ok", True), "Decision Tree": ("ok", True), "no such model": ("failed", False)}
    assert {r.model for r in rows} == {G.LINEAR, "Decision Tree"}
    assert all(r.training_time is not None and r.cv_score >= 1e-5 for r in rows)
    assert {r.model for r in imp.collect()} == {G.LINEAR, "Decision Tree"}


def test_cross_validation_refits_on_noise(spark):
    """A deep tree fits noise on its own rows; refitted per fold it can't."""
    df = spark.range(400).select(F.col("id"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
                                 (F.xxhash64("id") % 1000 / 1000.0).alias("x"), (F.xxhash64("id", F.lit(1)) % 1000 / 1000.0).alias("y"))
    cmp = G.train_models(df, ["x"], "y", names=("Decision Tree",)).comparison.first()
    folds = [r.r2 for r in G.refit_scores(df, ["x"], "y", "Decision Tree").collect()]
    assert len(folds) == 5 and sum(folds) / 5 < 0 and cmp.cv_score <= 1e-5


def test_all_models_failing_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError, match="no model could be trained"):
        G.train_models(model_input(spark, SF_SMALL), MODEL_FEATURES, "wait_min", names=("no such model",))


def test_outlier_handling_inside_training(spark):
    """A line with two wild training rows: taken away, the fit is exact; test
    rows are scored whatever they are; a tenth or more outliers stay."""
    line = [(i, "train" if i % 5 else "test", float(i % 20), 2.0 * (i % 20) + 1) for i in range(100)]
    wild = [(200, "train", 500.0, 0.0), (201, "train", -400.0, 90.0), (202, "test", 300.0, 0.0)]
    df = spark.createDataFrame(line + wild, "id int, split string, x double, y double")
    options = G.TrainOptions(handle_outliers=True, scale_features=False)
    scored, trained = G.fit_predict(df, ["x"], "y", G.LINEAR, options=options)
    assert abs(trained.model.coefficients[0] - 2.0) < 1e-6 and abs(trained.model.intercept - 1.0) < 1e-6
    ids = {r.id for r in scored.collect()}
    assert 202 in ids and not ids & {200, 201}
    stored = G.fit_pipeline(df.filter("split = 'train'"), ["x"], "y", G.LINEAR, options)
    assert abs(stored.stages[-1].coefficients[0] - 2.0) < 1e-6
    plain, _ = G.fit_predict(df, ["x"], "y", G.LINEAR, options=G.TrainOptions(scale_features=False))
    assert {200, 201} <= {r.id for r in plain.collect()}
    many = spark.createDataFrame(line + [(300 + i, "train", 900.0 + i, 0.0) for i in range(20)], df.schema)
    kept, _ = G.fit_predict(many, ["x"], "y", G.LINEAR, options=options)
    assert kept.filter("id >= 300").count() == 20
