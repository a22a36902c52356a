"""Training of several models computes its rows once, scores held-out rows
only, and leaves nothing cached."""

from pyspark.sql import functions as F

from wardstats.operators import models as G


def test_fits_read_kept_rows_and_folds_score_held_out_rows(spark, monkeypatch):
    df = spark.range(300).select("id", F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
                                 (F.xxhash64("id") % 1000 / 1000.0).alias("x"), (F.col("id") % 7 + F.xxhash64("id") % 1000 / 500.0).alias("y"))
    fit, seen = G.fit_predict, []

    def watched(rows, *args, **kw):
        plan = rows._jdf.queryExecution().withCachedData().toString()
        scored, trained = fit(rows, *args, **kw)
        splits = {r.split for r in scored.select("split").distinct().collect()}
        seen.append(("InMemoryRelation" in plan, tuple(sorted(splits))))
        return scored, trained

    spark.catalog.clearCache()
    before = spark._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(G, "fit_predict", watched)
    out = G.train_models(df, ["x"], "y", names=("Decision Tree",), options=G.TrainOptions(cv_folds=3))
    assert sorted(seen) == [(True, ("test",))] * 3 + [(True, ("test", "train"))]
    assert spark._jsc.getPersistentRDDs().size() == before
    row = out.comparison.first()
    monkeypatch.undo()
    r2 = [r.r2 for r in G.refit_scores(df, ["x"], "y", "Decision Tree", folds=3).collect()]
    mean = sum(r2) / 3
    assert row.cv_score == round(max(mean, 1e-5), 6) and abs(row.cv_std - (sum((v - mean) ** 2 for v in r2) / 3) ** 0.5) < 2e-6
    assert out.scored.count() == 300 and out.status.first().status == "ok"
