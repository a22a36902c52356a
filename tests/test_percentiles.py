"""Distributed exact percentiles against NumPy, NULL keys, constant columns."""

import random

import numpy as np
from pyspark.sql import functions as F

from wardstats.functions import percentiles
from wardstats.functions.joins import lookup_join
from wardstats.functions.percentiles import grouped, percentile_of
from wardstats.functions.stats import corr
from wardstats.operators.profile import correlation_matrix, describe_numeric

PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0)


def test_percentiles_equal_numpy(spark, monkeypatch):
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 1) for _ in range(4000)], "b": [float(rng.randrange(4)) for _ in range(500)], None: [1e-7, 3e-7],
              "one": [5.0], "ties": [2.0] * 300 + [9.0], "none": [None, None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, x double")
    for accuracy in (percentiles.ACCURACY, 100):  # also with brackets that leave most rows to the gaps
        monkeypatch.setattr(percentiles, "ACCURACY", accuracy)
        got = {r.k: r for r in grouped(df, ["k"], percentile_of("x", PROBS).alias("q"), percentile_of(F.col("x") * 2, 0.5).alias("m"), F.count("x").alias("n")).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            if vs[0] is None:
                assert got[k].n == 0 and got[k].m is None
                continue
            assert np.allclose(got[k].q, np.quantile(vs, PROBS), rtol=1e-12, atol=0) and got[k].n == len(vs)
            assert np.isclose(got[k].m, 2 * np.median(vs))
    whole = grouped(df, [], percentile_of("x", 0.9).alias("q")).first()
    assert np.isclose(whole.q, np.quantile([v for vs in groups.values() for v in vs if v is not None], 0.9))
    assert grouped(df.limit(0), ["k"], percentile_of("x", 0.5).alias("q")).count() == 0


def test_plans_hold_no_group_in_one_task(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    plan = grouped(df, ["k"], percentile_of("x", [0.5]).alias("q"))._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_set" not in plan and "CartesianProduct" not in plan


def test_null_keys_join_and_constants_have_no_correlation(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, s int")
    assert {(r.k, r.s) for r in lookup_join(left, right, "k").collect()} == {(None, 10), ("a", 20), ("b", None)}
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (None, 5.0, 9.0)], "x double, c double, y double")
    got = {(r.col_a, r.col_b): r.corr for r in correlation_matrix(df).collect()}
    assert got["x", "c"] is None and got["x", "y"] == 1.0 and got["c", "c"] == 1.0
    assert df.agg(corr("x", "y")).first()[0] == 1.0
    assert describe_numeric(df).count() == 3
