"""Profiling and preprocessing operators on literal frames."""

import math

import numpy as np
from pyspark.sql import functions as F

from wardstats.operators import outliers as E
from wardstats.operators import prep as P
from wardstats.operators import profile as B


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    xs = rng.exponential(10, 500).round(3)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r["count"] for r in B.histogram(df, "x", 30).orderBy("bin").collect()]
    exp, _ = np.histogram(xs, bins=30)
    assert got == list(exp)


def test_kde_close_to_exact(spark):
    rng = np.random.default_rng(2)
    xs = rng.normal(5, 2, 400)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = B.kde_grid(df, "x", grid=16).orderBy("point").collect()
    h = np.std(xs, ddof=1) * len(xs) ** (-0.2)
    for r in got:
        exact = np.exp(-0.5 * ((r.x - xs) / h) ** 2).sum() / (len(xs) * h * math.sqrt(2 * math.pi))
        assert math.isclose(r.density, exact, rel_tol=2e-3, abs_tol=1e-6)


def test_describe_like_pandas(spark):
    xs = [1.0, 2.0, 2.0, 9.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    r = B.describe_numeric(df).first()
    v = np.array([x for x in xs if x is not None])
    assert r["count"] == 4 and math.isclose(r.std, round(float(np.std(v, ddof=1)), 6))
    assert r.q25 == float(np.percentile(v, 25)) and r.q75 == float(np.percentile(v, 75))


def test_distinct_counts_null_as_value(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "c string")
    assert B.distinct_per_column(df).first().n_distinct == 3


def test_all_null_and_all_equal_columns(spark):
    df = spark.createDataFrame([(None, 3.0, 1.0), (None, 3.0, 2.0), (None, 3.0, 3.0)],
                               "a double, b double, y double")
    params = P.fit_params(df, ["a", "b"], [])
    assert params["num_fill"]["a"] == 0.0 and params["num_std"]["b"] == 0.0
    model = P.PrepModel("y", P.PrepOptions(feature_engineering=False), P.Roles(), [], ["a", "b"], [], **params)
    out = model.apply(df).collect()
    assert all(r.a == 0.0 and r.b == 0.0 for r in out)


def test_one_hot_unknown_category_is_all_zero(spark):
    train = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    cats = {"c": sorted(r.c for r in train.collect())}
    new = spark.createDataFrame([("y",), ("w",), (None,)], "c string")
    got = [(r.c_y, r.c_z) for r in P.one_hot(new, ["c"], categories=cats).collect()]
    assert got == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_fit_apply_same_code_path(spark):
    rows = [(i, float(i % 7), ["A", "B", "C"][i % 3], float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "rid long, x double, g string, y double")
    opts = P.PrepOptions(feature_engineering=False, outlier_detection=False)
    model = P.fit(df.drop("rid"), "y", opts)
    a = sorted(tuple(r) for r in model.apply(df.drop("rid")).collect())
    b = sorted(tuple(r) for r in P.fit_transform(df.drop("rid"), "y", opts)[0].collect())
    assert a == b
    assert model.feature_names() == ["x", "g_B", "g_C"] or "x" in model.feature_names()


def test_guarded_removal_keeps_all_when_share_large(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 100, 100, 100]], "x double")
    assert E.guarded_removal(df, "iqr", 1.5, ["x"]).count() == 7
    df2 = spark.createDataFrame([(float(x),) for x in list(range(30)) + [1000]], "x double")
    assert E.guarded_removal(df2, "iqr", 1.5, ["x"]).count() == 30


def test_forward_fill_within_key(spark):
    df = spark.createDataFrame([
        (1, "2024-01-01 10:00:00", 1.0), (1, "2024-01-01 11:00:00", None), (1, "2024-01-02 09:00:00", None),
        (2, "2024-01-01 10:00:00", None), (2, "2024-01-03 10:00:00", 5.0)], "k long, ts string, v double")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r.k, str(r.ts), r.v) for r in P.forward_fill(df, ["v"], "k", "ts").collect())
    assert [g[2] for g in got] == [1.0, 1.0, 1.0, None, 5.0]


def test_distributed_rank_equals_window_rank(spark):
    rows = [(f"v{i % 97:03d}",) for i in range(1000)] + [(None,)]
    df = spark.createDataFrame(rows, "c string")
    got = P.ordinal_encode(df.withColumn("v", F.col("c")), ["c"]).collect()
    assert len(got) == 1001 and all(r.c is None if r.v is None else int(r.v[1:]) == r.c for r in got)
    ranks = P.distributed_rank(df.select("c").where("c is not null").distinct(), "c", partitions=7).collect()
    assert sorted(r._rank for r in ranks) == list(range(97))
    assert all(int(r.c[1:]) == r._rank for r in ranks)


def test_sparse_one_hot_has_no_level_limit(spark):
    rows = [(i, f"h{i % 150:03d}" if i % 10 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, hospital string")
    cells = {r.id: (r.position, r.value) for r in P.one_hot_sparse(df, "hospital", "id").collect()}
    levels = sorted({v for _, v in rows if v})
    assert cells == {i: (levels.index(v) - 1, v) for i, v in rows if v and v != levels[0]}


def test_salted_top_values_equal_plain(spark):
    rows = [(f"k{i % 50}" if i % 3 else "hot",) for i in range(3000)]
    df = spark.createDataFrame(rows, "c string")
    salted = [(r.value, r["count"], r.rank) for r in B.top_values(df, ["c"], k=5, buckets=8).orderBy("rank").collect()]
    plain = df.groupBy(F.col("c").alias("value")).count().orderBy(F.desc("count"), "value").limit(5).collect()
    assert salted == [(r.value, r["count"], i + 1) for i, r in enumerate(plain)]
