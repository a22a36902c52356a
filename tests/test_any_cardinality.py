"""Preprocessing of columns of any cardinality, and defined results for NULL
keys, constant columns, perfect fits and missing features."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wardstats.operators import caremetrics as H
from wardstats.operators import models as G
from wardstats.operators import prep as P
from wardstats.operators import profile as B

PLAIN = P.PrepOptions(feature_engineering=False, outlier_detection=False)


def wide(spark, levels=10_000, rows=25_000):
    x = spark.range(rows).withColumn("unit", F.when(F.col("id") % 17 != 0, F.format_string("u%05d", F.col("id") % levels)))
    x = x.withColumn("load", F.col("id") * 0.5).withColumn("kind", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    return x.withColumnRenamed("id", "row").withColumn("wait", F.col("row") % 13 * 1.0)


def expected(rows):
    seen = [r.unit for r in rows if r.unit is not None]
    count = {u: seen.count(u) for u in {}} or {}
    for u in seen:
        count[u] = count.get(u, 0) + 1
    mode = min(count, key=lambda u: (-count[u], u))
    place = {u: i - 1 for i, u in enumerate(sorted(count))}
    return {r.row: place[r.unit if r.unit is not None else mode] for r in rows}, len(place)


def test_fit_and_apply_take_ten_thousand_levels(spark):
    df = wide(spark)
    model = P.fit(df.drop("row"), "wait", PLAIN)
    assert model.wide() == ["unit"] and "kind_b" in model.feature_names()
    want, size = expected(df.collect())
    got = model.apply(df, keep=["row"]).select("row", "unit_position").collect()
    assert {r.row: r.unit_position for r in got} == want and model.sizes["unit"] == size
    new = spark.createDataFrame([(1, "never seen", 1.0, "a", 1.0), (2, None, None, None, 1.0)], "row long, unit string, load double, kind string, wait double")
    assert {r.row: r.unit_position for r in model.apply(new, keep=["row"]).collect()} == {1: -1, 2: want[0]}


def test_features_as_one_sparse_vector(spark):
    df = wide(spark, 300, 2_000)
    model = P.fit(df.drop("row"), "wait", PLAIN)
    want, size = expected(df.collect())
    for r in model.apply_vector(df, keep=["row"]).collect():
        cells = [i for i in r.features.toArray()[2:].nonzero()[0]]
        assert len(r.features) == 2 + size - 1 and cells == ([want[r.row]] if want[r.row] >= 0 else [])


def test_one_hot_of_many_levels_is_a_position(spark):
    df = spark.createDataFrame([(i, f"c{i % 150:03}", "xy"[i % 2]) for i in range(300)] + [(300, None, None)], "i long, c string, d string")
    got = {r.i: r for r in P.one_hot(df, ["c", "d"]).collect()}
    assert got[0].c_position == -1 and got[149].c_position == 148 and got[300].c_position == -1
    assert got[1].d_y == 1.0 and got[0].d_y == 0.0


def test_group_complexity_of_many_groups_is_a_table(spark):
    df = spark.createDataFrame([(f"r{i % 200}", float(i), float(i % 7)) for i in range(1_000)], "region string, load double, wait double")
    model = P.fit(df, "wait", P.PrepOptions(outlier_detection=False))
    assert not isinstance(model.complexity["region"], dict)
    want = {r.region: r.s for r in df.groupBy("region").agg(F.round(F.stddev_samp("wait"), 6).alias("s")).collect()}
    got = model.engineered(df).select("region", "region_complexity").distinct().collect()
    assert {r.region: r.region_complexity for r in got} == want


def test_perfect_feature_comes_first(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i * 3.0, rng.random(), 5.0, float(i)) for i in range(50)], "same double, noise double, flat double, y double")
    got = P.select_k_best(df, "y", ["noise", "same", "flat"], 1).orderBy("position").collect()
    assert got[0].feature == "same" and got[0].selected and math.isinf(got[0].f_score) and got[2].feature == "flat"


def test_mean_zero_target_and_constant_column(spark):
    rows = [("m", float(y), float(y) / 2) for y in (-4, -3, -2, -1, 1, 2, 3, 4)]
    got = H.care_metrics(spark.createDataFrame(rows, "model string, y_true double, y_pred double"), "wait_min").collect()
    assert len(got) == 1 and got[0].efficiency_impact is None and got[0].mae == 1.25
    flat = B.kde_grid(spark.createDataFrame([(2.0,)] * 5, "x double"), "x", grid=4).collect()
    assert [(r.x, r.density) for r in flat] == [(2.0, None)] * 4


def test_null_keys_are_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 1.0)], "g string, x double")
    got = {(r.g, r.bin): r["count"] for r in B.histogram(df, "x", 2, keys=["g"]).collect()}
    assert got == {(None, 0): 1, (None, 1): 1, ("a", 0): 1, ("a", 1): 0}
    days = spark.createDataFrame([(None, "2024-01-01 10:00:00", 5.0), (None, "2024-01-02 10:00:00", None), ("k", "2024-01-02 11:00:00", None)], "k string, t string, x double")
    filled = P.forward_fill(days.withColumn("t", F.to_timestamp("t")), ["x"], "k", "t").collect()
    assert sorted((str(r.k), str(r.t), r.x) for r in filled) == [("None", "2024-01-01 10:00:00", 5.0), ("None", "2024-01-02 10:00:00", 5.0), ("k", "2024-01-02 11:00:00", None)]


# ------------------------------------------------------------------ models

def rows_with_gaps(spark, n=400):
    rng = random.Random(3)
    out = []
    for i in range(n):
        a, b = rng.uniform(0, 10), rng.uniform(-5, 5)
        out.append((i, "test" if i % 5 == 0 else "train", None if i % 23 == 0 else a, b, 2 * a - b + 1 + rng.gauss(0, 0.1)))
    return spark.createDataFrame(out, "id long, split string, a double, b double, y double")


@pytest.mark.parametrize("name", [G.LINEAR, G.KERNEL])
def test_stored_model_scores_like_the_fitted_one(spark, tmp_path, name):
    df = rows_with_gaps(spark)
    options = G.TrainOptions(rff_components=16)
    model = G.fit_pipeline(df.where("split = 'train'"), ["a", "b"], "y", name, options)
    path = "file://" + str(tmp_path / "model")
    G.save_model(model, path)
    test = df.where("split = 'test'")
    fresh = {r.id: r.y_pred for r in G.score_rows(model, test, ["id"]).collect()}
    loaded = {r.id: r.y_pred for r in G.score_rows(path, test, ["id"]).collect()}
    direct = {r.id: r.y_pred for r in G.fit_predict(df, ["a", "b"], "y", name, options=options)[0].where("split = 'test'").collect()}
    assert loaded == fresh and set(direct) == set(loaded)
    assert max(abs(direct[i] - loaded[i]) for i in direct) < (1e-6 if name == G.LINEAR else 1e-3)  # Huber loss: an iterative fit


def test_stored_model_scores_a_stream(spark, tmp_path):
    df = rows_with_gaps(spark, 100)
    model = G.fit_pipeline(df, ["a", "b"], "y", G.LINEAR)
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    df.write.parquet(src)
    stream = G.score_rows(model, spark.readStream.schema(df.schema).parquet(src), ["id"])
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    want = {r.id: r.y_pred for r in G.score_rows(model, df, ["id"]).collect()}
    assert {r.id: r.y_pred for r in spark.read.parquet(out).collect()} == want


def test_stability_refits_on_every_split(spark):
    runs = G.stability_refit(rows_with_gaps(spark), ["a", "b"], "y", G.LINEAR, n_runs=3)
    got = runs.collect()
    assert sorted(r.run for r in got) == [0, 1, 2] and len({r.r2 for r in got}) == 3 and all(r.seconds > 0 and r.r2 > 0.8 for r in got)
    one = G.stability_of_runs(runs).collect()[0]
    assert one.n_runs == 3 and abs(one.r2_mean - sum(r.r2 for r in got) / 3) < 1e-12 and one.seconds_mean > 0
