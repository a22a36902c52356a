"""More semantics traps from SURVEY §1: T3, T4, T6, T8, T10, T15, T16, T17, T24."""

import math

from pyspark.sql import functions as F

from wardstats.operators import caremetrics as cm
from wardstats.operators import compare as K
from wardstats.operators import evaluate as G
from wardstats.operators import prep as P
from wardstats.operators import profile as B
from wardstats.operators import transform as D


def test_id_columns_parity_vs_word(spark):  # T3
    df = spark.createDataFrame([(1, 2, 3, 4)], "`Visit ID` int, Resident int, `Hospital Name` int, score int")
    assert D.id_columns(df) == ["Visit ID", "Resident", "Hospital Name"]
    assert D.id_columns(df, mode="word") == ["Visit ID", "Hospital Name"]


def test_text_dates_detected_and_parsed(spark):  # T4
    df = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-02-03 11:30:00", "b")], "d string, c string")
    types = {r.column_name: r.semantic_type for r in B.detect_types(df).collect()}
    assert types == {"d": "datetime", "c": "categorical"}


def test_date_parts_categorical_in_parity_mode(spark):  # T6
    rows = [(f"2024-01-{d:02d} {h:02d}:00:00", float(d + h)) for d in range(1, 29) for h in (1, 13)]
    df = spark.createDataFrame(rows, "ts string, y double").withColumn("ts", F.to_timestamp("ts"))
    opts = P.PrepOptions(outlier_detection=False)
    m = P.fit(df, "y", opts)
    assert "ts_hour" in m.categorical and "ts_day_of_week" in m.categorical
    m2 = P.fit(df, "y", opts.with_options(treat_date_parts="numeric"))
    assert "ts_day_of_week" in m2.numeric


def test_target_excluded_from_time_ratios(spark):  # T8
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a_time double, b_time double, wait_time double")
    with_t = D.pairwise_ratios(df).columns
    without = D.pairwise_ratios(df, exclude=("wait_time",)).columns
    assert "a_time_to_wait_time_ratio" in with_t and "a_time_to_wait_time_ratio" not in without
    assert "a_time_to_b_time_ratio" in without


def test_feature_selection_default_k(spark):  # T10
    rows = [(float(i), float(i % 3), float(i % 5), 2.0 * i + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, x3 double, y double")
    m = P.fit(df, "y", P.PrepOptions(feature_engineering=False, outlier_detection=False, feature_selection=True))
    assert m.selected is not None and len(m.selected) == min(50, len(m.feature_names()))


def test_hash_folds_are_stable_and_balanced(spark):  # T15
    df = spark.range(5000).withColumnRenamed("id", "rid").select("rid", G.fold_col("rid", 5).alias("f"))
    counts = {r.f: r["count"] for r in df.groupBy("f").count().collect()}
    assert set(counts) == {0, 1, 2, 3, 4} and min(counts.values()) > 800
    again = {r.rid: r.f for r in spark.range(20).withColumnRenamed("id", "rid")
             .select("rid", G.fold_col("rid", 5).alias("f")).collect()}
    assert again == {r.rid: r.f for r in df.filter("rid < 20").collect()}


def test_strict_percentile_rules_cannot_fire(spark):  # T16
    df = spark.createDataFrame([("m", float(i), float(i) * 1.1) for i in range(200)],
                               "model string, y_true double, y_pred double")
    r = cm.high_error_cases(df).first()
    assert r.high_error_share <= 0.1 and r.flagged is False


def test_top_models_ordered_by_r2(spark):  # T17
    cmp = spark.createDataFrame(
        [("s", "d", "wait", m, r2, 1.0, 1.0, 0.5, 0.1, 1.0, 0.0)
         for m, r2 in [("z", 0.1), ("a", 0.9), ("m", 0.5), ("b", 0.7)]],
        "session string, dataset string, target string, model string, test_r2 double, test_rmse double, "
        "test_mae double, cv_score double, cv_std double, training_time double, overfitting double")
    lines = [r.line for r in K.model_recommendations(cmp).collect()]
    assert "Average the best ones: a, b, m" in lines


def test_consistency_positive_only_for_biased_predictor(spark):  # T24
    ys = [float(x) for x in range(1, 101)]
    unbiased = [("u", y, y + (1 if i % 2 else -1)) for i, y in enumerate(ys)]
    biased = [("b", y, y - 5 + (1 if i % 2 else -1)) for i, y in enumerate(ys)]
    df = spark.createDataFrame(unbiased + biased, "model string, y_true double, y_pred double")
    got = {r.model: r.consistency_score for r in cm.care_metrics(df, "wait").collect()}
    assert got["u"] == 0.0 and got["b"] > 0.0
    assert math.isclose(got["b"], 1 - 1 / 5, rel_tol=1e-6)
