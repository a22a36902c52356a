"""Semantics traps T1, T2, T11-T13, T23 on tiny literal frames."""

import math

import numpy as np
from pyspark.sql import functions as F

from wardstats.functions import stats as S
from wardstats.functions.text import fmt_num, fmt_pct
from wardstats.operators import transform as D


def test_ddof_conventions(spark):  # T1
    xs = [1.0, 2.0, 4.0, 7.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    r = df.agg(S.std0("x").alias("s0"), S.std1("x").alias("s1")).first()
    assert math.isclose(r.s0, np.std(xs), rel_tol=1e-12)
    assert math.isclose(r.s1, np.std(xs, ddof=1), rel_tol=1e-12)


def test_percentile_linear_interpolation(spark):  # T2
    xs = [3.0, 1.0, 10.0, 7.5, 2.25]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for p in (0.1, 0.25, 0.5, 0.9):
        got = df.agg(S.pct("x", p).alias("q")).first().q
        assert math.isclose(got, float(np.percentile(xs, p * 100)), rel_tol=1e-12)


def test_null_keeping_inequality(spark):  # T11
    df = spark.createDataFrame([("Expired",), (None,), ("Home",)], "d string")
    kept = sorted((r.d or "") for r in D.filter_keep_nulls(df, "d", "Expired").collect())
    assert kept == ["", "Home"]


def test_right_closed_bins(spark):  # T12
    df = spark.createDataFrame([(0.0,), (5.0,), (5.5,), (20.0,), (25.0,)], "y double")
    out = {r.y: r.experience_level for r in D.staff_features(
        df.withColumns({"o": F.lit(1.0), "s": F.lit(8.0), "a": F.lit(1.0), "b": F.lit(0.5)}),
        "o", "s", "y", "a", "b").collect()}
    assert out == {0.0: None, 5.0: "Novice", 5.5: "Intermediate", 20.0: "Experienced", 25.0: "Veteran"}


def test_los_bins_edges(spark):  # D13 edges 0, 5, 120 and the '120 +' literal
    df = spark.createDataFrame([("0",), ("5",), ("6",), ("120 +",), ("121",)], "los string")
    df = D.replace_and_cast(df, "los")
    got = {r.los: (r.los_bin, r.los_label) for r in D.los_bins(df, "los").collect()}
    assert got[0] == ("nan", None)
    assert got[5] == ("(0- 5]", 5)
    assert got[6] == ("(5- 10]", 10)
    assert got[120] == ("(50- 120+]", 120)
    assert got[121] == ("nan", None)


def test_epsilon_and_safe_division(spark):  # T13
    df = spark.createDataFrame([(10.0, 0.0)], "a double, b double")
    r = df.select(S.eps_div("a", "b", 1e-6).alias("e"), S.safe_div("a", "b").alias("s")).first()
    assert math.isclose(r.e, 10.0 / 1e-6)
    assert r.s is None


def test_mode_ties_smallest(spark):  # T23
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    assert df.agg(F.mode("v", True).alias("m")).first().m == "a"


def test_fixed_point_text_is_half_up(spark):
    df = spark.createDataFrame([(34.25,), (2.675,), (-0.04,), (0.0,), (None,)], "x double")
    got = [r.t for r in df.select(fmt_num("x", 1).alias("t")).collect()]
    assert got == ["34.3", "2.7", "0.0", "0.0", None]
    assert df.select(fmt_pct(F.lit(0.1234)).alias("p")).first().p == "12.3%"


def test_date_parts_monday_zero_and_weekend(spark):  # D1
    df = spark.createDataFrame([("2024-01-01 10:30:00",), ("2024-01-06 23:00:00",)], "s string") \
        .select(F.to_timestamp("s").cast("timestamp_ntz").alias("ts"))
    got = sorted(tuple(r) for r in D.date_features(df).collect())
    assert got == [(10, 0, 1, 1, 0), (23, 5, 1, 1, 1)]


def test_dictionary_maps_default_zero_and_urgency_two(spark):  # D7, D8
    df = spark.createDataFrame([("0 to 17", "F", "Major", "High"), ("unknown", None, None, None)],
                               "a string, g string, r string, u string")
    out = sorted(tuple(r) for r in D.urgency_numeric(D.ordinal_maps(df, "a", "g", "r"), "u").collect())
    assert out == [(0, 0, 0, None, 2), (1, 1, 3, "High", 3)]


def test_capacity_uses_first_matching_numeric_column(spark):  # D6
    df = spark.createDataFrame([(4, 9, 200)], "patient_load int, visit_count int, beds int")
    assert D.capacity_utilization(df, "beds").first().capacity_utilization == 4 / 200
    zero = spark.createDataFrame([(4, 0)], "patient_load int, beds int")
    assert D.capacity_utilization(zero, "beds").first().capacity_utilization is None
