"""Cost/ROI (I), residual (L) and comparison (K) operators against direct
statements of their formulas."""

import math
from statistics import NormalDist

import numpy as np

from wardstats.operators import compare as K
from wardstats.operators import cost as C
from wardstats.operators import residuals as L


def _scored(spark, ys, ps, model="m"):
    return spark.createDataFrame([(model, float(y), float(p)) for y, p in zip(ys, ps)],
                                 "model string, y_true double, y_pred double")


def test_cost_baseline_and_scenarios(spark):
    p = np.array([10.0, 20.0, 30.0, 40.0, 100.0])
    df = _scored(spark, p, p)
    b = C.cost_baseline(df, "wait").first()
    assert math.isclose(b.baseline_cost_per_case, p.mean() * 2.5)
    assert math.isclose(b.annual_baseline_cost, p.mean() * 2.5 * len(p) * 52)
    p80 = np.percentile(p, 80)
    assert b.high_cost_cases == int((p > p80).sum())
    assert math.isclose(b.high_variability, round(np.std(p) / p.mean(), 6))
    sc = {r.improvement_pct: r for r in C.cost_scenarios(df, "wait").collect()}
    assert sorted(sc) == [5, 10, 15, 20]
    assert math.isclose(sc[10].annual_savings, round(p.mean() * 2.5 * len(p) * 52 * 0.1, 6), rel_tol=1e-9)
    assert sc[20].roi_percentage == 40 and sc[20].payback_period_months == 3.0
    assert sc[5].payback_period_months == 12.0


def test_roi_payback_capped(spark):
    dash = spark.createDataFrame([("m", 12, 1.0)], "model string, annual_cases bigint, avg_cost_per_case double")
    r = {x.improvement_pct: x for x in C.roi_scenarios(dash, improvement_cost=50000.0).collect()}
    assert r[5].payback_months == 60.0  # tiny savings: capped at five years
    assert math.isclose(r[5].roi, round((12 * 0.05 - 50000) / 50000 * 100, 6))


def test_qq_points_use_normal_quantiles(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(0, 1, 500)
    df = _scored(spark, y, np.zeros_like(y))
    pts = L.qq_points(df).orderBy("prob").collect()
    assert len(pts) == 99
    assert math.isclose(pts[49].theoretical, 0.0, abs_tol=1e-9)
    assert math.isclose(pts[0].theoretical, round(NormalDist().inv_cdf(0.01), 6))
    assert math.isclose(pts[89].sample, round(float(np.percentile(y, 90)), 6), rel_tol=1e-9)


def test_ols_trend_matches_polyfit(spark):
    x = np.arange(1.0, 51.0)
    y = 3.0 * x + 2.0 + np.sin(x)
    df = _scored(spark, y, x)
    r = L.ols_trend(df).first()
    slope, intercept = np.polyfit(y, x, 1)  # prediction ~ truth
    assert math.isclose(r.pred_slope, round(slope, 6), rel_tol=1e-6)
    assert math.isclose(r.pred_intercept, round(intercept, 6), rel_tol=1e-6, abs_tol=1e-6)


def test_rankings_and_average_rank(spark):
    cmp = spark.createDataFrame(
        [("d", "a", 0.9, 1.0, 1.0, 0.8), ("d", "b", 0.5, 2.0, 0.5, 0.9), ("d", "c", 0.7, 3.0, 2.0, 0.1)],
        "dataset string, model string, test_r2 double, test_rmse double, test_mae double, cv_score double")
    ranks = {(r.metric, r.model): r.rank for r in K.model_rankings(cmp).collect()}
    assert ranks[("test_r2", "a")] == 1 and ranks[("test_rmse", "a")] == 1 and ranks[("test_mae", "b")] == 1
    assert ranks[("cv_score", "b")] == 1 and ranks[("test_r2", "b")] == 3
    avg = {r.model_dataset: r.average_rank for r in K.average_rank(K.model_rankings(cmp)).collect()}
    assert avg["a (d)"] == round((1 + 1 + 2 + 2) / 4, 2)
    piv = {r.model_dataset: r.test_rmse for r in K.rank_pivot(K.model_rankings(cmp)).collect()}
    assert piv == {"a (d)": 1.0, "b (d)": 2.0, "c (d)": 3.0}
