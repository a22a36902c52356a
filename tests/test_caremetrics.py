"""Healthcare metrics (H1-H11) against a NumPy statement of the formulas."""

import math

import numpy as np
import pytest

from wardstats.operators import caremetrics as cm


def reference_metrics(y, p, target):
    """The metric formulas written out with NumPy."""
    y, p = np.asarray(y, float), np.asarray(p, float)
    e = y - p
    t = target.lower()
    timed = "wait" in t or "time" in t
    acc = np.minimum(np.abs(y) * 0.2, 15) if timed else np.abs(y) * 0.1
    p90 = np.percentile(y, 90)
    ca = y >= p90
    cp = p >= p90 if "wait" in t else p >= p90 * 0.9
    q = np.percentile(y, [25, 50, 75])
    masks = [y <= q[0], (y > q[0]) & (y <= q[1]), (y > q[1]) & (y <= q[2]), y > q[2]]
    scores = [max(0, 1 - np.mean(np.abs(e[m])) / np.mean(y[m])) for m in masks if m.sum() and np.mean(y[m]) > 0]
    eff = np.mean(np.maximum(0, e)) / np.mean(y) if "wait" in t else 1 - np.mean(np.abs(e) / np.mean(y))
    mabs = np.mean(np.abs(e))
    cons = max(0, min(1, 1 - np.std(e) / mabs)) if mabs > 0 else 0
    return {
        "mae": mabs, "rmse": math.sqrt(np.mean(e ** 2)),
        "r2": 1 - np.sum(e ** 2) / np.sum((y - y.mean()) ** 2),
        "clinical_accuracy": np.mean(np.abs(e) <= acc),
        "critical_detection_rate": (ca & cp).sum() / ca.sum() if ca.sum() else 1.0,
        "resource_accuracy": np.mean(scores) if scores else 0.0,
        "efficiency_impact": eff, "consistency_score": cons,
        "mape": np.mean(np.abs(e / y)) * 100 if np.all(y != 0) else float("inf"),
    }


@pytest.mark.parametrize("target", ["Total Wait Time (min)", "length_of_stay"])
def test_metrics_match_formulas(spark, target):
    rng = np.random.default_rng(7)
    y = rng.exponential(30, 300).round(2) + 0.5
    p = (y + rng.normal(0, 5, 300) + 2).round(2)
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in zip(y, p)], "model string, y_true double, y_pred double")
    got = cm.care_metrics(df, target).first().asDict()
    exp = reference_metrics(y, p, target)
    for k, v in exp.items():
        assert math.isclose(got[k], v, rel_tol=1e-5, abs_tol=1e-6), (k, got[k], v)


def test_zero_truth_gives_infinite_mape(spark):
    df = spark.createDataFrame([("m", 0.0, 1.0), ("m", 2.0, 2.0), ("m", 4.0, 3.0)],
                               "model string, y_true double, y_pred double")
    assert math.isinf(cm.care_metrics(df, "wait").first().mape)


def test_single_row_group_and_constant_truth(spark):
    df = spark.createDataFrame([("m", 5.0, 4.0)], "model string, y_true double, y_pred double")
    r = cm.care_metrics(df, "wait").first()
    # one row: y equals its own p90, the prediction 4 < 5 misses it
    assert r.n == 1 and r.r2 is None and r.critical_detection_rate == 0.0 and r.consistency_score == 1.0


def test_fairness_ratio_and_score(spark):
    df = spark.createDataFrame([("m", "g1", 1.0, 0.0), ("m", "g1", 1.0, 2.0), ("m", "g2", 3.0, 0.0)],
                               "model string, g string, y_true double, y_pred double")
    groups = cm.fairness_groups(df, ["g"])
    s = cm.fairness_scores(groups).first()
    assert math.isclose(s.mae_ratio, 3.0) and math.isclose(s.fairness_score, 1 / 3.0, rel_tol=1e-6)


def test_alert_levels_one_row_per_percentile(spark):  # T20
    df = spark.createDataFrame([("m", float(i)) for i in range(101)], "model string, y_pred double")
    out = {r.percentile: (r.alert_level, r.threshold) for r in cm.alert_thresholds(df, "wait", (75, 85, 95)).collect()}
    assert out == {75: ("Information", 75.0), 85: ("Warning", 85.0), 95: ("Critical", 95.0)}


def test_confidence_bands_use_population_std(spark):
    e = [1.0, -1.0, 2.0, -2.0]
    df = spark.createDataFrame([("m", x, 0.0) for x in e], "model string, y_true double, y_pred double")
    r = cm.confidence_bands(df).first()
    assert math.isclose(r.band_95, round(1.96 * np.std(e), 6))
