"""Residual analysis data: the data behind the
residual plots, not the pictures."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstats.functions.percentiles import percentile_of
from wardstats.functions.stats import r6
from wardstats.operators.caremetrics import attach_stats, group_stats

# Q-Q probability grid: 0.01 ... 0.99 (99 points).
QQ_PROBS = tuple(round(i / 100, 2) for i in range(1, 100))


def normal_quantiles(probs=QQ_PROBS) -> list[float]:
    """Standard normal quantiles Φ⁻¹(q), computed once on the driver."""
    nd = NormalDist()
    return [nd.inv_cdf(q) for q in probs]


def residuals(scored: DataFrame, keys=("model",), id_col: str = "id", y: str = "y_true",
              p: str = "y_pred") -> DataFrame:
    """(ŷ, y, y−ŷ) per row plus the identity-line bounds of the group
    (min and max over both series)."""
    keys = list(keys)
    st = group_stats(scored, keys, F.least(F.min(y), F.min(p)).alias("line_min"),
                     F.greatest(F.max(y), F.max(p)).alias("line_max"))
    j = attach_stats(scored.select(*keys, id_col, y, p), st, keys)
    return j.select(*keys, id_col, r6(p).alias("y_pred"), r6(y).alias("y_true"),
                    r6(F.col(y) - F.col(p)).alias("residual"), r6("line_min").alias("line_min"),
                    r6("line_max").alias("line_max"))


def qq_points(scored: DataFrame, keys=("model",), y: str = "y_true", p: str = "y_pred",
              probs=QQ_PROBS) -> DataFrame:
    """L3: normal Q-Q points: residual quantiles at ``probs`` against the
    standard normal quantiles. One percentile aggregate per group replaces the
    global sort of all residuals."""
    keys = list(keys)
    g = group_stats(scored, keys, percentile_of(F.col(y) - F.col(p), list(probs)).alias("_q"))
    theo = F.array(*[F.lit(float(t)) for t in normal_quantiles(probs)])
    pr = F.array(*[F.lit(float(q)) for q in probs])
    z = F.arrays_zip(pr.alias("prob"), theo.alias("theoretical"), F.col("_q").alias("sample"))
    ex = g.select(*keys, F.inline(z))
    return ex.select(*keys, r6("prob").alias("prob"), r6("theoretical").alias("theoretical"),
                     r6("sample").alias("sample"))


def ols_trend(scored: DataFrame, keys=("model",), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """L4: OLS trendlines of residual ~ ŷ and ŷ ~ y (slope, intercept, R²)."""
    keys = list(keys)
    res = F.col(y) - F.col(p)
    g = group_stats(scored, keys,
                    F.regr_slope(res, F.col(p)).alias("res_slope"), F.regr_intercept(res, F.col(p)).alias("res_intercept"),
                    F.regr_r2(res, F.col(p)).alias("res_r2"),
                    F.regr_slope(F.col(p), F.col(y)).alias("pred_slope"),
                    F.regr_intercept(F.col(p), F.col(y)).alias("pred_intercept"),
                    F.regr_r2(F.col(p), F.col(y)).alias("pred_r2"))
    return g.select(*keys, *[r6(c).alias(c) for c in g.columns if c not in keys])
