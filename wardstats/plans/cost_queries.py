"""Queries for cost / ROI (I1-I9) and residual analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstats.operators import cost as C
from wardstats.operators import residuals as L
from wardstats.plans import views as V
from wardstats.plans.registry import query
from wardstats.plans.sqlviews import with_views

TEST = "scored_test AS (SELECT * FROM scored WHERE split = 'test')"
_SCEN = "(VALUES (5), (10), (15), (20)) sc(pct)"


def _test(spark, sf):
    return V.scored(spark, sf).filter(F.col("split") == "test")


@query("cost_baseline", with_views("scored", extra=TEST) + """,
st AS (SELECT model, round(quantile_cont(y_pred, 0.8), 9) AS p80, round(quantile_cont(y_pred, 0.95), 9) AS p95
       FROM scored_test GROUP BY model),
g AS (SELECT model, count(*) AS n, avg(y_pred) AS m, stddev_pop(y_pred) AS sd,
             sum(CASE WHEN y_pred > p80 THEN 1 ELSE 0 END) AS hc, sum(CASE WHEN y_pred > p80 THEN y_pred END) AS hs,
             sum(CASE WHEN y_pred > p95 THEN 1 ELSE 0 END) AS n95
      FROM scored_test JOIN st USING (model) GROUP BY model)
SELECT model, CAST(n AS BIGINT) AS n, round(m * 2.5::DOUBLE, 6) AS baseline_cost_per_case,
       round((m * 2.5::DOUBLE) * (n * 52), 6) AS annual_baseline_cost, CAST(hc AS BIGINT) AS high_cost_cases,
       round(coalesce(hs, 0.0) * 2.5::DOUBLE, 6) AS high_cost_total, round(sd / nullif(m, 0), 6) AS high_variability,
       round(n95 / n, 6) AS outlier_impact
FROM g""")
def cost_baseline(spark, sf):
    return C.cost_baseline(_test(spark, sf), "wait_min")


@query("cost_scenarios", with_views("scored", extra=TEST) + f""",
g AS (SELECT model, count(*) AS n, avg(y_pred) AS m FROM scored_test GROUP BY model)
SELECT model, CAST(pct AS INTEGER) AS improvement_pct,
       round((m * 2.5::DOUBLE) * (n * 52) - ((m * (1 - pct / 100.0::DOUBLE)) * 2.5::DOUBLE) * (n * 52), 6)
           AS annual_savings,
       round(m * 2.5::DOUBLE - (m * (1 - pct / 100.0::DOUBLE)) * 2.5::DOUBLE, 6) AS cost_per_case_reduction,
       CAST(pct * 2 AS INTEGER) AS roi_percentage,
       round(greatest(1.0::DOUBLE, 12 / (pct / 5.0::DOUBLE)), 6) AS payback_period_months
FROM g, {_SCEN}""")
def cost_scenarios(spark, sf):
    return C.cost_scenarios(_test(spark, sf), "wait_min")


_DASH_SQL = with_views("scored", "importance", extra=TEST) + """,
st AS (SELECT model, round(quantile_cont(y_pred, 0.9), 9) AS p90 FROM scored_test GROUP BY model),
g AS (SELECT model, count(*) AS n, avg(y_pred) AS m, sum(CASE WHEN y_pred > p90 THEN 1 ELSE 0 END) AS hc,
             sum(CASE WHEN y_pred > p90 THEN y_pred END) AS hs
      FROM scored_test JOIN st USING (model) GROUP BY model),
dash AS (SELECT model, CAST((SELECT count(*) FROM visits) * 12 AS BIGINT) AS annual_cases,
                round(m * 2.5::DOUBLE, 6) AS avg_cost_per_case,
                round((m * 2.5::DOUBLE) * ((SELECT count(*) FROM visits) * 12), 6) AS annual_cost,
                CAST(hc AS BIGINT) AS high_cost_cases, round(hc / n * 100, 6) AS high_cost_pct,
                round(coalesce(hs, 0.0) * 2.5::DOUBLE, 6) AS high_cost_impact FROM g),
roi AS (SELECT model, CAST(pct AS INTEGER) AS improvement_pct,
               (avg_cost_per_case - avg_cost_per_case * (1 - pct / 100.0::DOUBLE)) * annual_cases AS sav
        FROM dash, (VALUES (5), (10), (15), (20)) sc(pct)),
roi2 AS (SELECT model, improvement_pct, round(sav, 6) AS annual_savings,
                round((sav - 50000.0::DOUBLE) / 50000.0::DOUBLE * 100, 6) AS roi,
                round(least(CASE WHEN sav > 0 THEN 50000.0::DOUBLE / (sav / 12) ELSE 'inf'::DOUBLE END, 60.0::DOUBLE), 6)
                    AS payback_months FROM roi),
imp AS (SELECT model, feature, score / sum(score) OVER (PARTITION BY model) AS sh,
               row_number() OVER (PARTITION BY model ORDER BY score DESC, feature) AS rank FROM importance),
drv AS (SELECT imp.model, CAST(imp.rank AS INTEGER) AS rank, imp.feature AS factor,
               round(imp.sh * dash.annual_cost, 6) AS cost_impact, round(imp.sh * 100, 6) AS percentage
        FROM imp JOIN dash USING (model) WHERE imp.rank <= 5)
"""


@query("cost_dashboard", _DASH_SQL + """
SELECT * FROM dash""")
def cost_dashboard(spark, sf):
    return C.cost_dashboard(_test(spark, sf), V.visits(spark, sf), "wait_min")


def _dash(spark, sf):
    return C.cost_dashboard(_test(spark, sf), V.visits(spark, sf), "wait_min")


@query("roi_scenarios", _DASH_SQL + "SELECT * FROM roi2")
def roi_scenarios(spark, sf):
    return C.roi_scenarios(_dash(spark, sf))


@query("cost_by_feature", _DASH_SQL + "SELECT * FROM drv")
def cost_by_feature(spark, sf):
    return C.cost_by_feature(V.importance(spark, sf), _dash(spark, sf))


@query("priority_matrix", _DASH_SQL + """
SELECT model, factor, cost_impact,
       CASE WHEN lower(factor) LIKE '%staff%' OR lower(factor) LIKE '%process%' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END
           AS feasibility,
       round(greatest(1.0::DOUBLE, cost_impact / 1000 * CASE WHEN lower(factor) LIKE '%staff%'
             OR lower(factor) LIKE '%process%' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END), 6) AS priority_score
FROM drv""")
def priority_matrix(spark, sf):
    return C.priority_matrix(C.cost_by_feature(V.importance(spark, sf), _dash(spark, sf)))


@query("cost_benefit", _DASH_SQL + """
SELECT model, CAST(improvement_pct AS VARCHAR) || '%' AS scenario, 'cost' AS kind, 50000.0::DOUBLE AS value FROM roi2
UNION ALL
SELECT model, CAST(improvement_pct AS VARCHAR) || '%', 'benefit', annual_savings FROM roi2""")
def cost_benefit(spark, sf):
    return C.cost_benefit(C.roi_scenarios(_dash(spark, sf)))


# ---------------------------------------------------------------- residuals

@query("residuals", with_views("scored", extra=TEST) + """,
st AS (SELECT model, least(min(y_true), min(y_pred)) AS lmin, greatest(max(y_true), max(y_pred)) AS lmax
       FROM scored_test GROUP BY model)
SELECT model, id, round(y_pred, 6) AS y_pred, round(y_true, 6) AS y_true, round(y_true - y_pred, 6) AS residual,
       round(lmin, 6) AS line_min, round(lmax, 6) AS line_max
FROM scored_test JOIN st USING (model)""")
def residuals(spark, sf):
    return L.residuals(_test(spark, sf))


_QQ_VALUES = ", ".join(f"({i + 1}, {q!r}::DOUBLE, {t!r}::DOUBLE)"
                       for i, (q, t) in enumerate(zip(L.QQ_PROBS, L.normal_quantiles())))


@query("qq_points", with_views("scored", extra=TEST) + f""",
g AS (SELECT model, quantile_cont(y_true - y_pred, [{", ".join(repr(q) for q in L.QQ_PROBS)}]) AS q
      FROM scored_test GROUP BY model)
SELECT model, round(p.prob, 6) AS prob, round(p.theo, 6) AS theoretical, round(g.q[p.i], 6) AS sample
FROM g, (VALUES {_QQ_VALUES}) p(i, prob, theo)""")
def qq_points(spark, sf):
    return L.qq_points(_test(spark, sf))


@query("ols_trend", with_views("scored", extra=TEST) + """
SELECT model, round(regr_slope(y_true - y_pred, y_pred), 6) AS res_slope,
       round(regr_intercept(y_true - y_pred, y_pred), 6) AS res_intercept,
       round(regr_r2(y_true - y_pred, y_pred), 6) AS res_r2,
       round(regr_slope(y_pred, y_true), 6) AS pred_slope, round(regr_intercept(y_pred, y_true), 6) AS pred_intercept,
       round(regr_r2(y_pred, y_true), 6) AS pred_r2
FROM scored_test GROUP BY model""")
def ols_trend(spark, sf):
    return L.ols_trend(_test(spark, sf))
