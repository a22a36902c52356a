"""Queries for the domain metrics over the scored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstats.functions.text import fmt_num_sql
from wardstats.operators import caremetrics as cm
from wardstats.plans import views as V
from wardstats.plans.registry import query
from wardstats.plans.sqlviews import with_views

TEST = "scored_test AS (SELECT * FROM scored WHERE split = 'test')"


def _test(spark, sf):
    return V.scored(spark, sf).filter(F.col("split") == "test")


def r6(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6)"


def care_metrics_sql(target: str, keys: list[str], source: str = "scored_test") -> str:
    k = ", ".join(keys)
    t = target.lower()
    wait, timed = "wait" in t, ("wait" in t or "time" in t)
    accept = "least(abs(y) * 0.2::DOUBLE, 15.0::DOUBLE)" if timed else "abs(y) * 0.1::DOUBLE"
    crit = "p >= p90" if wait else "p >= p90 * 0.9::DOUBLE"
    eff = ("avg(greatest(e, 0.0::DOUBLE)) / avg(y)" if wait else "1.0::DOUBLE - avg(ae) / avg(y)")
    return f"""
base AS (SELECT {k}, y_true AS y, y_pred AS p FROM {source}),
st AS (SELECT {k}, round(quantile_cont(y, 0.25), 9) AS q1, round(quantile_cont(y, 0.5), 9) AS q2,
              round(quantile_cont(y, 0.75), 9) AS q3, round(quantile_cont(y, 0.9), 9) AS p90
       FROM base GROUP BY {k}),
j AS (SELECT b.*, st.q1, st.q2, st.q3, st.p90, b.y - b.p AS e, abs(b.y - b.p) AS ae,
             CASE WHEN b.y <= st.q1 THEN 1 WHEN b.y <= st.q2 THEN 2 WHEN b.y <= st.q3 THEN 3 ELSE 4 END AS band
      FROM base b JOIN st USING ({k})),
bands AS (SELECT {k}, band,
                 CASE WHEN avg(y) > 0 THEN greatest(0.0::DOUBLE, 1 - avg(ae) / avg(y)) END AS sc
          FROM j GROUP BY {k}, band),
res AS (SELECT {k}, coalesce(avg(sc), 0.0) AS resource_accuracy FROM bands GROUP BY {k}),
m AS (SELECT {k}, count(*) AS n, avg(ae) AS mae, sqrt(avg(e * e)) AS rmse,
             1 - avg(e * e) / nullif(var_pop(y), 0) AS r2,
             CASE WHEN bool_or(y = 0) THEN 'inf'::DOUBLE ELSE avg(abs(e / nullif(y, 0))) * 100 END AS mape,
             avg(CASE WHEN ae <= {accept} THEN 1.0 ELSE 0.0 END) AS clinical_accuracy,
             sum(CASE WHEN y >= p90 THEN 1 ELSE 0 END) AS nc,
             sum(CASE WHEN y >= p90 AND {crit} THEN 1 ELSE 0 END) AS hit,
             {eff} AS efficiency_impact, stddev_pop(e) AS sd, avg(ae) AS mae2
      FROM j GROUP BY {k})
SELECT {", ".join("m." + x for x in keys)}, CAST(m.n AS BIGINT) AS n, {r6("m.mae")} AS mae, {r6("m.rmse")} AS rmse,
       {r6("m.r2")} AS r2, {r6("m.mape")} AS mape, {r6("m.clinical_accuracy")} AS clinical_accuracy,
       {r6("CASE WHEN m.nc > 0 THEN m.hit / m.nc ELSE 1.0 END")} AS critical_detection_rate,
       {r6("res.resource_accuracy")} AS resource_accuracy, {r6("m.efficiency_impact")} AS efficiency_impact,
       {r6("CASE WHEN m.mae2 > 0 THEN least(1.0, greatest(0.0, 1 - m.sd / m.mae2)) ELSE 0.0 END")}
           AS consistency_score
FROM m JOIN res USING ({k})"""


@query("care_metrics_wait",
       with_views("scored", extra=TEST) + ", " + care_metrics_sql("wait_min", ["model", "dataset"]))
def care_metrics_wait(spark, sf):
    return cm.care_metrics(_test(spark, sf), "wait_min", keys=("model", "dataset"))


@query("care_metrics_other",
       with_views("scored", extra=TEST) + ", " + care_metrics_sql("patient_satisfaction", ["model", "region"]))
def care_metrics_other(spark, sf):
    return cm.care_metrics(_test(spark, sf), "patient_satisfaction", keys=("model", "region"))


@query("resource_accuracy", with_views("scored", extra=TEST) + """,
st AS (SELECT model, round(quantile_cont(y_true, 0.25), 9) AS q1, round(quantile_cont(y_true, 0.5), 9) AS q2,
              round(quantile_cont(y_true, 0.75), 9) AS q3 FROM scored_test GROUP BY model),
j AS (SELECT s.model, s.y_true AS y, abs(s.y_true - s.y_pred) AS ae,
             CASE WHEN s.y_true <= q1 THEN 1 WHEN s.y_true <= q2 THEN 2 WHEN s.y_true <= q3 THEN 3 ELSE 4 END AS band
      FROM scored_test s JOIN st USING (model))
SELECT model, band, CAST(count(*) AS BIGINT) AS n, round(avg(ae), 6) AS mae, round(avg(y), 6) AS mean_true,
       round(CASE WHEN avg(y) > 0 THEN greatest(0.0::DOUBLE, 1 - avg(ae) / avg(y)) END, 6) AS score
FROM j GROUP BY model, band""")
def resource_accuracy(spark, sf):
    return cm.resource_bands(_test(spark, sf))


_FAIR_SQL = with_views("scored", extra=TEST) + """,
long AS (SELECT model, 'urgency_level' AS attribute, CAST(urgency_level AS VARCHAR) AS grp, y_true - y_pred AS e
         FROM scored_test
         UNION ALL
         SELECT model, 'region', CAST(region AS VARCHAR), y_true - y_pred FROM scored_test),
g AS (SELECT model, attribute, grp AS group_value, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse,
             CAST(count(*) AS BIGINT) AS n FROM long GROUP BY model, attribute, grp)
"""


@query("fairness_groups", _FAIR_SQL + "SELECT * FROM g")
def fairness_groups(spark, sf):
    return cm.fairness_groups(_test(spark, sf), ["urgency_level", "region"])


@query("fairness_scores", _FAIR_SQL + """,
a AS (SELECT model, attribute, CAST(count(*) AS BIGINT) AS n_groups,
             CASE WHEN min(mae) > 0 THEN max(mae) / min(mae) ELSE 'inf'::DOUBLE END AS mr,
             CASE WHEN min(rmse) > 0 THEN max(rmse) / min(rmse) ELSE 'inf'::DOUBLE END AS rr
      FROM g GROUP BY model, attribute)
SELECT model, attribute, n_groups, round(mr, 6) AS mae_ratio, round(rr, 6) AS rmse_ratio,
       round(1.0 / greatest(mr, rr), 6) AS fairness_score FROM a""")
def fairness_scores(spark, sf):
    return cm.fairness_scores(cm.fairness_groups(_test(spark, sf), ["urgency_level", "region"]))


def _level_sql(pc: str) -> str:
    return f"CASE WHEN {pc} <= 80 THEN 'Information' WHEN {pc} <= 90 THEN 'Warning' ELSE 'Critical' END"


@query("alert_thresholds", with_views("scored", extra=TEST) + f""",
t AS (""" + " UNION ALL ".join(
    f"SELECT model, {pc} AS pc, round(quantile_cont(y_pred, {pc / 100}), 9) AS th FROM scored_test GROUP BY model"
    for pc in (75, 85, 95)) + f""")
SELECT model, CAST(pc AS INTEGER) AS percentile, {_level_sql("pc")} AS alert_level, round(th, 6) AS threshold,
       round((100 - pc) / 100.0, 6) AS expected_frequency,
       CASE WHEN pc <= 80 THEN 'blue' WHEN pc <= 90 THEN 'orange' ELSE 'red' END AS color,
       CASE WHEN {_level_sql("pc")} = 'Critical' THEN '5 minutes' ELSE '30 minutes' END AS response_time,
       {_level_sql("pc")} || ' alert when wait_min exceeds ' || {fmt_num_sql("th", 1)} AS description
FROM t""")
def alert_thresholds(spark, sf):
    return cm.alert_thresholds(_test(spark, sf), "wait_min")


@query("alert_assign", with_views("scored", extra=TEST) + """,
t AS (SELECT model, round(quantile_cont(y_pred, 0.75), 9) AS t1, round(quantile_cont(y_pred, 0.85), 9) AS t2,
             round(quantile_cont(y_pred, 0.95), 9) AS t3 FROM scored_test GROUP BY model)
SELECT s.model, s.id, round(s.y_pred, 6) AS y_pred,
       CASE WHEN s.y_pred > t3 THEN 'Critical' WHEN s.y_pred > t2 THEN 'Warning'
            WHEN s.y_pred > t1 THEN 'Information' ELSE 'None' END AS alert_level
FROM scored_test s JOIN t USING (model)""")
def alert_assign(spark, sf):
    return cm.alert_assign(_test(spark, sf))


@query("confidence_bands", with_views("scored", extra=TEST) + """,
s AS (SELECT model, round(stddev_pop(y_true - y_pred) * 1.28::DOUBLE, 9) AS c80,
             round(stddev_pop(y_true - y_pred) * 1.96::DOUBLE, 9) AS c95 FROM scored_test GROUP BY model)
SELECT model, round(any_value(c80), 6) AS band_80, round(any_value(c95), 6) AS band_95,
       round(avg(CASE WHEN abs(y_true - y_pred) <= c80 THEN 1.0 ELSE 0.0 END), 6) AS within_80,
       round(avg(CASE WHEN abs(y_true - y_pred) <= c95 THEN 1.0 ELSE 0.0 END), 6) AS within_95
FROM scored_test JOIN s USING (model) GROUP BY model""")
def confidence_bands(spark, sf):
    return cm.confidence_bands(_test(spark, sf))


@query("risk_assessment", with_views("scored", extra=TEST) + """,
t AS (SELECT model, round(quantile_cont(y_pred, 0.9), 9) AS th FROM scored_test GROUP BY model),
a AS (SELECT model, any_value(th) AS th, sum(CASE WHEN y_pred > th THEN 1 ELSE 0 END) AS hc, count(*) AS n
      FROM scored_test JOIN t USING (model) GROUP BY model)
SELECT model, round(th, 6) AS risk_threshold, CAST(hc AS BIGINT) AS high_risk_count, CAST(n AS BIGINT) AS n,
       round(hc / n * 100, 6) AS risk_percentage,
       CASE WHEN hc / n * 100 > 15 THEN 'High' WHEN hc / n * 100 > 5 THEN 'Moderate' ELSE 'Low' END AS risk_band
FROM a""")
def risk_assessment(spark, sf):
    return cm.risk_assessment(_test(spark, sf), "wait_min")


@query("improvement_potential", with_views("scored", extra=TEST) + """
SELECT model, round(avg(y_pred), 6) AS mean_pred, round(round(quantile_cont(y_pred, 0.25), 9), 6) AS p25,
       round(greatest(0.0::DOUBLE, (avg(y_pred) - round(quantile_cont(y_pred, 0.25), 9)) / avg(y_pred) * 100), 6)
           AS improvement_pct
FROM scored_test GROUP BY model""")
def improvement_potential(spark, sf):
    return cm.improvement_potential(_test(spark, sf))


@query("performance_quartiles", with_views("scored", extra=TEST) + """,
q AS (SELECT model, round(quantile_cont(y_pred, 0.25), 9) AS q1, round(quantile_cont(y_pred, 0.5), 9) AS q2,
             round(quantile_cont(y_pred, 0.75), 9) AS q3, avg(y_pred) AS m FROM scored_test GROUP BY model)
SELECT model, round(q1, 6) AS q25, round(q2, 6) AS q50, round(q3, 6) AS q75,
       q3 - q1 > q2 AS high_variability, q2 > m * 1.2::DOUBLE AS over_target FROM q""")
def performance_quartiles(spark, sf):
    return cm.performance_quartiles(_test(spark, sf), "wait_min")


@query("high_error_cases", with_views("scored", extra=TEST) + """,
t AS (SELECT model, round(quantile_cont(abs(y_true - y_pred), 0.9), 9) AS th FROM scored_test GROUP BY model),
a AS (SELECT model, any_value(th) AS th, sum(CASE WHEN abs(y_true - y_pred) > th THEN 1 ELSE 0 END) AS nh,
             count(*) AS n FROM scored_test JOIN t USING (model) GROUP BY model)
SELECT model, round(th, 6) AS error_p90, CAST(nh AS BIGINT) AS n_high, CAST(n AS BIGINT) AS n,
       round(nh / n, 6) AS high_error_share, nh / n > 0.1 AS flagged FROM a""")
def high_error_cases(spark, sf):
    return cm.high_error_cases(_test(spark, sf))


@query("wait_guideline", with_views("scored", extra=TEST) + """
SELECT model, round(avg(y_pred), 6) AS avg_predicted_wait,
       CASE WHEN avg(y_pred) > 60 THEN 'Critical' WHEN avg(y_pred) > 30 THEN 'Elevated' ELSE 'Acceptable' END
           AS guideline_band
FROM scored_test GROUP BY model""")
def wait_guideline(spark, sf):
    return cm.wait_guideline(_test(spark, sf))


_VISIT_COLS = ("visit_id", "patient_id", "visit_ts", "event_type", "wait_min", "patient_load", "urgency_level",
               "region", "specialist_availability", "facility_beds", "nurse_staff_ratio", "triage_time_min",
               "registration_time_min", "visit_hour", "urgency_priority")


@query("kpi_overview", with_views("scored", "visits_gappy", extra=TEST) + f""",
ds AS (SELECT stddev_samp(wait_min) AS tsd,
              1.0 - ({" + ".join(f"count(*) - count({c})" for c in _VISIT_COLS)}) / ({len(_VISIT_COLS)}.0::DOUBLE * count(*)) AS dq
       FROM visits_gappy),
g AS (SELECT model, avg((y_true - y_pred) * (y_true - y_pred)) AS mse, var_pop(y_true) AS vy, avg(y_pred) AS mp
      FROM scored_test GROUP BY model)
SELECT model, round((1 - mse / nullif(vy, 0)) * 100, 6) AS accuracy_pct, round(sqrt(mse), 6) AS rmse,
       round(sqrt(mse) / nullif(tsd, 0) * 100, 6) AS relative_error_pct, round(mp, 6) AS avg_prediction,
       round(dq * 100, 6) AS data_quality_pct
FROM g, ds""")
def kpi_overview(spark, sf):
    return cm.kpi_overview(_test(spark, sf), V.visits_gappy(spark, sf), "wait_min")


_NUMERIC_VISIT = ("patient_load", "specialist_availability", "facility_beds", "nurse_staff_ratio", "triage_time_min",
                  "registration_time_min", "visit_hour", "urgency_priority", "patient_id")


@query("bottlenecks", with_views("visits") + """,
w AS (""" + "\n UNION ALL ".join(
    f"SELECT '{c}' AS factor, corr(CAST({c} AS DOUBLE), wait_min) AS r, "
    f"CASE WHEN avg(CAST({c} AS DOUBLE)) <> 0 THEN stddev_samp(CAST({c} AS DOUBLE)) / avg(CAST({c} AS DOUBLE)) "
    f"ELSE 0.0 END AS v FROM visits" for c in _NUMERIC_VISIT) + """),
s AS (SELECT factor, r, v, round(abs(r) * v, 9) AS score FROM w),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, factor) AS rank FROM s)
SELECT CAST(rank AS INTEGER) AS rank, factor, round(r, 6) AS correlation, round(v, 6) AS variability,
       round(score, 6) AS bottleneck_score, rank <= 5 AND score > 0.1 AS significant
FROM k WHERE rank <= 8""")
def bottlenecks(spark, sf):
    return cm.bottlenecks(V.visits(spark, sf), "wait_min", list(_NUMERIC_VISIT))


@query("what_if", with_views("importance") + """,
t AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, feature) AS rank FROM importance),
m AS (""" + "\n UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CAST({f} AS DOUBLE)) AS cv FROM visits" for f in V.VISIT_FEATURES) + """)
SELECT t.model, CAST(t.rank AS INTEGER) AS rank, t.feature, round(m.cv, 6) AS current_value,
       round(CASE WHEN lower(t.feature) LIKE '%ratio%' THEN m.cv * 1.1::DOUBLE ELSE m.cv * 0.9::DOUBLE END, 6)
           AS improved_value,
       round(t.score * 0.1::DOUBLE, 6) AS potential_impact
FROM t JOIN m USING (feature) WHERE t.rank <= 3""")
def what_if(spark, sf):
    return cm.what_if(V.importance(spark, sf), V.visits(spark, sf), list(V.VISIT_FEATURES))


@query("dashboard_summary",
       with_views("scored", extra=TEST) + ", " + care_metrics_sql("wait_min", ["model"]).replace(
           "\nSELECT ", "\n, cmx AS (SELECT ", 1) + """)
SELECT model, """ + ", ".join(
           f"round({c} * 100, 6) AS {c}_gauge" for c in (
               "r2", "clinical_accuracy", "critical_detection_rate", "resource_accuracy",
               "efficiency_impact", "consistency_score")) + " FROM cmx")
def dashboard_summary(spark, sf):
    return cm.dashboard_summary(cm.care_metrics(_test(spark, sf), "wait_min"))
