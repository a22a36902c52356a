"""Queries for insight / recommendation / action rule tables (J1-J3, J6,
J7) and the text reports (A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstats.functions.text import fmt_num_sql as fn
from wardstats.functions.text import fmt_pct_sql as fp
from wardstats.operators import insights as J
from wardstats.plans import views as V
from wardstats.operators.wording import WORDS, sql_word
from wardstats.plans.registry import query
from wardstats.plans.sqlviews import with_views
from wardstats.sources.files import publish, read_published, scratch_path

_BASE = """scored_test AS (SELECT * FROM scored WHERE split = 'test'),
qst AS (SELECT model, round(quantile_cont(abs(y_true - y_pred), 0.9), 9) AS t,
               round(quantile_cont(y_pred, 0.25), 9) AS p25, round(quantile_cont(y_pred, 0.9), 9) AS p90,
               round(quantile_cont(y_pred, 0.95), 9) AS p95 FROM scored_test GROUP BY model),
quality AS (SELECT model, 1 - avg((y_true - y_pred) * (y_true - y_pred)) / nullif(var_pop(y_true), 0) AS test_r2,
                   avg(y_pred) AS mean_pred, any_value(p25) AS p25,
                   avg(CASE WHEN abs(y_true - y_pred) > t THEN 1.0 ELSE 0.0 END) AS high_error_share,
                   avg(CASE WHEN y_pred > p95 THEN 1.0 ELSE 0.0 END) AS risk_share
            FROM scored_test JOIN qst USING (model) GROUP BY model),
top AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, feature) AS rank FROM importance)"""

INS = with_views("scored", "importance", "visits_gappy", extra=_BASE)


def _has(words) -> str:
    return "(" + " OR ".join(f"lower(feature) LIKE '%{w}%'" for w in words) + ")"


STAFF, CAP, TIMING = _has(["nurse", "staff", "specialist"]), _has(["bed", "capacity", "facility"]), \
    _has(["time", "hour", "day"])


def _test(spark, sf):
    return V.scored(spark, sf).filter(F.col("split") == "test")


def _quality(spark, sf):
    return J.model_quality(_test(spark, sf))


@query("workflow_insights", INS + f""",
fr AS (
  SELECT model, rank * 10 AS o, 'operational_insights' AS section, 'Staffing' AS category,
         feature || {sql_word('driver_title')} || {fn("score", 3)} || ')' AS title,
         {sql_word('staff_plan')} AS detail, 'High' AS level,
         '2-4 weeks' AS timeline FROM top WHERE rank <= 5 AND {STAFF}
  UNION ALL SELECT model, rank * 10, 'resource_optimization', 'Human Resources',
         {sql_word('staff_lever')} || feature, {fn("score * 100", 1)} || {sql_word('staff_share')},
         'Medium', '1-3 months' FROM top WHERE rank <= 5 AND {STAFF}
  UNION ALL SELECT model, rank * 10, 'operational_insights', 'Capacity Management',
         feature || {sql_word('cap_title')} || 'wait_min', {sql_word('cap_plan')},
         'Medium', '4-8 weeks' FROM top WHERE rank <= 5 AND NOT {STAFF} AND {CAP}
  UNION ALL SELECT model, rank * 10, 'resource_optimization', 'Physical Resources',
         {sql_word('cap_lever')} || feature, {fn("score * 100", 1)} || {sql_word('cap_share')},
         'High', '3-6 months' FROM top WHERE rank <= 5 AND NOT {STAFF} AND {CAP}
  UNION ALL SELECT model, rank * 10, 'operational_insights', 'Process Timing',
         {sql_word('time_title1')} || feature || {sql_word('time_title2')},
         {sql_word('time_plan')}, 'High', '1-2 weeks'
         FROM top WHERE rank <= 5 AND NOT {STAFF} AND NOT {CAP} AND {TIMING}
  UNION ALL SELECT model, 1000, 'quality_improvements', 'Model Accuracy', {fp("test_r2")} || {sql_word('r2_title')},
         {sql_word('r2_goal')}, 'High', NULL FROM quality WHERE test_r2 < 0.8
  UNION ALL SELECT model, 1001, 'quality_improvements', 'Prediction Consistency',
         {fn("high_error_share * 100", 1)} || {sql_word('err_title')}, {sql_word('err_goal')}, 'Medium', NULL
         FROM quality WHERE high_error_share > 0.1
  UNION ALL SELECT model, 1002, 'cost_reduction_opportunities', 'Wait Time Reduction',
         {sql_word('wait_title')} || {fn("mean_pred", 1)} || {sql_word('wait_unit')}, {sql_word('wait_goal')},
         'High', NULL FROM quality
  UNION ALL SELECT model, 1003, 'risk_mitigation', 'High-Risk Case Volume',
         {fn("risk_share * 100", 1)} || {sql_word('risk_title')},
         {sql_word('risk_plan')}, 'Critical', NULL
         FROM quality WHERE risk_share * 100 > 10)
SELECT model, section, CAST(row_number() OVER (PARTITION BY model, section ORDER BY o, category) AS INTEGER) AS position,
       category, title, detail, level, timeline,
       CASE category WHEN 'Model Accuracy' THEN {sql_word('r2_do')} WHEN 'Prediction Consistency' THEN {sql_word('err_do')} END AS actions,
       CASE category WHEN 'Wait Time Reduction' THEN {sql_word('wait_save')} END AS savings_potential,
       CASE category WHEN 'Wait Time Reduction' THEN {sql_word('wait_do')} END AS implementation FROM fr""")
def workflow_insights(spark, sf):
    return J.workflow_insights(V.importance(spark, sf), _quality(spark, sf), "wait_min")


_J2_STAFF, _J2_CAP, _J2_TIME, _J2_PRIO = _has(["nurse", "staff"]), _has(["bed", "capacity"]), _has(["time", "hour"]), \
    _has(["urgent", "priority"])


@query("driver_insights", INS + f"""
SELECT model, CAST(rank AS INTEGER) AS rank, feature,
       CASE WHEN {_J2_STAFF} THEN 'Staffing Impact' WHEN {_J2_CAP} THEN 'Capacity Management'
            WHEN {_J2_TIME} THEN 'Timing Factors' WHEN {_J2_PRIO} THEN 'Priority Management' ELSE 'Key Factor' END
           AS category,
       feature || CASE WHEN {_J2_STAFF} THEN {sql_word('j2_staff')}
                       WHEN {_J2_CAP} THEN {sql_word('j2_cap')}
                       WHEN {_J2_TIME} THEN {sql_word('j2_time')}
                       WHEN {_J2_PRIO} THEN {sql_word('j2_prio')}
                       ELSE {sql_word('j2_other')} END || {fn("score", 3)} || ')' AS text
FROM top WHERE rank <= 5""")
def driver_insights(spark, sf):
    return J.driver_insights(V.importance(spark, sf))


@query("clinical_recommendations", INS + f"""
SELECT * FROM (
SELECT model, CAST(rank AS INTEGER) AS rank, feature,
       CASE WHEN {_J2_STAFF} THEN 'Staffing' WHEN {_J2_CAP} THEN 'Capacity Management'
            WHEN {_J2_TIME} THEN 'Process Timing' END AS category,
       CASE WHEN {_J2_STAFF} THEN 'High' WHEN {_J2_CAP} THEN 'Medium' WHEN {_J2_TIME} THEN 'High' END AS priority,
       CASE WHEN {_J2_STAFF} THEN {sql_word('j3_staff1')} || feature || {sql_word('j3_staff2')} || {fn("score", 3)} || {sql_word('j3_staff3')}
            WHEN {_J2_CAP} THEN {sql_word('j3_cap1')} || feature || {sql_word('j3_cap2')}
            WHEN {_J2_TIME} THEN {sql_word('j3_time1')} || feature END AS recommendation,
       CASE WHEN {_J2_STAFF} THEN {sql_word('j3_staff_do')}
            WHEN {_J2_CAP} THEN {sql_word('j3_cap_do')}
            WHEN {_J2_TIME} THEN {sql_word('j3_time_do')} END AS action,
       CASE WHEN {_J2_STAFF} THEN '2-4 weeks' WHEN {_J2_CAP} THEN '4-8 weeks' WHEN {_J2_TIME} THEN '1-2 weeks' END
           AS timeline,
       CASE WHEN {_J2_STAFF} THEN {sql_word('j3_staff_ev1')} || {fp("score")} || {sql_word('j3_staff_ev2')}
            WHEN {_J2_CAP} THEN {sql_word('j3_cap_ev1')} || {fp("score")} || {sql_word('j3_cap_ev2')}
            WHEN {_J2_TIME} THEN {sql_word('j3_time_ev1')} || {fp("score")} || {sql_word('j3_time_ev2')} END AS evidence
FROM top WHERE rank <= 5) WHERE category IS NOT NULL""")
def clinical_recommendations(spark, sf):
    return J.clinical_recommendations(V.importance(spark, sf))


_VG_COLS = ("visit_id", "patient_id", "visit_ts", "event_type", "wait_min", "patient_load", "urgency_level", "region",
            "specialist_availability", "facility_beds", "nurse_staff_ratio", "triage_time_min", "registration_time_min",
            "visit_hour", "urgency_priority")

_ITEMS = INS + f""",
miss AS (SELECT ({" + ".join(f"(count(*) - count({c}))" for c in _VG_COLS)}) / (count(*) * {len(_VG_COLS)}) AS m
         FROM visits_gappy),
items AS (
  SELECT model, rank AS o, 'High' AS priority, {sql_word('j3_staff1')} || feature AS action,
         {sql_word('item_driver')} || {fn("score", 3)} || ')' AS description,
         {sql_word('item_owner1')} AS responsible, '2-4 weeks' AS timeline,
         {sql_word('item_goal1')} || feature || {sql_word('item_goal1b')} AS success_metric, 'Not Started' AS status
  FROM top WHERE rank <= 3
  UNION ALL SELECT model, 100, 'Medium', {sql_word('item_data')}, {sql_word('j3_cap1')} || {fp("m")} || {sql_word('item_data2')},
         {sql_word('item_owner2')}, '4-6 weeks', {sql_word('item_goal2')}, 'Not Started' FROM quality, miss
         WHERE m > 0.05
  UNION ALL SELECT model, 101, 'Medium', {sql_word('item_model')}, {sql_word('item_model2')} || {fp("test_r2")},
         {sql_word('item_owner3')}, '6-8 weeks', {sql_word('item_goal3')}, 'Not Started' FROM quality
         WHERE test_r2 < 0.8),
numbered AS (SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY o) AS INTEGER) AS item, priority, action,
                    description, responsible, timeline, success_metric, status FROM items)
"""


def _items(spark, sf, imp=None, quality=None):
    imp = imp if imp is not None else V.importance(spark, sf)
    quality = quality if quality is not None else _quality(spark, sf)
    return J.action_items(imp, quality, V.visits_gappy(spark, sf))


@query("action_items", _ITEMS + "SELECT * FROM numbered")
def action_items(spark, sf):
    return _items(spark, sf)


@query("published_actions", _ITEMS + "SELECT * FROM numbered")
def published_actions(spark, sf):
    """The action table written as a published version and read back."""
    path = scratch_path(spark, "actions")
    publish(_items(spark, sf), path)
    return read_published(spark, path)


@query("action_progress", _ITEMS + """
SELECT model, CAST(count(*) AS BIGINT) AS total_actions,
       CAST(sum(CASE WHEN status = 'Not Started' THEN 1 ELSE 0 END) AS BIGINT) AS not_started,
       CAST(sum(CASE WHEN status = 'In Progress' THEN 1 ELSE 0 END) AS BIGINT) AS in_progress,
       CAST(sum(CASE WHEN status = 'Completed' THEN 1 ELSE 0 END) AS BIGINT) AS completed,
       CAST(sum(CASE WHEN status = 'Blocked' THEN 1 ELSE 0 END) AS BIGINT) AS blocked,
       round(sum(CASE WHEN status = 'Completed' THEN 1 ELSE 0 END) / count(*) * 100, 6) AS completion_rate
FROM numbered GROUP BY model""")
def action_progress(spark, sf):
    return J.action_progress(_items(spark, sf))


def _lines_sql(lines, start: int, src: str) -> str:
    return "\n UNION ALL ".join(f"SELECT {start + i} AS pos, {ln} AS line FROM {src}" for i, ln in enumerate(lines))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("comparison_report", with_views("comparison") + f""",
c AS (SELECT *, row_number() OVER (ORDER BY dataset, model) AS rk FROM comparison),
a AS (SELECT count(*) AS n, count(DISTINCT dataset) AS nd, avg(test_r2) AS ar, avg(test_rmse) AS am FROM c),
b AS (SELECT model, dataset, test_r2 FROM c ORDER BY test_r2 DESC, rk LIMIT 1),
l AS (SELECT model, dataset, test_rmse FROM c ORDER BY test_rmse, rk LIMIT 1),
one AS (SELECT a.*, b.model AS bm, b.dataset AS bd, b.test_r2 AS br, l.model AS lm, l.dataset AS ld,
               l.test_rmse AS lr FROM a, b, l)
""" + _lines_sql([
    _q(WORDS["rep_title"]), _q("=" * 60),
    f"{sql_word('rep_models')} || CAST(n AS VARCHAR)", f"{sql_word('rep_sets')} || CAST(nd AS VARCHAR)", "''",
    _q(WORDS["rep_sum"]), _q("-" * 20),
    f"{sql_word('rep_best')} || bm || ' on ' || bd || ' (R² = ' || {fn('br', 3)} || ')'",
    f"{sql_word('rep_low')} || lm || ' on ' || ld || ' (RMSE = ' || {fn('lr', 3)} || ')'",
    f"{sql_word('rep_avg_r2')} || {fn('ar', 3)}", f"{sql_word('rep_avg_rmse')} || {fn('am', 3)}", "''",
    _q(WORDS["rep_detail"]), _q("-" * 30)], 1, "one") + f"""
 UNION ALL SELECT 15 + (rk - 1) * 4, 'Model: ' || model || ' | Dataset: ' || dataset || ' | Target: ' || target FROM c
 UNION ALL SELECT 16 + (rk - 1) * 4, {sql_word('rep_row_r2')} || {fn('test_r2', 3)} || ' | RMSE: ' || {fn('test_rmse', 3)}
                  || ' | MAE: ' || {fn('test_mae', 3)} FROM c
 UNION ALL SELECT 17 + (rk - 1) * 4, {sql_word('rep_row_cv')} || {fn('cv_score', 3)} || ' ± ' || {fn('cv_std', 3)} FROM c
 UNION ALL SELECT 18 + (rk - 1) * 4, '' FROM c""")
def comparison_report(spark, sf):
    return J.comparison_report(V.comparison(spark, sf))


_AR_TAIL = ["", WORDS["tail_0"], "-" * 30, WORDS["tail_1"],
            WORDS["tail_2"], WORDS["tail_3"],
            WORDS["tail_4"], WORDS["tail_5"], "",
            WORDS["tail_6"]]


@query("action_report", _ITEMS + f""",
qa AS (SELECT * FROM quality WHERE model = 'a'),
ia AS (SELECT * FROM numbered WHERE model = 'a'),
k AS (SELECT count(*) AS k FROM ia),
da AS (SELECT * FROM top WHERE model = 'a' AND rank <= 5),
d AS (SELECT count(*) AS d FROM da)
""" + _lines_sql([
    _q(WORDS["act_title"]), _q("=" * 50), _q(WORDS["act_target"] + "wait_min"),
    _q(WORDS["act_model"] + "a"), f"{sql_word('act_r2')} || {fp('test_r2')}", "''", _q(WORDS["act_sum"]), _q("-" * 20),
    f"{sql_word('act_now')} || {fn('mean_pred', 2)}",
    f"{sql_word('act_gain')} || {fn('greatest(0.0::DOUBLE, (mean_pred - p25) / mean_pred * 100)', 1)} || '%'",
    f"{sql_word('act_rel')} || {fp('test_r2')}", "''", _q(WORDS["act_items"]), _q("-" * 15)], 1, "qa") + f"""
 UNION ALL SELECT 15 + (item - 1) * 7, CAST(item AS VARCHAR) || '. ' || action || ' [' || priority || {sql_word('act_prio')} FROM ia
 UNION ALL SELECT 16 + (item - 1) * 7, {sql_word('act_desc')} || description FROM ia
 UNION ALL SELECT 17 + (item - 1) * 7, {sql_word('act_owner')} || responsible FROM ia
 UNION ALL SELECT 18 + (item - 1) * 7, {sql_word('act_when')} || timeline FROM ia
 UNION ALL SELECT 19 + (item - 1) * 7, {sql_word('act_goal')} || success_metric FROM ia
 UNION ALL SELECT 20 + (item - 1) * 7, {sql_word('act_status')} || status FROM ia
 UNION ALL SELECT 21 + (item - 1) * 7, '' FROM ia
 UNION ALL SELECT 15 + k * 7, {sql_word('act_drivers')} FROM k
 UNION ALL SELECT 16 + k * 7, '""" + "-" * 25 + f"""' FROM k
 UNION ALL SELECT 17 + k * 7 + rank - 1, '• ' || feature || ': ' || {fn('score', 3)} || {sql_word('j3_staff3')} FROM da, k
""" + "".join(f" UNION ALL SELECT 17 + k * 7 + d + {i}, {_q(ln)} FROM k, d\n" for i, ln in enumerate(_AR_TAIL)))
def action_report(spark, sf):
    imp, quality = V.importance(spark, sf), _quality(spark, sf)
    items = _items(spark, sf, imp, quality)
    return J.action_report(quality, items, imp, "wait_min", "a")
