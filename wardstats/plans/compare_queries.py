"""Queries for evaluation (G1, G10, G11, G17-G21) and comparison (K, D14,
H12, J4/J5) over the scored stand-in table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstats.functions.text import fmt_pct_sql
from wardstats.operators import compare as K
from wardstats.operators import evaluate as G
from wardstats.plans import views as V
from wardstats.operators.wording import WORDS, sql_word
from wardstats.plans.registry import query
from wardstats.sources.files import publish, read_published, scratch_path
from wardstats.plans.sqlviews import FOLD_SQL, SPLIT_SQL, with_views


@query("split_assign", with_views("visits") + f"""
SELECT visit_id, {SPLIT_SQL.format(id="visit_id")} AS split FROM visits""")
def split_assign(spark, sf):
    return G.split_assign(V.visits(spark, sf).select("visit_id"), "visit_id")


@query("regression_scores", with_views("scored") + """
SELECT dataset, model, split, CAST(count(*) AS BIGINT) AS n,
       round(avg((y_true - y_pred) * (y_true - y_pred)), 6) AS mse,
       round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) AS rmse,
       round(1 - avg((y_true - y_pred) * (y_true - y_pred)) / nullif(var_pop(y_true), 0), 6) AS r2,
       round(avg(abs(y_true - y_pred)), 6) AS mae
FROM scored GROUP BY dataset, model, split""")
def regression_scores(spark, sf):
    return G.regression_scores(V.scored(spark, sf))


_FOLDS_SQL = with_views("scored") + f""",
f AS (SELECT dataset, model, {FOLD_SQL.format(id="id")} AS fold, y_true, y_true - y_pred AS e
      FROM scored WHERE split = 'train'),
folds AS (SELECT dataset, model, fold, 1 - avg(e * e) / nullif(var_pop(y_true), 0) AS r2
          FROM f GROUP BY dataset, model, fold)
"""


@query("cv_scores", _FOLDS_SQL + "SELECT dataset, model, fold, round(r2, 6) AS r2 FROM folds")
def cv_scores(spark, sf):
    return G.cv_fold_scores(V.scored(spark, sf))


@query("cv_reliability", _FOLDS_SQL + """,
s AS (SELECT dataset, model, avg(r2) AS m, stddev_pop(r2) AS sd FROM folds GROUP BY dataset, model),
r AS (SELECT *, CASE WHEN m <> 0 THEN 1 - sd / m ELSE 0.0 END AS rel FROM s)
SELECT dataset, model, round(m, 6) AS cv_mean, round(sd, 6) AS cv_std, round(rel, 6) AS reliability,
       CASE WHEN rel > 0.9 THEN 'high' WHEN rel > 0.8 THEN 'moderate' ELSE 'low' END AS reliability_band
FROM r""")
def cv_reliability(spark, sf):
    folds = G.cv_fold_scores(V.scored(spark, sf), rounded=False)
    return K.cv_reliability(G.cv_summary(folds))


_CMP = with_views("comparison")
_CMP_COLS = ("session, dataset, target, model, test_r2, test_rmse, test_mae, cv_score, cv_std, "
             "training_time, overfitting")


@query("model_comparison", _CMP + f"""
SELECT {_CMP_COLS}, CAST(row_number() OVER (ORDER BY test_r2 DESC NULLS LAST, dataset, model) AS INTEGER) AS position,
       greatest(abs(cv_score), 0.1::DOUBLE) AS bubble_size
FROM comparison""")
def model_comparison(spark, sf):
    cmp = K.ranked_by_metric(V.comparison(spark, sf), "test_r2")
    return cmp.withColumn("bubble_size", F.greatest(F.abs("cv_score"), F.lit(0.1)))


@query("published_comparison", _CMP + f"SELECT {_CMP_COLS} FROM comparison")
def published_comparison(spark, sf):
    """The comparison table written as a published version and read back."""
    path = scratch_path(spark, "comparison")
    publish(V.comparison(spark, sf), path)
    return read_published(spark, path)


@query("best_models", _CMP + """,
b AS (SELECT dataset, model, test_r2, row_number() OVER (PARTITION BY dataset ORDER BY test_r2 DESC, model DESC) AS rb,
             count(*) OVER (PARTITION BY dataset) AS n FROM comparison),
l AS (SELECT dataset, model, test_rmse, row_number() OVER (PARTITION BY dataset ORDER BY test_rmse, model) AS rl
      FROM comparison)
SELECT b.dataset, b.model AS best_r2_model, b.test_r2 AS best_r2, l.model AS lowest_rmse_model,
       l.test_rmse AS lowest_rmse, CAST(b.n AS BIGINT) AS n_models
FROM b JOIN l ON b.dataset = l.dataset AND b.rb = 1 AND l.rl = 1""")
def best_models(spark, sf):
    return G.best_models(V.comparison(spark, sf))


@query("ensemble_predict", with_views("scored") + """
SELECT id, any_value(dataset) AS dataset, any_value(y_true) AS y_true, round(avg(y_pred), 6) AS ensemble_pred
FROM scored GROUP BY id""")
def ensemble_predict(spark, sf):
    return G.ensemble_predict(V.scored(spark, sf))


@query("ensemble_weighted", with_views("scored") + """
SELECT id, any_value(dataset) AS dataset, any_value(y_true) AS y_true,
       round(sum(CASE model WHEN 'a' THEN 0.5::DOUBLE WHEN 'b' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END * y_pred), 6)
           AS ensemble_pred
FROM scored WHERE model IN ('a', 'b', 'c') GROUP BY id""")
def ensemble_weighted(spark, sf):
    return G.ensemble_predict(V.scored(spark, sf), weights={"a": 0.5, "b": 0.3, "c": 0.2})


@query("stability_summary", with_views("scored") + """,
x AS (SELECT model, y_true, y_pred, r.run FROM scored, (SELECT unnest(range(5)) AS run) r
      WHERE ('0x' || substr(md5(CAST(r.run AS VARCHAR) || ':' || CAST(id AS VARCHAR)), 1, 8))::BIGINT % 100 < 20),
per AS (SELECT model, run, 1 - avg((y_true - y_pred) * (y_true - y_pred)) / nullif(var_pop(y_true), 0) AS r2,
               sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse FROM x GROUP BY model, run),
s AS (SELECT model, CAST(count(*) AS BIGINT) AS n_runs, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std,
             avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std FROM per GROUP BY model)
SELECT model, n_runs, round(r2_mean, 6) AS r2_mean, round(r2_std, 6) AS r2_std, round(rmse_mean, 6) AS rmse_mean,
       round(rmse_std, 6) AS rmse_std, round(1 - r2_std / nullif(r2_mean, 0), 6) AS consistency_score FROM s""")
def stability_summary(spark, sf):
    return G.stability_summary(V.scored(spark, sf))


@query("comparison_summary", _CMP + """,
b AS (SELECT model, dataset, test_r2 FROM comparison ORDER BY test_r2 DESC, model DESC, dataset DESC LIMIT 1),
l AS (SELECT model, dataset, test_rmse FROM comparison ORDER BY test_rmse, model, dataset LIMIT 1),
a AS (SELECT round(avg(test_r2), 6) AS avg_r2, round(stddev_samp(test_r2), 6) AS std_r2,
             CAST(count(*) AS BIGINT) AS models_count, CAST(count(DISTINCT dataset) AS BIGINT) AS datasets_count
      FROM comparison)
SELECT b.model AS best_model, b.dataset AS best_dataset, b.test_r2 AS best_r2, a.avg_r2, a.std_r2,
       l.model AS lowest_rmse_model, l.test_rmse AS lowest_rmse, a.models_count, a.datasets_count
FROM b, l, a""")
def comparison_summary(spark, sf):
    return K.comparison_summary(V.comparison(spark, sf))


@query("ranked_by_metric", _CMP + f"""
SELECT {_CMP_COLS}, CAST(row_number() OVER (ORDER BY test_rmse ASC NULLS LAST, dataset, model) AS INTEGER) AS position
FROM comparison""")
def ranked_by_metric(spark, sf):
    return K.ranked_by_metric(V.comparison(spark, sf), "test_rmse")


_RANK_SQL = _CMP + """,
long AS (SELECT model, dataset, 'test_r2' AS metric, test_r2 AS value, -test_r2 AS sv FROM comparison
         UNION ALL SELECT model, dataset, 'test_rmse', test_rmse, test_rmse FROM comparison
         UNION ALL SELECT model, dataset, 'test_mae', test_mae, test_mae FROM comparison
         UNION ALL SELECT model, dataset, 'cv_score', cv_score, -cv_score FROM comparison),
ranks AS (SELECT metric, CAST(row_number() OVER (PARTITION BY metric ORDER BY sv NULLS LAST, model, dataset)
                              AS INTEGER) AS rank,
                 model, dataset, value, model || ' (' || dataset || ')' AS model_dataset FROM long)
"""


@query("model_rankings", _RANK_SQL + "SELECT * FROM ranks")
def model_rankings(spark, sf):
    return K.model_rankings(V.comparison(spark, sf))


@query("average_rank", _RANK_SQL + """
SELECT model_dataset, round(avg(rank), 2) AS average_rank FROM ranks GROUP BY model_dataset""")
def average_rank(spark, sf):
    return K.average_rank(K.model_rankings(V.comparison(spark, sf)))


@query("rank_pivot", _RANK_SQL + """
SELECT model_dataset,
       CAST(avg(CASE WHEN metric = 'test_r2' THEN rank END) AS DOUBLE) AS test_r2,
       CAST(avg(CASE WHEN metric = 'test_rmse' THEN rank END) AS DOUBLE) AS test_rmse,
       CAST(avg(CASE WHEN metric = 'test_mae' THEN rank END) AS DOUBLE) AS test_mae,
       CAST(avg(CASE WHEN metric = 'cv_score' THEN rank END) AS DOUBLE) AS cv_score
FROM ranks GROUP BY model_dataset""")
def rank_pivot(spark, sf):
    return K.rank_pivot(K.model_rankings(V.comparison(spark, sf)))


@query("model_consistency", _CMP + """
SELECT model, round(avg(test_r2), 3) AS test_r2_mean, round(stddev_samp(test_r2), 3) AS test_r2_std,
       round(avg(test_rmse), 3) AS test_rmse_mean, round(stddev_samp(test_rmse), 3) AS test_rmse_std,
       round(avg(cv_score), 3) AS cv_score_mean, round(stddev_samp(cv_score), 3) AS cv_score_std
FROM comparison GROUP BY model HAVING (SELECT count(DISTINCT dataset) FROM comparison) > 1""")
def model_consistency(spark, sf):
    return K.model_consistency(V.comparison(spark, sf))


@query("performance_bands", _CMP + """,
m AS (SELECT quantile_cont(test_rmse, 0.5) AS mr, quantile_cont(test_mae, 0.5) AS ma FROM comparison)
SELECT dataset, model,
       CASE WHEN test_r2 >= 0.8 THEN 'green' WHEN test_r2 >= 0.6 THEN 'yellow' ELSE 'red' END AS r2_band,
       CASE WHEN cv_score >= 0.8 THEN 'green' WHEN cv_score >= 0.6 THEN 'yellow' ELSE 'red' END AS cv_band,
       CASE WHEN test_rmse <= mr * 0.8::DOUBLE THEN 'green' WHEN test_rmse <= mr * 1.2::DOUBLE THEN 'yellow'
            ELSE 'red' END AS rmse_band,
       CASE WHEN test_mae <= ma * 0.8::DOUBLE THEN 'green' WHEN test_mae <= ma * 1.2::DOUBLE THEN 'yellow'
            ELSE 'red' END AS mae_band
FROM comparison, m""")
def performance_bands(spark, sf):
    return K.performance_bands(V.comparison(spark, sf))


_PRIMARY = (f"CASE WHEN b.test_r2 > 0.8 THEN {sql_word('rec_deploy1')} || b.model || {sql_word('rec_deploy2')} || "
            + fmt_pct_sql("b.test_r2") + f" || {sql_word('rec_deploy3')} "
            f"WHEN b.test_r2 > 0.6 THEN {sql_word('rec_use1')} || b.model || {sql_word('rec_use2')} ELSE {sql_word('rec_wait')} END")


@query("model_recommendations", _CMP + f""",
b AS (SELECT model, test_r2 FROM comparison ORDER BY test_r2 DESC NULLS LAST, model DESC LIMIT 1),
t AS (SELECT string_agg(model, ', ' ORDER BY rk) AS names FROM (
        SELECT model, row_number() OVER (ORDER BY test_r2 DESC NULLS LAST, model, dataset) AS rk FROM comparison)
      WHERE rk <= 3),
a AS (SELECT stddev_samp(test_r2) AS sd, count(*) AS n, avg(overfitting) AS ovf, max(training_time) AS tt,
             any_value(target) AS target FROM comparison),
cand AS (
  SELECT 'primary' AS section, 1 AS c, {_PRIMARY} AS line FROM b
  UNION ALL SELECT 'primary', 2, CASE WHEN test_r2 > 0.8
        THEN {sql_word('rec_high')}
        WHEN test_r2 > 0.6 THEN {sql_word('rec_mid')}
        ELSE {sql_word('rec_low')} END FROM b
  UNION ALL SELECT 'primary', 3, CASE model
        WHEN 'Random Forest' THEN {sql_word('rec_rf')}
        WHEN 'Gradient Boosting' THEN {sql_word('rec_xgb')}
        WHEN 'Linear Regression' THEN {sql_word('rec_lr')} END FROM b
  UNION ALL SELECT 'considerations', 1, CASE WHEN sd > 0.1
        THEN {sql_word('con_sd')} END FROM a
  UNION ALL SELECT 'considerations', 2, CASE WHEN n > 1 THEN {sql_word('con_top')} || t.names END
        FROM a, t
  UNION ALL SELECT 'considerations', 3, CASE WHEN ovf > 0.1
        THEN {sql_word('con_over')} END FROM a
  UNION ALL SELECT 'considerations', 4, CASE WHEN tt > 60
        THEN {sql_word('con_time')} END FROM a
  UNION ALL SELECT 'success_metrics', 1, {sql_word('suc_1')} FROM a
  UNION ALL SELECT 'success_metrics', 2, {sql_word('suc_2a')} || target || {sql_word('suc_2b')} FROM a
  UNION ALL SELECT 'success_metrics', 3, {sql_word('suc_3')} FROM a
  UNION ALL SELECT 'success_metrics', 4, {sql_word('suc_4')} FROM a
  UNION ALL SELECT 'success_metrics', 5, {sql_word('suc_5')} FROM a)
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY c) AS INTEGER) AS pos, line
FROM cand WHERE line IS NOT NULL""")
def model_recommendations(spark, sf):
    return K.model_recommendations(V.comparison(spark, sf))
