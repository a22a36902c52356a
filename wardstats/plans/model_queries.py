"""Queries for model fitting and scoring.

Full reference configurations are checked by row count and unit tests; the
degenerate configurations of SURVEY §7.4 (depth-1 trees on one binary
feature, OLS on one or two features) have exact SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstats.operators import models as G
from wardstats.operators.evaluate import split_assign
from wardstats.operators.transform import LOS_EDGES, los_bins, map_lookup, replace_and_cast
from wardstats.plans import views as V
from wardstats.plans.registry import query
from wardstats.plans.sqlviews import FOLD_SQL, SPLIT_SQL, with_views
from wardstats.sources.files import scratch_path

LOS_LABELS = LOS_EDGES[1:]
MODEL_FEATURES = ["nurse_staff_ratio", "specialist_availability", "facility_beds", "triage_time_min",
                  "registration_time_min", "patient_load", "visit_hour", "urgency_priority"]

MI = with_views("visits", extra=f"""mi AS (SELECT *, visit_id AS id, {SPLIT_SQL.format(id="visit_id")} AS split,
                                        CAST(urgency_priority = 4 AS DOUBLE) AS is_critical FROM visits)""")


def model_input(spark, sf):
    v = V.visits(spark, sf).withColumn("id", F.col("visit_id"))
    v = v.withColumn("is_critical", (F.col("urgency_priority") == 4).cast("double"))
    return split_assign(v, "id")


def _preds(scored):
    return scored.filter(F.col("split") == "test").select("id", F.round("y_pred", 6).alias("y_pred"))


_OLS2 = """,
tr AS (SELECT * FROM mi WHERE split = 'train'),
c AS (SELECT covar_pop(triage_time_min, triage_time_min) AS s11, covar_pop(patient_load, patient_load) AS s22,
             covar_pop(triage_time_min, patient_load) AS s12, covar_pop(triage_time_min, wait_min) AS s1y,
             covar_pop(patient_load, wait_min) AS s2y, avg(triage_time_min) AS m1, avg(patient_load) AS m2,
             avg(wait_min) AS my FROM tr),
b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM c),
coef AS (SELECT my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM b)
"""


@query("linreg_coef", MI + _OLS2 + """
SELECT 'intercept' AS term, round(b0, 6) AS coef FROM coef
UNION ALL SELECT 'triage_time_min', round(b1, 6) FROM coef
UNION ALL SELECT 'patient_load', round(b2, 6) FROM coef""")
def linreg_coef(spark, sf):
    _, tr = G.fit_predict(model_input(spark, sf), ["triage_time_min", "patient_load"], "wait_min", G.LINEAR,
                          options=G.TrainOptions(scale_features=False))
    return G.linear_coefficients(tr).select("term", F.round("coef", 6).alias("coef"))


@query("linreg_predict", MI + _OLS2 + """
SELECT id, round(b0 + b1 * triage_time_min + b2 * patient_load, 6) AS y_pred FROM mi, coef WHERE split = 'test'""")
def linreg_predict(spark, sf):
    s, _ = G.fit_predict(model_input(spark, sf), ["triage_time_min", "patient_load"], "wait_min", G.LINEAR,
                         options=G.TrainOptions(scale_features=False))
    return _preds(s)


@query("linreg_clean", MI + """,
tr AS (SELECT * FROM mi WHERE split = 'train'),
q AS (SELECT quantile_cont(patient_load, 0.25) AS q1, quantile_cont(patient_load, 0.75) AS q3 FROM tr),
fl AS (SELECT tr.*, patient_load < round(q1 - 1.5 * (q3 - q1), 9) OR patient_load > round(q3 + 1.5 * (q3 - q1), 9) AS o FROM tr, q),
s AS (SELECT sum(CASE WHEN o THEN 1 ELSE 0 END) AS nf, count(*) AS n FROM fl),
fit AS (SELECT regr_slope(wait_min, patient_load) AS b1, regr_intercept(wait_min, patient_load) AS b0
        FROM fl, s WHERE NOT (nf > 0 AND nf < n * 0.1 AND o))
SELECT id, round(b0 + b1 * patient_load, 6) AS y_pred FROM mi, fit WHERE split = 'test'""")
def linreg_clean(spark, sf):
    """Outlier handling inside training: guarded, on the training rows only."""
    s, _ = G.fit_predict(model_input(spark, sf), ["patient_load"], "wait_min", G.LINEAR,
                         options=G.TrainOptions(handle_outliers=True))
    return _preds(s)


@query("predict_stored", MI + _OLS2 + """
SELECT id, round(b0 + b1 * triage_time_min + b2 * patient_load, 6) AS y_pred FROM mi, coef WHERE split = 'test'""")
def predict_stored(spark, sf):
    """Fitted and saved on the training rows, loaded and applied to the rest."""
    rows = model_input(spark, sf)
    model = G.fit_pipeline(rows.filter(F.col("split") == "train"), ["triage_time_min", "patient_load"], "wait_min", G.LINEAR)
    path = scratch_path(spark, "model")
    G.save_model(model, path)
    return G.score_rows(path, rows.filter(F.col("split") == "test"), ["id"]).select("id", F.round("y_pred", 6).alias("y_pred"))


@query("stability_refit", MI + """,
r AS (SELECT unnest(range(5)) AS run),
x AS (SELECT run, wait_min AS y, triage_time_min AS x,
             ('0x' || substr(md5(CAST(run AS VARCHAR) || ':' || CAST(id AS VARCHAR)), 1, 8))::BIGINT % 100 < 20 AS test FROM mi, r),
fit AS (SELECT run, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM x WHERE NOT test GROUP BY run),
per AS (SELECT x.run, 1 - avg((y - b0 - b1 * x) * (y - b0 - b1 * x)) / var_pop(y) AS r2, sqrt(avg((y - b0 - b1 * x) * (y - b0 - b1 * x))) AS rmse
        FROM x JOIN fit ON fit.run = x.run WHERE test GROUP BY x.run)
SELECT 'Linear Regression' AS model, CAST(count(*) AS BIGINT) AS n_runs, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std,
       round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std, round(1 - stddev_pop(r2) / avg(r2), 6) AS consistency_score FROM per""")
def stability_refit(spark, sf):
    runs = G.stability_refit(model_input(spark, sf), ["triage_time_min"], "wait_min", G.LINEAR)
    out = G.stability_of_runs(runs).drop("seconds_mean", "seconds_std")  # times differ from run to run
    return out.select(*[F.round(c, 6).alias(c) if c not in ("model", "n_runs") else c for c in out.columns])


_GROUP_MEAN = """,
gm AS (SELECT is_critical, avg(wait_min) AS m FROM mi WHERE split = 'train' GROUP BY is_critical)
SELECT id, round(gm.m, 6) AS y_pred FROM mi JOIN gm USING (is_critical) WHERE split = 'test'"""

_DEGENERATE = {
    "rf_predict": (G.RANDOM_FOREST, dict(numTrees=1, maxDepth=1, bootstrap=False, featureSubsetStrategy="all",
                                         subsamplingRate=1.0, minInstancesPerNode=1)),
    "gbt_predict": (G.BOOSTING, dict(maxIter=1, maxDepth=1, subsamplingRate=1.0, featureSubsetStrategy="all")),
    "dt_predict": ("Decision Tree", dict(maxDepth=1)),
}


def _degenerate(name):
    model, params = _DEGENERATE[name]

    def run(spark, sf):
        s, _ = G.fit_predict(model_input(spark, sf), ["is_critical"], "wait_min", model,
                             options=G.TrainOptions(scale_features=False), **params)
        return _preds(s)

    run.__name__ = name
    return run


for _name in _DEGENERATE:
    query(_name, MI + _GROUP_MEAN)(_degenerate(_name))


_STAYS_CLS = with_views("stays", extra=f"""sc AS (
  SELECT stay_id AS id, {SPLIT_SQL.format(id="stay_id")} AS split,
         CAST(admission_type = 'O' AS DOUBLE) AS is_open,
         CAST(CASE WHEN los > 0 AND los <= 5 THEN 5 WHEN los > 5 AND los <= 10 THEN 10 WHEN los > 10 AND los <= 20 THEN 20
              WHEN los > 20 AND los <= 30 THEN 30 WHEN los > 30 AND los <= 50 THEN 50
              WHEN los > 50 AND los <= 120 THEN 120 END AS DOUBLE) AS los_label
  FROM (SELECT *, CAST(CASE WHEN length_of_stay = '120 +' THEN '120' ELSE length_of_stay END AS INTEGER) AS los
        FROM stays)),
maj AS (SELECT is_open, los_label AS pred FROM (
          SELECT is_open, los_label, row_number() OVER (PARTITION BY is_open ORDER BY count(*) DESC, los_label) AS rk
          FROM sc WHERE split = 'train' GROUP BY is_open, los_label) WHERE rk = 1),
cp AS (SELECT id, los_label AS y_true, pred AS y_pred FROM sc JOIN maj USING (is_open) WHERE split = 'test')""")


def _stays_classified(spark, sf):
    s = replace_and_cast(V.stays(spark, sf), "length_of_stay")
    s = los_bins(s, "length_of_stay").withColumn("id", F.col("stay_id"))
    # classes are indexed 0..5 in label order for the classifier, mapped back after
    s = s.withColumn("is_open", (F.col("admission_type") == "O").cast("double")) \
        .withColumn("los_class", map_lookup("los_label", [(v, float(i)) for i, v in enumerate(LOS_LABELS)]))
    s = split_assign(s, "id")
    scored, _ = G.fit_predict(s, ["is_open"], "los_class", "Decision Tree Classifier",
                              options=G.TrainOptions(scale_features=False), maxDepth=1)
    back = [(float(i), float(v)) for i, v in enumerate(LOS_LABELS)]
    return scored.filter(F.col("split") == "test").select(
        "id", map_lookup("y_true", back).alias("y_true"), map_lookup("y_pred", back).alias("y_pred"))


@query("dtc_predict", _STAYS_CLS + " SELECT id, y_pred FROM cp")
def dtc_predict(spark, sf):
    return _stays_classified(spark, sf).select("id", "y_pred")


@query("classification_report", _STAYS_CLS + """,
yt AS (SELECT y_true AS label, count(*) AS support, sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS tp
       FROM cp GROUP BY y_true),
yp AS (SELECT y_pred AS label, count(*) AS predicted FROM cp GROUP BY y_pred),
j AS (SELECT CAST(coalesce(yt.label, yp.label) AS VARCHAR) AS label, coalesce(support, 0) AS support,
             coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted FROM yt FULL OUTER JOIN yp ON yt.label = yp.label),
per AS (SELECT label, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS p,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM j),
per2 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM per)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, CAST(support AS BIGINT) AS support
FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
                 round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per2""")
def classification_report(spark, sf):
    return G.classification_report(_stays_classified(spark, sf))


@query("cv_ols_scores", MI + f""",
f AS (SELECT wait_min, triage_time_min, {FOLD_SQL.format(id="id")} AS fold FROM mi WHERE split = 'train'),
k AS (SELECT unnest(range(5)) AS fold),
fit AS (SELECT k.fold, regr_slope(f.wait_min, f.triage_time_min) AS b1, regr_intercept(f.wait_min, f.triage_time_min) AS b0
        FROM k JOIN f ON f.fold <> k.fold GROUP BY k.fold)
SELECT 'Linear Regression' AS model, CAST(f.fold AS INTEGER) AS fold,
       round(1 - avg((f.wait_min - (fit.b0 + fit.b1 * f.triage_time_min)) * (f.wait_min - (fit.b0 + fit.b1 * f.triage_time_min)))
             / var_pop(f.wait_min), 6) AS r2
FROM f JOIN fit ON f.fold = fit.fold GROUP BY f.fold""")
def cv_ols_scores(spark, sf):
    return G.cv_fold_r2(model_input(spark, sf), ["triage_time_min"], "wait_min", G.LINEAR, 5)


@query("top_features", with_views("importance") + """
SELECT model, feature, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, feature) AS rank FROM importance)
WHERE rank <= 3""")
def top_features(spark, sf):
    return G.top_features(V.importance(spark, sf), 3)


# ---------------------------------------------------------------- full configurations (rows-only)

@query("rff_predict")
def rff_predict(spark, sf):
    s, _ = G.fit_predict(model_input(spark, sf), MODEL_FEATURES, "wait_min", G.KERNEL)
    return _preds(s)


@query("train_compare")
def train_compare(spark, sf):
    cmp = G.train_models(model_input(spark, sf), MODEL_FEATURES, "wait_min", dataset="visits").comparison
    return cmp


@query("feature_importance")
def feature_importance(spark, sf):
    _, tr = G.fit_predict(model_input(spark, sf), MODEL_FEATURES, "wait_min", G.RANDOM_FOREST)
    return G.feature_importance(tr, MODEL_FEATURES)


@query("grid_search")
def grid_search(spark, sf):
    grid = {"maxDepth": [5, 10, 15, 30], "minInstancesPerNode": [1, 2, 4]}
    return G.grid_search(model_input(spark, sf), MODEL_FEATURES, "wait_min", "Decision Tree", grid)
