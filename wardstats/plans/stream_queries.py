"""Queries for the streaming operators (M1-M3): each runs a Structured
Streaming plan over the data folder with ``availableNow`` and must equal the
batch SQL on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardstats.functions.percentiles import grouped, percentile_of
from wardstats.functions.stats import thr
from wardstats.operators import models as G
from wardstats.operators import prep as P
from wardstats.plans import views as V
from wardstats.plans.registry import query
from wardstats.plans.sqlviews import with_views
from wardstats.streaming import alerts as M

# stand-in model `a` of the scored table (see views.scored)
PRED_A_SQL = "0.85::DOUBLE * wait_min + (visit_id % 23) - 6"
LEVELS = ((75, "Information"), (85, "Warning"), (95, "Critical"))


def _pred_a(df):
    return F.lit(0.85) * F.col("wait_min") + (F.col("visit_id") % 23) - 6


def fitted_thresholds(spark, sf) -> list[tuple[float, str]]:
    """Batch fit: percentiles of model `a` on the test split (three numbers)."""
    s = V.scored(spark, sf).filter((F.col("split") == "test") & (F.col("model") == "a"))
    row = grouped(s, [], percentile_of("y_pred", [p / 100 for p, _ in LEVELS]).alias("q")).select(
        *[thr(F.col("q")[i]).alias(f"t{i}") for i in range(len(LEVELS))]).first()
    return [(row[f"t{i}"], lvl) for i, (_, lvl) in enumerate(LEVELS)]


_THR_SQL = with_views("scored", extra="""t AS (SELECT round(quantile_cont(y_pred, 0.75), 9) AS t1,
       round(quantile_cont(y_pred, 0.85), 9) AS t2, round(quantile_cont(y_pred, 0.95), 9) AS t3
       FROM scored WHERE split = 'test' AND model = 'a'),
tagged AS (SELECT visit_id, visit_ts, """ + PRED_A_SQL + """ AS y_pred FROM visits),
lv AS (SELECT visit_id, visit_ts, y_pred, CASE WHEN y_pred > t3 THEN 'Critical' WHEN y_pred > t2 THEN 'Warning'
              WHEN y_pred > t1 THEN 'Information' ELSE 'None' END AS alert_level FROM tagged, t)""")


@query("stream_alerts", _THR_SQL + " SELECT visit_id, round(y_pred, 6) AS y_pred, alert_level FROM lv")
def stream_alerts(spark, sf):
    th = fitted_thresholds(spark, sf)
    rows = V.visits_from(M.event_stream(spark, sf)).select("visit_id", _pred_a(None).alias("y_pred"))
    tagged = M.tag_alerts(rows, "y_pred", th)
    out = M.run_to_table(tagged, "stream_alerts")
    return out.select("visit_id", F.round("y_pred", 6).alias("y_pred"), "alert_level")


@query("stream_alert_frequency", _THR_SQL + """,
w AS (SELECT date_trunc('day', visit_ts) AS ws, count(*) AS n,
             sum(CASE WHEN alert_level = 'Information' THEN 1 ELSE 0 END) AS ni,
             sum(CASE WHEN alert_level = 'Warning' THEN 1 ELSE 0 END) AS nw,
             sum(CASE WHEN alert_level = 'Critical' THEN 1 ELSE 0 END) AS nc FROM lv GROUP BY 1)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, 'Information' AS alert_level, CAST(n AS BIGINT) AS n,
       CAST(ni + nw + nc AS BIGINT) AS n_at_or_above, round((ni + nw + nc) / n, 6) AS observed_frequency,
       0.25::DOUBLE AS expected_frequency FROM w
UNION ALL SELECT strftime(ws, '%Y-%m-%d %H:%M:%S'), 'Warning', CAST(n AS BIGINT), CAST(nw + nc AS BIGINT),
       round((nw + nc) / n, 6), 0.15::DOUBLE FROM w
UNION ALL SELECT strftime(ws, '%Y-%m-%d %H:%M:%S'), 'Critical', CAST(n AS BIGINT), CAST(nc AS BIGINT),
       round(nc / n, 6), 0.05::DOUBLE FROM w""")
def stream_alert_frequency(spark, sf):
    th = fitted_thresholds(spark, sf)
    rows = V.visits_from(M.event_stream(spark, sf)).select("visit_ts", _pred_a(None).alias("y_pred"),
                                                           "visit_id")
    tagged = M.tag_alerts(rows, "y_pred", th)
    out, _ = M.run_counts(tagged, "stream_alert_frequency", "visit_ts", "alert_level", [lv for _, lv in LEVELS])
    ws = M.utc_day_text(F.col("w.start"))
    ni, nw, nc = F.col("n_information"), F.col("n_warning"), F.col("n_critical")
    recs = F.array(*[F.struct(F.lit(lv).alias("alert_level"), cnt.alias("k"), F.lit((100 - p) / 100).alias("e"))
                     for (p, lv), cnt in zip(LEVELS, (ni + nw + nc, nw + nc, nc))])
    x = out.select(ws.alias("window_start"), "n", F.inline(recs))
    return x.select("window_start", "alert_level", "n", F.col("k").cast("bigint").alias("n_at_or_above"),
                    F.round(F.col("k") / F.col("n"), 6).alias("observed_frequency"),
                    F.col("e").alias("expected_frequency"))


@query("stream_score", with_views("visits", extra=f"""tr AS (SELECT * FROM visits
   WHERE ('0x' || substr(md5(CAST(visit_id AS VARCHAR)), 1, 8))::BIGINT % 100 >= 20),
c AS (SELECT covar_pop(triage_time_min, triage_time_min) AS s11, covar_pop(patient_load, patient_load) AS s22,
             covar_pop(triage_time_min, patient_load) AS s12, covar_pop(triage_time_min, wait_min) AS s1y,
             covar_pop(patient_load, wait_min) AS s2y, avg(triage_time_min) AS m1, avg(patient_load) AS m2,
             avg(wait_min) AS my FROM tr),
b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
             (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM c)""") + """
SELECT visit_id, round(my - b1 * m1 - b2 * m2 + b1 * triage_time_min + b2 * patient_load, 6) AS y_pred
FROM visits, b""")
def stream_score(spark, sf):
    from wardstats.plans.model_queries import model_input

    feats = ["triage_time_min", "patient_load"]
    mi = model_input(spark, sf)
    train = mi.filter(F.col("split") == "train")
    # batch fit: preprocessing parameters (literals) and the linear model
    params = P.fit_params(train, feats, [])
    prep = P.PrepModel(None, P.PrepOptions(feature_engineering=False), P.Roles(), [], feats, [], **params)
    _, trained = G.fit_predict(prep.apply(mi.select("id", "split", "wait_min", *feats),
                                          keep=["id", "split", "wait_min"]),
                               feats, "wait_min", G.LINEAR, options=G.TrainOptions(scale_features=False))
    stream = V.visits_from(M.event_stream(spark, sf))
    x = prep.apply(stream.select("visit_id", *feats), keep=["visit_id"])
    scored = trained.model.transform(G.assemble(x, feats)).select("visit_id", F.col("prediction").alias("y_pred"))
    out = M.run_to_table(scored, "stream_score")
    return out.select("visit_id", F.round("y_pred", 6).alias("y_pred"))
