"""Domain metrics over a scored table.

Input: a long table with one row per (id, model) holding ``y_true`` and
``y_pred`` plus any grouping columns. Every operator is one or two
aggregation passes:

* per-group thresholds (percentiles, sigma) are computed by one ``groupBy``
  and attached with :func:`lookup_join` (size-checked broadcast) or, for
  key-less stats, as scalar subqueries;
* the metric itself is a second ``groupBy`` whose partial aggregates are
  combined map-side, so a group holding a third of all rows is still spread
  over every task until the final (tiny) merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstats.functions.joins import lookup_join, with_scalars
from wardstats.functions.percentiles import grouped, percentile_of
from wardstats.functions.stats import corr, count_if, r6, share, std0, std1, thr
from wardstats.functions.text import fmt_num

INF = float("inf")


def _is_wait(target: str) -> bool:
    return "wait" in target.lower()


def _is_timed(target: str) -> bool:
    t = target.lower()
    return "wait" in t or "time" in t


def attach_stats(df: DataFrame, stats: DataFrame, keys) -> DataFrame:
    """Attach per-group (or global, when ``keys`` is empty) statistics."""
    keys = list(keys)
    if keys:
        return lookup_join(df, stats, keys)
    return with_scalars(df, stats)


def group_stats(df: DataFrame, keys, *aggs) -> DataFrame:
    """Aggregates per group; percentiles are exact and no group meets in one
    task (:mod:`wardstats.functions.percentiles`)."""
    return grouped(df, keys, *aggs)


# --------------------------------------------------------------------------
# H1-H7: the healthcare metric row
# --------------------------------------------------------------------------

def care_metrics(scored: DataFrame, target: str, keys=("model",), y: str = "y_true",
                 p: str = "y_pred") -> DataFrame:
    """MAE, RMSE, R², MAPE, clinical accuracy, critical-case detection,
    resource-planning accuracy, efficiency impact and consistency per group.

    ``target`` selects the wait/time variants as in the reference."""
    keys = list(keys)
    base = scored.select(*keys, F.col(y).alias("_y"), F.col(p).alias("_p"))
    q = percentile_of("_y", [0.25, 0.5, 0.75, 0.9])
    stats = group_stats(base, keys, q.alias("_q")).select(
        *keys, *[thr(F.col("_q")[i]).alias(n) for i, n in enumerate(("_q1", "_q2", "_q3", "_p90"))])
    j = attach_stats(base, stats, keys)
    yv, pv = F.col("_y"), F.col("_p")
    e = yv - pv
    ae = F.abs(e)
    accept = F.least(F.abs(yv) * 0.2, F.lit(15.0)) if _is_timed(target) else F.abs(yv) * 0.1
    crit_act = yv >= F.col("_p90")
    crit_pred = pv >= F.col("_p90") if _is_wait(target) else pv >= F.col("_p90") * 0.9
    band = (F.when(yv <= F.col("_q1"), 1).when(yv <= F.col("_q2"), 2)
            .when(yv <= F.col("_q3"), 3).otherwise(4))
    band_aggs = []
    for b in (1, 2, 3, 4):
        inb = band == b
        band_aggs += [F.avg(F.when(inb, ae)).alias(f"_mae{b}"), F.avg(F.when(inb, yv)).alias(f"_mean{b}")]
    eff = (F.try_divide(F.avg(F.greatest(e, F.lit(0.0))), F.avg(yv)) if _is_wait(target)
           else F.lit(1.0) - F.try_divide(F.avg(ae), F.avg(yv)))
    agg = group_stats(
        j, keys,
        F.count(F.lit(1)).alias("n"),
        F.avg(ae).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(yv))).alias("r2"),
        F.when(F.bool_or(yv == 0), F.lit(INF)).otherwise(F.avg(F.abs(F.try_divide(e, yv))) * 100).alias("mape"),
        share(ae <= accept).alias("clinical_accuracy"),
        count_if(crit_act).alias("_nc"),
        count_if(crit_act & crit_pred).alias("_hit"),
        eff.alias("efficiency_impact"),
        std0(e).alias("_sd"), F.avg(ae).alias("_mae"),
        *band_aggs,
    )
    band_scores = [F.when(F.col(f"_mean{b}") > 0,
                          F.greatest(F.lit(0.0), 1 - F.col(f"_mae{b}") / F.col(f"_mean{b}")))
                   for b in (1, 2, 3, 4)]
    n_ok = sum(F.when(s.isNotNull(), 1).otherwise(0) for s in band_scores)
    s_ok = sum(F.coalesce(s, F.lit(0.0)) for s in band_scores)
    resource = F.when(n_ok > 0, s_ok / n_ok).otherwise(F.lit(0.0))
    consistency = F.when(F.col("_mae") > 0, F.least(F.lit(1.0), F.greatest(
        F.lit(0.0), 1 - F.col("_sd") / F.col("_mae")))).otherwise(F.lit(0.0))
    return agg.select(
        *keys, "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("r2").alias("r2"),
        r6("mape").alias("mape"), r6("clinical_accuracy").alias("clinical_accuracy"),
        r6(F.when(F.col("_nc") > 0, F.col("_hit") / F.col("_nc")).otherwise(F.lit(1.0)))
        .alias("critical_detection_rate"),
        r6(resource).alias("resource_accuracy"),
        r6("efficiency_impact").alias("efficiency_impact"),
        r6(consistency).alias("consistency_score"),
    )


def resource_bands(scored: DataFrame, keys=("model",), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """H5 detail: one row per y-quartile band with its MAE, mean and score."""
    keys = list(keys)
    base = scored.select(*keys, F.col(y).alias("_y"), F.col(p).alias("_p"))
    stats = group_stats(base, keys, percentile_of("_y", [0.25, 0.5, 0.75]).alias("_q")).select(
        *keys, *[thr(F.col("_q")[i]).alias(f"_q{i + 1}") for i in range(3)])
    j = attach_stats(base, stats, keys)
    yv = F.col("_y")
    band = (F.when(yv <= F.col("_q1"), 1).when(yv <= F.col("_q2"), 2)
            .when(yv <= F.col("_q3"), 3).otherwise(4))
    out = j.groupBy(*keys, band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(yv - F.col("_p"))).alias("_mae"),
        F.avg(yv).alias("_mean"))
    return out.select(*keys, "band", "n", r6("_mae").alias("mae"), r6("_mean").alias("mean_true"),
                      r6(F.when(F.col("_mean") > 0, F.greatest(F.lit(0.0), 1 - F.col("_mae") / F.col("_mean"))))
                      .alias("score"))


# --------------------------------------------------------------------------
# H8 fairness
# --------------------------------------------------------------------------

def fairness_groups(scored: DataFrame, attributes, keys=("model",), y: str = "y_true",
                    p: str = "y_pred") -> DataFrame:
    """MAE, RMSE and count per (attribute, group); attributes are unpivoted
    so one scan and one aggregation serve all of them."""
    keys = list(keys)
    stack = "stack({}, {}) as (attribute, grp)".format(
        len(attributes), ", ".join(f"'{a}', cast(`{a}` as string)" for a in attributes))
    long = scored.select(*keys, *attributes, (F.col(y) - F.col(p)).alias("_e")).selectExpr(
        *[f"`{k}`" for k in keys], stack, "_e")
    g = long.groupBy(*keys, "attribute", "grp").agg(
        F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.count(F.lit(1)).alias("n"))
    return g.select(*keys, "attribute", F.col("grp").alias("group_value"),
                    r6("mae").alias("mae"), r6("rmse").alias("rmse"), "n")


def fairness_scores(groups: DataFrame, keys=("model",)) -> DataFrame:
    """Per attribute: max/min ratios of group MAE and RMSE (inf when a group
    has zero error) and fairness score 1/max(ratio)."""
    keys = list(keys)
    g = groups.groupBy(*keys, "attribute").agg(
        F.max("mae").alias("_mx1"), F.min("mae").alias("_mn1"),
        F.max("rmse").alias("_mx2"), F.min("rmse").alias("_mn2"), F.count(F.lit(1)).alias("n_groups"))
    mae_ratio = F.when(F.col("_mn1") > 0, F.col("_mx1") / F.col("_mn1")).otherwise(F.lit(INF))
    rmse_ratio = F.when(F.col("_mn2") > 0, F.col("_mx2") / F.col("_mn2")).otherwise(F.lit(INF))
    return g.select(*keys, "attribute", "n_groups", r6(mae_ratio).alias("mae_ratio"),
                    r6(rmse_ratio).alias("rmse_ratio"),
                    r6(F.lit(1.0) / F.greatest(mae_ratio, rmse_ratio)).alias("fairness_score"))


# --------------------------------------------------------------------------
# H9 / H10 alerts
# --------------------------------------------------------------------------

def alert_level(pctl) -> "F.Column":
    return (F.when(pctl <= 80, "Information").when(pctl <= 90, "Warning").otherwise("Critical"))


def alert_thresholds(scored: DataFrame, target: str, percentiles=(75, 85, 95), keys=("model",),
                     p: str = "y_pred") -> DataFrame:
    """One row per (group, percentile): threshold, level, expected frequency,
    colour, response time and description."""
    keys = list(keys)
    fr = [x / 100.0 for x in percentiles]
    g = group_stats(scored, keys, percentile_of(p, fr).alias("_t"))
    pcts = F.array(*[F.lit(int(x)) for x in percentiles])
    ex = g.select(*keys, F.posexplode(F.arrays_zip(pcts.alias("pc"), F.col("_t").alias("t"))).alias("pos", "z"))
    pc, t = F.col("z.pc"), thr(F.col("z.t"))
    level = alert_level(pc)
    return ex.select(
        *keys, pc.alias("percentile"), level.alias("alert_level"), r6(t).alias("threshold"),
        r6((100 - pc) / 100.0).alias("expected_frequency"),
        F.when(pc <= 80, "blue").when(pc <= 90, "orange").otherwise("red").alias("color"),
        F.when(level == "Critical", "5 minutes").otherwise("30 minutes").alias("response_time"),
        F.concat(level, F.lit(f" alert when {target} exceeds "), fmt_num(t, 1)).alias("description"),
    )


def alert_assign(scored: DataFrame, percentiles=(75, 85, 95), keys=("model",), id_col: str = "id",
                 p: str = "y_pred") -> DataFrame:
    """Level of each row: the highest threshold its prediction exceeds."""
    keys = list(keys)
    lo, mid, hi = sorted(percentiles)
    stats = group_stats(scored, keys, percentile_of(p, [lo / 100, mid / 100, hi / 100]).alias("_t")).select(
        *keys, thr(F.col("_t")[0]).alias("_t1"), thr(F.col("_t")[1]).alias("_t2"), thr(F.col("_t")[2]).alias("_t3"))
    j = attach_stats(scored.select(*keys, id_col, p), stats, keys)
    pv = F.col(p)
    lvl = (F.when(pv > F.col("_t3"), alert_level(F.lit(hi))).when(pv > F.col("_t2"), alert_level(F.lit(mid)))
           .when(pv > F.col("_t1"), alert_level(F.lit(lo))).otherwise("None"))
    return j.select(*keys, id_col, r6(pv).alias(p), lvl.alias("alert_level"))


# --------------------------------------------------------------------------
# H11-H21 dashboard analytics
# --------------------------------------------------------------------------

def confidence_bands(scored: DataFrame, keys=("model",), y="y_true", p="y_pred") -> DataFrame:
    """±1.28σ and ±1.96σ (σ = population std of residuals) and the share of
    rows whose residual falls inside each band."""
    keys = list(keys)
    base = scored.select(*keys, (F.col(y) - F.col(p)).alias("_e"))
    st = group_stats(base, keys, std0("_e").alias("_sd")).select(
        *keys, thr(F.col("_sd") * 1.28).alias("_c80"), thr(F.col("_sd") * 1.96).alias("_c95"))
    j = attach_stats(base, st, keys)
    ae = F.abs("_e")
    out = group_stats(j, keys, F.first("_c80").alias("_c80"), F.first("_c95").alias("_c95"),
                      share(ae <= F.col("_c80")).alias("within_80"), share(ae <= F.col("_c95")).alias("within_95"))
    return out.select(*keys, r6("_c80").alias("band_80"), r6("_c95").alias("band_95"),
                      r6("within_80").alias("within_80"), r6("within_95").alias("within_95"))


def risk_assessment(scored: DataFrame, target: str, keys=("model",), p="y_pred",
                    q: float = 0.9) -> DataFrame:
    """Rows whose prediction exceeds the group's p90: count, share, band."""
    keys = list(keys)
    st = group_stats(scored, keys, thr(percentile_of(p, q)).alias("_t"))
    j = attach_stats(scored.select(*keys, p), st, keys)
    out = group_stats(j, keys, F.first("_t").alias("_t"), count_if(F.col(p) > F.col("_t")).alias("high_risk_count"),
                      F.count(F.lit(1)).alias("n"))
    rp = F.col("high_risk_count") / F.col("n") * 100
    band = F.when(rp > 15, "High").when(rp > 5, "Moderate").otherwise("Low")
    if not _is_timed(target):
        band = F.lit(None).cast("string")
    return out.select(*keys, r6("_t").alias("risk_threshold"), "high_risk_count", "n",
                      r6(rp).alias("risk_percentage"), band.alias("risk_band"))


def improvement_potential(scored: DataFrame, keys=("model",), p="y_pred") -> DataFrame:
    """max(0, (mean − p25) / mean · 100) of the predictions."""
    keys = list(keys)
    g = group_stats(scored, keys, F.avg(p).alias("_m"), thr(percentile_of(p, 0.25)).alias("_q1"))
    pot = F.greatest(F.lit(0.0), F.try_divide(F.col("_m") - F.col("_q1"), F.col("_m")) * 100)
    return g.select(*keys, r6("_m").alias("mean_pred"), r6("_q1").alias("p25"), r6(pot).alias("improvement_pct"))


def performance_quartiles(scored: DataFrame, target: str, keys=("model",), p="y_pred") -> DataFrame:
    """Quartiles of the predictions with the variability / over-target flags."""
    keys = list(keys)
    g = group_stats(scored, keys, percentile_of(p, [0.25, 0.5, 0.75]).alias("_q"), F.avg(p).alias("_m"))
    q1, q2, q3 = (thr(F.col("_q")[i]) for i in range(3))
    timed = _is_timed(target)
    hv = (q3 - q1 > q2) if timed else F.lit(None).cast("boolean")
    ot = (q2 > F.col("_m") * 1.2) if timed else F.lit(None).cast("boolean")
    return g.select(*keys, r6(q1).alias("q25"), r6(q2).alias("q50"), r6(q3).alias("q75"),
                    hv.alias("high_variability"), ot.alias("over_target"))


def high_error_cases(scored: DataFrame, keys=("model",), y="y_true", p="y_pred") -> DataFrame:
    """Share of rows with |e| above the group's p90 of |e| (strict)."""
    keys = list(keys)
    base = scored.select(*keys, F.abs(F.col(y) - F.col(p)).alias("_ae"))
    st = group_stats(base, keys, thr(percentile_of("_ae", 0.9)).alias("_t"))
    j = attach_stats(base, st, keys)
    out = group_stats(j, keys, F.first("_t").alias("_t"), count_if(F.col("_ae") > F.col("_t")).alias("n_high"),
                      F.count(F.lit(1)).alias("n"))
    sh = F.col("n_high") / F.col("n")
    return out.select(*keys, r6("_t").alias("error_p90"), "n_high", "n", r6(sh).alias("high_error_share"),
                      (sh > 0.1).alias("flagged"))


def wait_guideline(scored: DataFrame, keys=("model",), p="y_pred") -> DataFrame:
    """Average predicted wait against the 30 / 60 minute guideline."""
    keys = list(keys)
    g = group_stats(scored, keys, F.avg(p).alias("_m"))
    band = F.when(F.col("_m") > 60, "Critical").when(F.col("_m") > 30, "Elevated").otherwise("Acceptable")
    return g.select(*keys, r6("_m").alias("avg_predicted_wait"), band.alias("guideline_band"))


def kpi_overview(scored: DataFrame, dataset: DataFrame, target_col: str, keys=("model",),
                 y="y_true", p="y_pred") -> DataFrame:
    """KPI row: R²·100, RMSE, RMSE as % of the target's std (ddof 1, over the
    whole dataset), mean prediction, and the dataset's data quality."""
    keys = list(keys)
    cols = dataset.columns
    ncells = F.lit(float(len(cols))) * F.count(F.lit(1))
    nulls = sum(F.sum(F.col(c).isNull().cast("bigint")) for c in cols)
    ds = dataset.agg(std1(target_col).alias("_tsd"), (F.lit(1.0) - nulls / ncells).alias("_dq"))
    e = F.col(y) - F.col(p)
    g = group_stats(scored, keys, F.avg(e * e).alias("_mse"), F.var_pop(y).alias("_vy"), F.avg(p).alias("_mp"))
    g = with_scalars(g, ds)
    rmse = F.sqrt("_mse")
    r2 = F.lit(1.0) - F.try_divide(F.col("_mse"), F.col("_vy"))
    return g.select(*keys, r6(r2 * 100).alias("accuracy_pct"), r6(rmse).alias("rmse"),
                    r6(F.try_divide(rmse, F.col("_tsd")) * 100).alias("relative_error_pct"),
                    r6("_mp").alias("avg_prediction"), r6(F.col("_dq") * 100).alias("data_quality_pct"))


def bottlenecks(dataset: DataFrame, target_col: str, numeric_cols, top: int = 8) -> DataFrame:
    """Per numeric column: corr with the target, std₁/mean, |corr|·ratio;
    ranked, top ``top`` kept, `significant` marks the first five above 0.1."""
    cols = [c for c in numeric_cols if c != target_col]
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [corr(x, target_col).alias(f"{c}__r"),
                 std1(x).alias(f"{c}__s"), F.avg(x).alias(f"{c}__m")]
    wide = dataset.agg(*aggs)
    stack = "stack({}, {}) as (factor, correlation, sd, mean)".format(
        len(cols), ", ".join(f"'{c}', `{c}__r`, `{c}__s`, `{c}__m`" for c in cols))
    long = wide.selectExpr(stack)
    var = F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")).otherwise(F.lit(0.0))
    score = F.round(F.abs("correlation") * var, 9)
    long = long.select("factor", "correlation", var.alias("variability"), score.alias("score"))
    rk = F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "factor"))
    ranked = long.withColumn("rank", rk).filter(F.col("rank") <= top)
    return ranked.select("rank", "factor", r6("correlation").alias("correlation"),
                         r6("variability").alias("variability"), r6("score").alias("bottleneck_score"),
                         ((F.col("rank") <= 5) & (F.col("score") > 0.1)).alias("significant"))


def what_if(importance: DataFrame, dataset: DataFrame, features, keys=("model",), top: int = 3) -> DataFrame:
    """Top features per model: current mean, value after a 10 % improvement
    (×1.1 for ratios, ×0.9 otherwise) and impact = importance·0.1."""
    keys = list(keys)
    wide = dataset.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    stack = "stack({}, {}) as (feature, current_value)".format(
        len(features), ", ".join(f"'{f}', `{f}`" for f in features))
    means = wide.selectExpr(stack)
    rk = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "feature"))
    t = importance.withColumn("rank", rk).filter(F.col("rank") <= top)
    j = t.join(means, "feature", "inner")
    cur = F.col("current_value")
    improved = F.when(F.lower("feature").contains("ratio"), cur * 1.1).otherwise(cur * 0.9)
    return j.select(*keys, "rank", "feature", r6(cur).alias("current_value"), r6(improved).alias("improved_value"),
                    r6(F.col("score") * 0.1).alias("potential_impact"))


def dashboard_summary(metrics: DataFrame, keys=("model",), training_time=None) -> DataFrame:
    """Gauge inputs from a :func:`care_metrics` frame: the six ratios ×100
    and a processing score max(0, 100 − t) when a training time is given."""
    keys = list(keys)
    cols = ["r2", "clinical_accuracy", "critical_detection_rate", "resource_accuracy",
            "efficiency_impact", "consistency_score"]
    out = metrics.select(*keys, *[r6(F.col(c) * 100).alias(f"{c}_gauge") for c in cols])
    if training_time is not None:
        out = out.withColumn("processing_score", r6(F.greatest(F.lit(0.0), 100 - F.col(training_time))))
    return out
