"""Cost and ROI tables over predictions.

Per-group percentiles are computed once and attached with a size-checked
join; scenario tables are generated from the one-row-per-group aggregate with
``explode`` over a literal array, never by joining or copying the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstats.functions.joins import with_scalars
from wardstats.functions.percentiles import percentile_of
from wardstats.functions.stats import count_if, r6, std0, thr
from wardstats.operators.caremetrics import _is_timed, _is_wait, attach_stats, group_stats

# The improvement scenarios (percent) used by the reference.
SCENARIOS = (5, 10, 15, 20)


def default_cost_parameters(target: str) -> tuple[float, int]:
    """(cost per unit, annual multiplier of the case count)."""
    return (2.5, 52) if _is_wait(target) else (100.0, 12)


def cost_baseline(scored: DataFrame, target: str, keys=("model",), p: str = "y_pred",
                  cost_per_unit: float | None = None, annual_factor: int | None = None) -> DataFrame:
    """Baseline cost per case and per year, high-cost cases above
    p80, and the cost drivers (variability std₀/mean, share above p95)."""
    keys = list(keys)
    unit, factor = default_cost_parameters(target)
    unit = cost_per_unit if cost_per_unit is not None else unit
    factor = annual_factor if annual_factor is not None else factor
    st = group_stats(scored, keys, percentile_of(p, [0.8, 0.95]).alias("_q")).select(
        *keys, thr(F.col("_q")[0]).alias("_p80"), thr(F.col("_q")[1]).alias("_p95"))
    j = attach_stats(scored.select(*keys, p), st, keys)
    pv = F.col(p)
    g = group_stats(j, keys, F.count(F.lit(1)).alias("n"), F.avg(p).alias("_m"), std0(p).alias("_sd"),
                    count_if(pv > F.col("_p80")).alias("high_cost_cases"),
                    F.sum(F.when(pv > F.col("_p80"), pv)).alias("_hs"),
                    count_if(pv > F.col("_p95")).alias("_n95"))
    base = F.col("_m") * unit
    return g.select(*keys, "n", r6(base).alias("baseline_cost_per_case"),
                    r6(base * (F.col("n") * factor)).alias("annual_baseline_cost"),
                    "high_cost_cases", r6(F.coalesce(F.col("_hs"), F.lit(0.0)) * unit).alias("high_cost_total"),
                    r6(F.try_divide(F.col("_sd"), F.col("_m"))).alias("high_variability"),
                    r6(F.col("_n95") / F.col("n")).alias("outlier_impact"))


def cost_scenarios(scored: DataFrame, target: str, keys=("model",), p: str = "y_pred",
                   cost_per_unit: float | None = None, annual_factor: int | None = None) -> DataFrame:
    """Savings, per-case reduction, simplified ROI (2·pct) and payback
    (max(1, 12/(pct/5))) for each improvement scenario."""
    keys = list(keys)
    unit, factor = default_cost_parameters(target)
    unit = cost_per_unit if cost_per_unit is not None else unit
    factor = annual_factor if annual_factor is not None else factor
    g = group_stats(scored, keys, F.count(F.lit(1)).alias("n"), F.avg(p).alias("_m"))
    x = g.select(*keys, "n", "_m", F.explode(F.array(*[F.lit(s) for s in SCENARIOS])).alias("improvement_pct"))
    vol = F.col("n") * factor
    base = F.col("_m") * unit
    improved = F.col("_m") * (1 - F.col("improvement_pct") / 100.0) * unit
    return x.select(*keys, "improvement_pct",
                    r6(base * vol - improved * vol).alias("annual_savings"),
                    r6(base - improved).alias("cost_per_case_reduction"),
                    (F.col("improvement_pct") * 2).alias("roi_percentage"),
                    r6(F.greatest(F.lit(1.0), 12 / (F.col("improvement_pct") / 5.0))).alias("payback_period_months"))


def cost_dashboard(scored: DataFrame, dataset: DataFrame, target: str, keys=("model",), p: str = "y_pred",
                   cost_per_unit: float | None = None) -> DataFrame:
    """Dashboard cost: cases per year = dataset rows × 12, high-cost
    cases above the p90 of the predictions."""
    keys = list(keys)
    unit = cost_per_unit if cost_per_unit is not None else (2.5 if _is_timed(target) else 100.0)
    st = group_stats(scored, keys, thr(percentile_of(p, 0.9)).alias("_p90"))
    j = attach_stats(scored.select(*keys, p), st, keys)
    pv = F.col(p)
    g = group_stats(j, keys, F.count(F.lit(1)).alias("n"), F.avg(p).alias("_m"),
                    count_if(pv > F.col("_p90")).alias("high_cost_cases"),
                    F.sum(F.when(pv > F.col("_p90"), pv)).alias("_hs"))
    g = with_scalars(g, dataset.agg((F.count(F.lit(1)) * 12).alias("annual_cases")))
    base = F.col("_m") * unit
    return g.select(*keys, "annual_cases", r6(base).alias("avg_cost_per_case"),
                    r6(base * F.col("annual_cases")).alias("annual_cost"), "high_cost_cases",
                    r6(F.col("high_cost_cases") / F.col("n") * 100).alias("high_cost_pct"),
                    r6(F.coalesce(F.col("_hs"), F.lit(0.0)) * unit).alias("high_cost_impact"))


def roi_scenarios(dashboard: DataFrame, keys=("model",), improvement_cost: float = 50000.0) -> DataFrame:
    """ROI of each scenario against a one-off implementation cost;
    payback in months capped at 60."""
    keys = list(keys)
    x = dashboard.select(*keys, "annual_cases", "avg_cost_per_case",
                         F.explode(F.array(*[F.lit(s) for s in SCENARIOS])).alias("improvement_pct"))
    cur = F.col("avg_cost_per_case")
    saving = (cur - cur * (1 - F.col("improvement_pct") / 100.0)) * F.col("annual_cases")
    cost = F.lit(float(improvement_cost))
    roi = (saving - cost) / cost * 100 if improvement_cost > 0 else F.lit(0.0)
    payback = F.when(saving > 0, cost / (saving / 12)).otherwise(F.lit(float("inf")))
    return x.select(*keys, "improvement_pct", r6(saving).alias("annual_savings"), r6(roi).alias("roi"),
                    r6(F.least(payback, F.lit(60.0))).alias("payback_months"))


def cost_by_feature(importance: DataFrame, dashboard: DataFrame, keys=("model",), top: int = 5) -> DataFrame:
    """Importance share × annual cost for the top features of a model."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    rk = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "feature"))
    share = F.col("score") / F.sum("score").over(w)
    t = importance.select(*keys, "feature", share.alias("_share"), rk.alias("rank")).filter(F.col("rank") <= top)
    j = t.join(dashboard.select(*keys, "annual_cost"), keys, "inner")
    return j.select(*keys, "rank", F.col("feature").alias("factor"),
                    r6(F.col("_share") * F.col("annual_cost")).alias("cost_impact"),
                    r6(F.col("_share") * 100).alias("percentage"))


def priority_matrix(drivers: DataFrame, keys=("model",)) -> DataFrame:
    """I8: feasibility .8 for staff/process factors, else .6; priority score
    max(1, cost_impact/1000 · feasibility)."""
    keys = list(keys)
    low = F.lower("factor")
    feas = F.when(low.contains("staff") | low.contains("process"), F.lit(0.8)).otherwise(F.lit(0.6))
    return drivers.select(*keys, "factor", "cost_impact", feas.alias("feasibility"),
                          r6(F.greatest(F.lit(1.0), F.col("cost_impact") / 1000 * feas)).alias("priority_score"))


def cost_benefit(roi: DataFrame, keys=("model",), improvement_cost: float = 50000.0) -> DataFrame:
    """Long (scenario, kind, value) rows of cost vs benefit per scenario."""
    keys = list(keys)
    scen = F.concat(F.col("improvement_pct").cast("string"), F.lit("%"))
    return roi.select(*keys, scen.alias("scenario"),
                      F.inline(F.array(F.struct(F.lit("cost").alias("kind"), F.lit(float(improvement_cost)).alias("value")),
                                       F.struct(F.lit("benefit").alias("kind"), F.col("annual_savings").alias("value")))))
