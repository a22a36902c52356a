"""Model evaluation over scored tables.

A scored table holds one row per (id, model) with ``y_true``/``y_pred`` and a
``split`` column. All scores are conditional aggregates in one pass per
grouping; folds and re-splits are md5 hashes of the id, so they are
reproducible, need no global sort or row numbering, and match DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstats.functions.stats import r6, std0


def hash_bucket(key: Column, buckets: int) -> Column:
    """``int(md5(key)[:8], 16) % buckets`` (same formula in DuckDB)."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets


def split_assign(df: DataFrame, id_col: str, test_percent: int = 20, salt: str = "",
                 name: str = "split") -> DataFrame:
    """G1: reproducible train/test column from the hash of the id."""
    key = F.col(id_col).cast("string")
    if salt:
        key = F.concat(F.lit(salt), key)
    return df.withColumn(name, F.when(hash_bucket(key, 100) < test_percent, "test").otherwise("train"))


def fold_col(id_col: str, k: int = 5, salt: str = "fold") -> Column:
    """K-fold assignment by hash of the id."""
    return hash_bucket(F.concat(F.lit(salt), F.col(id_col).cast("string")), k).cast("int")


def _r2(mse: Column, var_y: Column) -> Column:
    return F.lit(1.0) - F.try_divide(mse, var_y)


def regression_scores(scored: DataFrame, keys=("dataset", "model"), split: str = "split",
                      y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """MSE, RMSE, R², MAE per (keys, split)."""
    keys = list(keys)
    e = F.col(y) - F.col(p)
    g = scored.groupBy(*keys, split).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("_mse"),
                                          F.avg(F.abs(e)).alias("_mae"), F.var_pop(y).alias("_vy"))
    return g.select(*keys, split, "n", r6("_mse").alias("mse"), r6(F.sqrt("_mse")).alias("rmse"),
                    r6(_r2(F.col("_mse"), F.col("_vy"))).alias("r2"), r6("_mae").alias("mae"))


def cv_fold_scores(scored: DataFrame, k: int = 5, keys=("dataset", "model"), id_col: str = "id",
                   split: str | None = "split", y: str = "y_true", p: str = "y_pred",
                   rounded: bool = True) -> DataFrame:
    """R² per fold on the training rows, long (keys, fold, r2)."""
    keys = list(keys)
    d = scored.filter(F.col(split) == "train") if split else scored
    e = F.col(y) - F.col(p)
    g = d.groupBy(*keys, fold_col(id_col, k).alias("fold")).agg(
        F.avg(e * e).alias("_mse"), F.var_pop(y).alias("_vy"))
    r2 = _r2(F.col("_mse"), F.col("_vy"))
    return g.select(*keys, "fold", (r6(r2) if rounded else r2).alias("r2"))


def cv_summary(folds: DataFrame, keys=("dataset", "model")) -> DataFrame:
    """Mean and population std (NumPy ``std``) of the fold scores."""
    keys = list(keys)
    return folds.groupBy(*keys).agg(F.avg("r2").alias("cv_score"), std0("r2").alias("cv_std"),
                                    F.count(F.lit(1)).alias("n_folds"))


def comparison(scored: DataFrame, k: int = 5, keys=("dataset", "model"), session: str = "session_1",
               target: str = "wait_min", training_time: DataFrame | None = None,
               y: str = "y_true", p: str = "y_pred", cv: DataFrame | None = None) -> DataFrame:
    """One row per (dataset, model) with test R²/RMSE/MAE, CV mean and
    std (CV clipped below at 1e-5 as in the comparison page), training time
    and overfitting = train R² − test R². Both splits are scored in one
    aggregation pass; CV is a second pass over the training rows."""
    keys = list(keys)
    e = F.col(y) - F.col(p)
    te, tr = F.col("split") == "test", F.col("split") == "train"
    g = scored.groupBy(*keys).agg(
        F.avg(F.when(te, e * e)).alias("_tmse"), F.avg(F.when(te, F.abs(e))).alias("_tmae"),
        F.var_pop(F.when(te, F.col(y))).alias("_tvy"),
        F.avg(F.when(tr, e * e)).alias("_rmse"), F.var_pop(F.when(tr, F.col(y))).alias("_rvy"))
    if cv is None:  # no refitted scores: fold scores of the given predictions
        cv = cv_summary(cv_fold_scores(scored, k, keys, y=y, p=p, rounded=False), keys)
    j = g.join(cv, keys, "left")
    if training_time is not None:
        j = j.join(training_time, keys, "left")
    else:
        j = j.withColumn("training_time", F.lit(None).cast("double"))
    test_r2 = _r2(F.col("_tmse"), F.col("_tvy"))
    train_r2 = _r2(F.col("_rmse"), F.col("_rvy"))
    return j.select(
        F.lit(session).alias("session"), *keys[:1], F.lit(target).alias("target"), *keys[1:],
        r6(test_r2).alias("test_r2"), r6(F.sqrt("_tmse")).alias("test_rmse"), r6("_tmae").alias("test_mae"),
        r6(F.greatest(F.col("cv_score"), F.lit(1e-5))).alias("cv_score"), r6("cv_std").alias("cv_std"),
        r6("training_time").alias("training_time"), r6(train_r2 - test_r2).alias("overfitting"))


def ensemble_predict(scored: DataFrame, weights: dict[str, float] | None = None, id_col: str = "id",
                     model: str = "model", carry=("dataset", "y_true"), p: str = "y_pred") -> DataFrame:
    """Σ wᵢ·predᵢ per id; equal weights over the models present when
    ``weights`` is None. Weights are a literal map, so no join is needed, and
    the rows of one id are combined map-side before the shuffle."""
    if weights:
        wmap = F.create_map(*[x for kv in weights.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))])
        w = F.element_at(wmap, F.col(model))
        s = scored.filter(F.col(model).isin(list(weights)))
        agg = F.sum(w * F.col(p))
    else:
        s = scored
        agg = F.avg(p)
    return s.groupBy(id_col).agg(*[F.any_value(c).alias(c) for c in carry], agg.alias("_e")).select(
        id_col, *carry, r6("_e").alias("ensemble_pred"))


def stability_summary(scored: DataFrame, n_runs: int = 5, keys=("model",), id_col: str = "id",
                      test_percent: int = 20, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Re-split ``n_runs`` times (hash of run and id), score each run's
    test rows, then mean/std (ddof 0) of R² and RMSE and consistency
    1 − std/mean of R². Each row is emitted only for the runs where it is a
    test row, so the data is not copied ``n_runs`` times."""
    keys = list(keys)
    idc = F.col(id_col).cast("string")
    runs = F.filter(F.sequence(F.lit(0), F.lit(n_runs - 1)),
                    lambda r: hash_bucket(F.concat(r.cast("string"), F.lit(":"), idc), 100) < test_percent)
    x = scored.select(*keys, y, p, F.explode(runs).alias("run"))
    e = F.col(y) - F.col(p)
    per = x.groupBy(*keys, "run").agg(F.avg(e * e).alias("_mse"), F.var_pop(y).alias("_vy"))
    per = per.select(*keys, "run", _r2(F.col("_mse"), F.col("_vy")).alias("r2"), F.sqrt("_mse").alias("rmse"))
    s = per.groupBy(*keys).agg(F.avg("r2").alias("r2_mean"), std0("r2").alias("r2_std"),
                               F.avg("rmse").alias("rmse_mean"), std0("rmse").alias("rmse_std"),
                               F.count(F.lit(1)).alias("n_runs"))
    return s.select(*keys, "n_runs", r6("r2_mean").alias("r2_mean"), r6("r2_std").alias("r2_std"),
                    r6("rmse_mean").alias("rmse_mean"), r6("rmse_std").alias("rmse_std"),
                    r6(F.lit(1.0) - F.try_divide(F.col("r2_std"), F.col("r2_mean"))).alias("consistency_score"))


def best_models(cmp: DataFrame, by=("dataset",)) -> DataFrame:
    """Best model by test R² and by lowest RMSE (= lowest MSE)."""
    by = list(by)
    g = cmp.groupBy(*by) if by else cmp.groupBy()
    key_r2 = F.struct(F.col("test_r2"), F.col("model"))
    key_rmse = F.struct(F.col("test_rmse"), F.col("model"))
    out = g.agg(F.max(key_r2).alias("_b"), F.min(key_rmse).alias("_l"), F.count(F.lit(1)).alias("n_models"))
    return out.select(*by, F.col("_b.model").alias("best_r2_model"), F.col("_b.test_r2").alias("best_r2"),
                      F.col("_l.model").alias("lowest_rmse_model"), F.col("_l.test_rmse").alias("lowest_rmse"),
                      "n_models")
