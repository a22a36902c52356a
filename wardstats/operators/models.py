"""Model training, tuning and scoring on Spark ML.

Features are assembled once into a vector column and the training frame is
persisted (memory and disk, so a lost executor's blocks are recomputed or
re-read, never lost); every estimator is a distributed Spark ML fit. Scaling
uses the population std (NumPy / sklearn convention) through SQL
expressions, because Spark ML's ``StandardScaler`` divides by the sample
std. Outputs are plain DataFrames: a long scored table
(id, model, split, y_true, y_pred), an importance table and a metrics table.
"""

from __future__ import annotations

import itertools
import math
import time
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   LinearRegressionModel, RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstats.functions.session import ensure_checkpoint_dir, jit_sized_methods
from wardstats.functions.stats import r6, std0
from wardstats.operators.evaluate import fold_col, hash_bucket
from wardstats.operators.outliers import fence_flag, removal_fences
from wardstats.operators.trees import cross_validated_r2
from wardstats.sources.files import stored_rows

# Model names and hyper-parameters of the reference models.
RANDOM_FOREST = "Random Forest"
BOOSTING = "Gradient Boosting"
LINEAR = "Linear Regression"
KERNEL = "Support Vector Regression"
#: Memory of node statistics that a forest of shallow trees fills in one pass.
NODE_STATISTICS_MB = 8


@dataclass(frozen=True)
class TrainOptions:
    """Training switches (the reference's option dict)."""
    scale_features: bool = True
    handle_outliers: bool = False
    cv_folds: int = 5
    random_state: int = 42
    enable_tuning: bool = False
    parallelism: int = 4
    rff_components: int = 64


def estimator(name: str, features: str = "features", label: str = "label", seed: int = 42, **kw):
    """Spark ML estimator configured like the reference model ``name``."""
    if name == RANDOM_FOREST:
        # min_samples_split has no Spark counterpart; min leaf size maps to minInstancesPerNode
        p = dict(numTrees=100, maxDepth=10, minInstancesPerNode=2, featureSubsetStrategy="all")
        p.update(kw)
        if p["maxDepth"] <= 10:  # statistics of fewer nodes at a time stay in a core's cache; the trees are the same
            p.setdefault("maxMemoryInMB", NODE_STATISTICS_MB)
        return RandomForestRegressor(featuresCol=features, labelCol=label, seed=seed, **p)
    if name == BOOSTING:
        p = dict(maxIter=100, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                 checkpointInterval=10)
        p.update(kw)
        return GBTRegressor(featuresCol=features, labelCol=label, seed=seed, **p)
    if name == LINEAR:
        p = dict(regParam=0.0, solver="normal")
        p.update(kw)
        return LinearRegression(featuresCol=features, labelCol=label, **p)
    if name == KERNEL:
        raise ValueError("the kernel model is fitted by insensitive_fit on random Fourier features")
    if name == "Decision Tree":
        p = dict(maxDepth=10)
        p.update(kw)
        return DecisionTreeRegressor(featuresCol=features, labelCol=label, seed=seed, **p)
    if name == "Decision Tree Classifier":
        p = dict(maxDepth=10)
        p.update(kw)
        return DecisionTreeClassifier(featuresCol=features, labelCol=label, seed=seed, **p)
    raise ValueError(f"unknown model {name}")


# The reference's tuning grids (None depth mapped to 30, the
# deepest tree Spark ML grows).
REFERENCE_GRIDS = {
    RANDOM_FOREST: {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15, 30],
                    "minInstancesPerNode": [1, 2, 4]},
    BOOSTING: {"maxIter": [50, 100, 200], "maxDepth": [3, 6, 9], "stepSize": [0.01, 0.1, 0.2],
               "subsamplingRate": [0.8, 0.9, 1.0]},
    LINEAR: {},
}


# ---------------------------------------------------------------- features

def scale_columns(df: DataFrame, cols, fit_df: DataFrame) -> DataFrame:
    """(x − mean)/std₀ with training statistics, as scalar subqueries."""
    from wardstats.functions.joins import with_scalars

    st = fit_df.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), std0(c).alias(f"_s_{c}"))])
    j = with_scalars(df, st)
    new = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
           for c in cols}
    return j.withColumns(new).drop(*st.columns)


def random_draws(src: DataFrame, cols, n_components: int, seed: int, gamma: float | str = "scale") -> tuple[list, list, float]:
    """Weights, shifts and scale of the random features (see
    :func:`rff_columns`); gamma 'scale' comes from the moments of ``src``,
    'auto' is 1 / number of features."""
    import random

    # Var(X) over all feature values, from per-column first and second
    # moments of one aggregate (one small row on the driver)
    mom = src.agg(*[F.avg(F.col(c) * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)],
                  *[F.avg(F.col(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    n = len(cols)
    ex2 = sum((mom[f"s{i}"] or 0.0) for i in range(n)) / n
    ex = sum((mom[f"m{i}"] or 0.0) for i in range(n)) / n
    if gamma == "scale":
        gamma = 1.0 / (n * max(ex2 - ex * ex, 1e-12))
    elif gamma == "auto":
        gamma = 1.0 / n
    rng = random.Random(seed)
    weights, shifts = [], []
    for _ in range(n_components):
        weights.append([rng.gauss(0.0, math.sqrt(2 * gamma)) for _ in cols])
        shifts.append(rng.uniform(0, 2 * math.pi))
    return weights, shifts, math.sqrt(2.0 / n_components)


def rff_columns(df: DataFrame, cols, n_components: int = 64, seed: int = 42, fit_df: DataFrame | None = None, gamma: float | str = "scale"):
    """Random Fourier features for an RBF kernel (Rahimi & Recht, 2007):
    z_k(x) = sqrt(2/D)·cos(w_k·x + b_k), w ~ N(0, 2γ), b ~ U(0, 2π), with
    γ = 1/(n_features·Var(X)) (sklearn's 'scale'). The random draws are
    literals of the plan, so every task computes the same features."""
    return _waves(df, cols, *random_draws(fit_df if fit_df is not None else df, cols, n_components, seed, gamma))


def _waves(df: DataFrame, cols, weights: list, shifts: list, scale: float):
    exprs = []
    for k, (ws, shift) in enumerate(zip(weights, shifts)):
        dot = sum((F.col(c) * F.lit(wi) for c, wi in zip(cols, ws)), F.lit(shift))
        exprs.append((F.lit(scale) * F.cos(dot)).alias(f"_rff{k}"))
    return df.select("*", *exprs), [f"_rff{k}" for k in range(len(weights))]


def mean_filled(df: DataFrame, cols, fit_df: DataFrame) -> DataFrame:
    """NULL and NaN features as the training mean (0 without any value):
    linear and kernel fits take no gaps."""
    from wardstats.functions.joins import with_scalars

    seen = {c: F.when(~F.isnan(c), F.col(c)) for c in cols}
    j = with_scalars(df, fit_df.agg(*[F.avg(x).alias(f"_a_{c}") for c, x in seen.items()]))
    return j.withColumns({c: F.coalesce(x, F.col(f"_a_{c}"), F.lit(0.0)) for c, x in seen.items()}).drop(*[f"_a_{c}" for c in cols])


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


# ---------------------------------------------------------------- epsilon-insensitive fit

def insensitive_fit(rows: DataFrame, c: float = 1.0, epsilon: float = 0.1, features: str = "features", label: str = "label",
                    max_iter: int = 15, tol: float = 1e-3) -> LinearRegressionModel:
    """The linear model of ½|w|² + C · sum of max(0, |y - w·x - b| - epsilon)
    (support vector regression) by weighted least squares. With the residual r
    the loss is ½(|r - epsilon| + |r + epsilon|) - epsilon; each absolute value
    lies under the parabola that touches it at the last residual, so a ridge
    fit with row weights C/2 · (1/|r - epsilon| + 1/|r + epsilon|) never raises
    the loss. A step is two aggregates over the rows (loss and the weighted
    label's spread; the Gram matrix); it stops when the loss falls by less than
    ``tol`` of itself, or after ``max_iter`` steps."""
    y = F.col(label)
    first = rows.agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
    if not first["n"]:
        raise ValueError("no labelled rows")
    floor = max(1e-4 * (first["s"] or 0.0), 1e-9)
    model, last = None, math.inf
    best = None
    for step in range(max_iter + 1):
        if model is None:
            at, norm = rows.withColumn("_f", F.lit(float(first["m"]))), 0.0
        else:
            at, norm = model.setPredictionCol("_f").transform(rows), float(sum(v * v for v in model.coefficients.toArray()))
        r = y - F.col("_f")
        low, high = (F.lit(1.0) / F.greatest(F.abs(r + F.lit(e)), F.lit(floor)) for e in (-float(epsilon), float(epsilon)))
        at = at.select(features, (y - F.lit(float(epsilon)) * (low - high) / (low + high)).alias("_y"),
                       (F.lit(c / 2) * (low + high)).alias("_w"), F.greatest(F.lit(0.0), F.abs(r) - F.lit(float(epsilon))).alias("_l"))
        moved = F.col("_y") - F.lit(float(first["m"]))
        sums = at.agg(F.sum("_w").alias("w"), F.sum("_l").alias("l"), F.sum(F.col("_w") * moved).alias("y"), F.sum(F.col("_w") * moved * moved).alias("yy")).first()
        loss = 0.5 * norm + c * sums["l"]
        if best is None or loss < best[0]:
            best = (loss, model)
        if step == max_iter or last - loss <= tol * max(abs(loss), 1e-12):
            if model is not None:
                break
        last = loss
        # Spark divides the penalty by the weighted label's spread: give it times that
        spread = math.sqrt(max(sums["yy"] / sums["w"] - (sums["y"] / sums["w"]) ** 2, 0.0))
        model = LinearRegression(featuresCol=features, labelCol="_y", weightCol="_w", solver="normal", standardization=False,
                                 elasticNetParam=0.0, regParam=(spread or 1.0) / sums["w"]).fit(at)
    return (best[1] or model).setPredictionCol("prediction")


# ---------------------------------------------------------------- train / predict

def _insensitive(params: dict) -> dict:
    """Keyword arguments of :func:`insensitive_fit` from the kernel model's
    parameters (C, epsilon, and its own max_iter and tol)."""
    return {("c" if k == "C" else k): v for k, v in params.items()}


@dataclass
class Trained:
    name: str
    model: PipelineModel | object
    features: list
    seconds: float


def fit_predict(df: DataFrame, features, target: str, name: str, id_col: str = "id", split: str = "split",
                options: TrainOptions = TrainOptions(), scored_split: str | None = None, **params) -> tuple[DataFrame, Trained]:
    """Fit model ``name`` on the training rows and score every row, or those
    of ``scored_split``.
    ``handle_outliers`` first takes training rows outside the features' fences
    away, if they are fewer than a tenth (they are not scored either). Returns the long scored rows (id, model, split, y_true, y_pred)."""
    ensure_checkpoint_dir(df.sparkSession)
    feats = list(features)
    data = df.select(id_col, split, F.col(target).cast("double").alias("label"),
                     *[F.col(c).cast("double").alias(c) for c in feats]).dropna(subset=["label"])
    if options.handle_outliers:
        fences = removal_fences(data.filter(F.col(split) == "train"), feats)
        data = data.filter((F.col(split) != "train") | ~fence_flag(fences))
    train = data.filter(F.col(split) == "train")
    if name in (LINEAR, KERNEL):
        data = mean_filled(data, feats, train)
        train = data.filter(F.col(split) == "train")
    if options.scale_features and name in (LINEAR, KERNEL):
        data = scale_columns(data, feats, train)
        train = data.filter(F.col(split) == "train")
    if name == KERNEL:
        jit_sized_methods(df.sparkSession)
        weights = random_draws(train, feats, options.rff_components, options.random_state, params.pop("gamma", "scale"))
        data, feats = _waves(data, feats, *weights)
        train = data.filter(F.col(split) == "train")
    if scored_split is not None:
        data = data.filter(F.col(split) == scored_split)
    data, train = assemble(data, feats), assemble(train, feats)  # the assembler lets no filter through
    t0 = time.time()
    if name == KERNEL:
        with stored_rows(train.select("features", "label"), "kernel-rows") as rows:
            model = insensitive_fit(rows, **_insensitive(params))
    else:
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
        model = estimator(name, seed=options.random_state, **params).fit(train)
        train.unpersist()
    secs = time.time() - t0
    pred = model.transform(data)
    scored = pred.select(id_col, F.lit(name).alias("model"), split, F.col("label").alias("y_true"),
                         F.col("prediction").alias("y_pred"))
    return scored, Trained(name, model, feats, secs)


# ---------------------------------------------------------------- stored models

def fit_pipeline(train: DataFrame, features, target: str, name: str, options: TrainOptions = TrainOptions(), **params) -> PipelineModel:
    """Everything that scoring takes as one ``PipelineModel``: filling
    of gaps, scaling and the kernel's random draws as SQL steps whose fitted
    numbers are literals, then the assembled vector and the estimator. It can
    be saved, loaded in another session, and applied to batches and streams."""
    ensure_checkpoint_dir(train.sparkSession)
    feats = list(features)
    data = train.select(F.col(target).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in feats]).dropna(subset=["label"])
    if options.handle_outliers:
        data = data.filter(~fence_flag(removal_fences(data, feats)))
    x = {c: F.when(~F.isnan(c), F.col(c)) for c in feats}
    row = data.agg(*[a for c, v in x.items() for a in (F.avg(v).alias(f"m_{c}"), F.stddev_pop(F.coalesce(v, F.lit(None))).alias(f"s_{c}"), F.count(v).alias(f"n_{c}"))],
                   F.count(F.lit(1)).alias("_n")).first()
    stages: list = []
    inputs = [f"_x{i}" for i in range(len(feats))]
    plain = name not in (LINEAR, KERNEL)
    steps = []
    for i, c in enumerate(feats):
        m, s, n = row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0, row["_n"] or 1
        s = s * math.sqrt(row[f"n_{c}"] / n)  # filled rows stand at the mean
        value = f"CAST(`{c}` AS DOUBLE)"
        if not plain:
            value = f"coalesce(CASE WHEN NOT isnan({value}) THEN {value} END, {m!r}D)"
            if options.scale_features:
                value = f"({value} - {m!r}D) / {(s or 1.0)!r}D"
        steps.append(f"{value} AS _x{i}")
    stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(steps)} FROM __THIS__"))
    if name == KERNEL:
        weights, shifts, scale = random_draws(stages[0].transform(data), inputs, options.rff_components, options.random_state, params.pop("gamma", "scale"))
        waves = [f"{scale!r}D * cos({shift!r}D + " + " + ".join(f"{w!r}D * _x{i}" for i, w in enumerate(ws)) + f") AS _z{k}"
                 for k, (ws, shift) in enumerate(zip(weights, shifts))]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(waves)} FROM __THIS__"))
        inputs = [f"_z{k}" for k in range(len(waves))]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    if name == KERNEL:
        with stored_rows(PipelineModel(stages).transform(data).select("features", "label"), "kernel-rows") as rows:
            return PipelineModel([*stages, insensitive_fit(rows, **_insensitive(params))])
    return Pipeline(stages=[*stages, estimator(name, seed=options.random_state, **params)]).fit(data)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def score_rows(model: PipelineModel | str, rows: DataFrame, keep) -> DataFrame:
    """``keep`` and y_pred of new rows (batch or stream) by a fitted or saved
    model."""
    fitted = PipelineModel.load(model) if isinstance(model, str) else model
    return fitted.transform(rows).select(*keep, F.col("prediction").alias("y_pred"))


# ---------------------------------------------------------------- stability

def stability_refit(df: DataFrame, features, target: str, name: str, n_runs: int = 5, id_col: str = "id", test_percent: int = 20,
                    options: TrainOptions = TrainOptions(), **params) -> DataFrame:
    """``n_runs`` new splits (by the hash of run and id), a new fit on
    each, submitted in parallel; a row per run: model, run, r2 and rmse of its
    test rows, and seconds of the fit."""
    from concurrent.futures import ThreadPoolExecutor

    def one(run: int):
        key = F.concat(F.lit(f"{run}:"), F.col(id_col).cast("string"))
        part = df.withColumn("_split", F.when(hash_bucket(key, 100) < test_percent, "test").otherwise("train"))
        scored, trained = fit_predict(part, features, target, name, id_col, "_split", options, **params)
        e = F.col("y_true") - F.col("y_pred")
        got = scored.where(F.col("_split") == "test").agg((F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop("y_true"))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse")).first()
        return name, run, got["r2"], got["rmse"], trained.seconds

    with ThreadPoolExecutor(max_workers=max(1, min(options.parallelism, n_runs))) as pool:
        runs = list(pool.map(one, range(n_runs)))
    return df.sparkSession.createDataFrame(runs, "model string, run int, r2 double, rmse double, seconds double")


def stability_of_runs(runs: DataFrame, keys=("model",)) -> DataFrame:
    """Mean and std (ddof 0) of R², RMSE and time over the runs, and
    consistency 1 - std/mean of R²."""
    out = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), *[a for c in ("r2", "rmse", "seconds") for a in (F.avg(c).alias(f"{c}_mean"), std0(c).alias(f"{c}_std"))])
    return out.withColumn("consistency_score", F.lit(1.0) - F.try_divide(F.col("r2_std"), F.col("r2_mean")))


def feature_importance(trained: Trained, original=None) -> DataFrame | None:
    """Tree importances, or |coefficient| for linear models, as rows
    (model, feature, score). Model-sized: built from the fitted model."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    m = trained.model
    names = list(original or trained.features)
    if hasattr(m, "featureImportances"):
        vals = list(m.featureImportances.toArray())
    elif hasattr(m, "coefficients") and len(m.coefficients) == len(names):
        vals = [abs(v) for v in m.coefficients.toArray()]
    else:
        return None
    return spark.createDataFrame([(trained.name, n, float(v)) for n, v in zip(names, vals)],
                                 "model string, feature string, score double")


class TrainResult(NamedTuple):
    """What :func:`train_models` returns. ``status`` has a row per wanted
    model: dataset, model, status (ok or failed), message."""

    scored: DataFrame
    comparison: DataFrame
    importance: DataFrame
    status: DataFrame


def _held_out(train: DataFrame, fold: int, features, target: str, name: str, id_col: str, split: str, options: TrainOptions, params: dict) -> DataFrame:
    """Rows of one ``_fold``, scored by a model fitted on the other folds."""
    part = train.withColumn(split, F.when(F.col("_fold") == fold, "test").otherwise("train"))
    return fit_predict(part, features, target, name, id_col, split, options, scored_split="test", **params)[0]


def _scored_r2() -> Column:
    e = F.col("y_true") - F.col("y_pred")
    return (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop("y_true"))).alias("r2")


def refit_scores(df: DataFrame, features, target: str, name: str, folds: int = 5, id_col: str = "id",
                 split: str = "split", options: TrainOptions = TrainOptions(), **params) -> DataFrame:
    """R² of each held-out fold of the training rows, scored by a model
    that was fitted on the other folds, scaling and kernel features included
    (fold, r2)."""
    from concurrent.futures import ThreadPoolExecutor

    train = df.filter(F.col(split) == "train").withColumn("_fold", fold_col(id_col, folds))

    def one(k: int) -> DataFrame:
        return _held_out(train, k, features, target, name, id_col, split, options, params).withColumn("fold", F.lit(k))

    # a fit is a row of small jobs that leaves cores idle: folds are fitted at once
    with ThreadPoolExecutor(max_workers=max(1, min(options.parallelism, folds))) as pool:
        parts = list(pool.map(one, range(folds)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("fold").agg(_scored_r2())


def train_models(df: DataFrame, features, target: str, names=(RANDOM_FOREST, BOOSTING, LINEAR, KERNEL),
                 id_col: str = "id", split: str = "split", options: TrainOptions = TrainOptions(),
                 dataset: str = "dataset", session: str = "session_1", grids: dict | None = None) -> TrainResult:
    """Train several models and cross-validate each by refitting it per
    fold. ``enable_tuning`` first searches each model's grid (``grids`` by
    model, else the reference's) and takes its best point. The comparison rows follow the comparison page's schema, with
    measured training time. A model that fails has no scored rows; its row in
    ``status`` says why. ``ValueError`` if all fail.

    The columns that fits read are computed once and persisted while they run
    (memory and disk); the comparison is a row per model and is computed
    before they go. All fits, of every model and fold, wait in one queue."""
    from concurrent.futures import ThreadPoolExecutor, wait

    from wardstats.operators.evaluate import comparison

    spark = df.sparkSession
    rows = df.select(*dict.fromkeys([id_col, split, target, *features])).withColumn("_fold", fold_col(id_col, options.cv_folds)).persist(StorageLevel.MEMORY_AND_DISK)
    train = rows.filter(F.col(split) == "train")

    def tuned(n):
        if not options.enable_tuning:
            return {}
        from wardstats.operators.tuning import best_params

        return best_params(rows, features, target, n, (grids or {}).get(n), options.cv_folds, id_col, split, options)

    def whole(n, params):
        return fit_predict(rows, features, target, n, id_col, split, options, **params())

    def fold(n, k, params):
        return _held_out(train, k, features, target, n, id_col, split, options, params()).agg(_scored_r2()).first()["r2"]

    def result(n, jobs):
        try:
            (scored, trained), *r2 = [job.result() for job in jobs]
            r2 = [x for x in r2 if x is not None]
            mean = sum(r2) / len(r2) if r2 else None
            spread = math.sqrt(sum((x - mean) ** 2 for x in r2) / len(r2)) if r2 else None
            return n, scored, trained, (dataset, n, mean, spread, len(r2)), None
        except Exception as exc:  # noqa: BLE001 - one model's failure is a row of the result
            return n, None, None, None, f"{type(exc).__name__}: {exc}"[:500]

    try:
        rows.count()  # else every fit would wait for the same blocks
        # independent fits are submitted from several driver threads, so their
        # Spark jobs share the cluster (the reference's n_jobs=-1); those of
        # most jobs in a row start first
        order = sorted(names, key=lambda n: (BOOSTING, KERNEL).index(n) if n in (BOOSTING, KERNEL) else 2)
        most = max(1, options.parallelism)
        with ThreadPoolExecutor(max_workers=most) as search, ThreadPoolExecutor(max_workers=most * most) as pool:
            params = {n: search.submit(tuned, n) for n in order}
            wait(params.values())
            jobs = {n: [pool.submit(whole, n, params[n].result), *[pool.submit(fold, n, k, params[n].result) for k in range(options.cv_folds)]] for n in order}
            fitted = [result(n, jobs[n]) for n in names]
        status = [(dataset, n, "failed" if error else "ok", error) for n, _, _, _, error in fitted]
        done = [x for x in fitted if x[4] is None]
        if not done:
            raise ValueError("no model could be trained: " + "; ".join(f"{n}: {error}" for _, n, _, error in status))
        scored = None
        for _, part, _, _, _ in done:
            part = part.withColumn("dataset", F.lit(dataset))
            scored = part if scored is None else scored.unionByName(part)
        imps = [i for i in (feature_importance(t, features) for n, _, t, _, _ in done if n != KERNEL) if i is not None]
        imp = imps[0] if imps else spark.createDataFrame([], "model string, feature string, score double")
        for i in imps[1:]:
            imp = imp.unionByName(i)
        times = spark.createDataFrame([(dataset, n, t.seconds) for n, _, t, _, _ in done], "dataset string, model string, training_time double")
        cv = spark.createDataFrame([c for _, _, _, c, _ in done], "dataset string, model string, cv_score double, cv_std double, n_folds bigint")
        cmp = comparison(scored, options.cv_folds, session=session, target=target, training_time=times, cv=cv)
        cmp = spark.createDataFrame(cmp.collect(), cmp.schema)
    finally:
        rows.unpersist()
    return TrainResult(scored, cmp, imp, spark.createDataFrame(status, "dataset string, model string, status string, message string"))


def top_features(importance: DataFrame, k: int = 5, keys=("model",)) -> DataFrame:
    """Top-k features per model by score (ties by name)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "feature")
    return importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def linear_coefficients(trained: Trained) -> DataFrame:
    """Intercept and coefficients as rows (term, coef)."""
    from pyspark.sql import SparkSession

    m = trained.model
    rows = [("intercept", float(m.intercept))] + [(n, float(v)) for n, v in zip(trained.features,
                                                                                 m.coefficients.toArray())]
    return SparkSession.getActiveSession().createDataFrame(rows, "term string, coef double")


def grid_search(df: DataFrame, features, target: str, name: str, grid: dict, folds: int = 5,
                id_col: str = "id", split: str = "split", parallelism: int = 4, seed: int = 42) -> DataFrame:
    """Exhaustive grid search with K-fold cross-validation on the
    training rows (R² scoring, folds by hash of the id); returns one row per
    grid point with the mean CV R², and marks the best. Trees of all depths
    are the first levels of the deepest (``trees``)."""
    ensure_checkpoint_dir(df.sparkSession)
    feats = list(features)
    data = df.filter(F.col(split) == "train").select(
        F.col(target).cast("double").alias("label"), fold_col(id_col, folds).alias("fold"),
        *[F.col(c).cast("double").alias(c) for c in feats]).dropna(subset=["label"])
    if name == "Decision Tree" and set(grid) <= {"maxDepth", "minInstancesPerNode"}:
        points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
        whole = [(p.get("maxDepth", 10), p.get("minInstancesPerNode", 1)) for p in points]
        data = assemble(data, feats).select("label", "fold", vector_to_array("features").alias("values"))
        r2 = cross_validated_r2(data, sorted({d for d, _ in whole}), sorted({m for _, m in whole}), folds, seed)
        return _grid_rows(df, name, points, [np.mean(r2[p]) for p in whole], [np.std(r2[p]) for p in whole])
    data = assemble(data, feats).persist(StorageLevel.MEMORY_AND_DISK)
    est = estimator(name, seed=seed)
    b = ParamGridBuilder()
    for pname, values in grid.items():
        b = b.addGrid(est.getParam(pname), values)
    maps = b.build()
    ev = RegressionEvaluator(metricName="r2", labelCol="label")
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, foldCol="fold", numFolds=folds,
                        parallelism=parallelism, seed=seed)
    cvm = cv.fit(data)
    data.unpersist()
    return _grid_rows(df, name, [{p.name: v for p, v in pm.items()} for pm in maps], cvm.avgMetrics, cvm.stdMetrics)


def _grid_rows(df: DataFrame, name: str, points: list[dict], means, spreads) -> DataFrame:
    best = max(range(len(points)), key=lambda i: means[i])
    rows = []
    for i, p in enumerate(points):
        desc = ", ".join(f"{k}={v}" for k, v in sorted(p.items()))
        rows.append((name, i, desc or "default", float(means[i]), float(spreads[i]), i == best))
    return df.sparkSession.createDataFrame(rows, "model string, point int, params string, cv_r2 double, cv_std double, "
                                                 "best boolean")


def cv_fold_r2(df: DataFrame, features, target: str, name: str = LINEAR, folds: int = 5, id_col: str = "id",
               split: str = "split", **params) -> DataFrame:
    """Refit per fold on the other folds of the training rows and score
    R² on the held-out fold; long (model, fold, r2)."""
    feats = list(features)
    data = df.filter(F.col(split) == "train").select(
        id_col, F.col(target).cast("double").alias("label"), fold_col(id_col, folds).alias("fold"),
        *[F.col(c).cast("double").alias(c) for c in feats]).dropna(subset=["label"])
    data = assemble(data, feats).persist(StorageLevel.MEMORY_AND_DISK)
    scored = data
    for k in range(folds):
        model = estimator(name, **params).fit(data.filter(F.col("fold") != k))
        scored = model.setPredictionCol(f"_pred{k}").transform(scored)
    # every fold is scored by its own model in ONE pass over the data
    own = F.col("_pred0")
    for k in range(1, folds):
        own = F.when(F.col("fold") == k, F.col(f"_pred{k}")).otherwise(own)
    e = F.col("label") - own
    res = scored.groupBy("fold").agg((F.lit(1.0) - F.avg(e * e) / F.var_pop("label")).alias("r2")).collect()
    data.unpersist()
    rows = sorted((name, int(r["fold"]), None if r["r2"] is None else round(float(r["r2"]), 6)) for r in res)
    # one score per fold: a k-row table
    return df.sparkSession.createDataFrame(rows, "model string, fold int, r2 double")


def classification_report(pred: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Per-class precision, recall, F1, support plus accuracy,
    macro and weighted averages (sklearn layout; 0 when undefined).

    One pass over the predictions builds the confusion counts (classes²
    rows); support, true positives and predicted counts are
    class-sized aggregates of that table, joined with a full outer join."""
    conf = pred.groupBy(F.col(y).alias("t"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("c"))
    yt = conf.groupBy(F.col("t").alias("label")).agg(
        F.sum("c").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"))
    yp = conf.groupBy(F.col("p").alias("label")).agg(F.sum("c").alias("predicted"))
    j = yt.join(yp, "label", "full_outer").select(
        F.col("label").cast("string").alias("label"), F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = j.select("label", prec.alias("precision"), rec.alias("recall"), "support", "tp")
    per = per.withColumn("f1_score", F.when(F.col("precision") + F.col("recall") > 0,
                                            2 * F.col("precision") * F.col("recall") /
                                            (F.col("precision") + F.col("recall"))).otherwise(0.0))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("wf"))
    def row(label, p, r, f):
        return F.struct(F.lit(label).alias("label"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        F.col("n").cast("bigint").alias("support"))

    none = F.lit(None)
    rows = tot.select(F.inline(F.array(
        row("accuracy", none, none, F.col("tp") / F.col("n")),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")))))
    out = per.select("label", "precision", "recall", "f1_score", "support").unionByName(rows)
    return out.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"),
                      r6("f1_score").alias("f1_score"), F.col("support").cast("bigint").alias("support"))
