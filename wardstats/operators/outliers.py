"""Outlier flags and guarded removal.

The reference loops over columns and collects row indices into a set. Here
all column statistics come from ONE aggregate, become one-row scalar
subqueries, and the union over columns is an OR of predicates: one scan to
fit, one lazy filter to apply, no index set on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstats.functions.joins import with_scalars
from wardstats.functions.percentiles import grouped, percentile_of
from wardstats.functions.stats import count_if, std1
from wardstats.operators.profile import numeric_columns


def _iqr_stats(df: DataFrame, cols, threshold: float) -> DataFrame:
    aggs = [percentile_of(F.col(c).cast("double"), [0.25, 0.75]).alias(f"{c}__q") for c in cols]
    st = grouped(df, [], *aggs)
    out = []
    for c in cols:
        q1, q3 = F.col(f"{c}__q")[0], F.col(f"{c}__q")[1]
        out += [F.round(q1 - threshold * (q3 - q1), 9).alias(f"_{c}_lo"),
                F.round(q3 + threshold * (q3 - q1), 9).alias(f"_{c}_hi")]
    return st.select(*out)


def _z_stats(df: DataFrame, cols) -> DataFrame:
    return df.agg(*[x for c in cols for x in (F.avg(F.col(c).cast("double")).alias(f"_{c}_m"),
                                               std1(F.col(c).cast("double")).alias(f"_{c}_s"))])


def outlier_flag(df: DataFrame, method: str = "iqr", threshold: float = 1.5, cols=None,
                 fit_df: DataFrame | None = None, name: str = "is_outlier") -> DataFrame:
    """Boolean column, true when any numeric column is outside
    [Q1 − t·IQR, Q3 + t·IQR] (``iqr``) or |z| > t with ddof-1 std
    (``zscore``). NULL values never flag a row. Statistics come from
    ``fit_df`` (default: ``df``)."""
    cols = cols or numeric_columns(df)
    src = fit_df if fit_df is not None else df
    if method == "iqr":
        st = _iqr_stats(src, cols, threshold)
        preds = [(F.col(c) < F.col(f"_{c}_lo")) | (F.col(c) > F.col(f"_{c}_hi")) for c in cols]
    elif method == "zscore":
        st = _z_stats(src, cols)
        preds = [F.abs(F.try_divide(F.col(c) - F.col(f"_{c}_m"), F.col(f"_{c}_s"))) > threshold for c in cols]
    else:
        raise ValueError(f"unknown method {method}")
    j = with_scalars(df, st)
    flag = reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in preds], F.lit(False))
    return j.withColumn(name, flag).drop(*st.columns)


def guarded_removal(df: DataFrame, method: str = "iqr", threshold: float = 1.5, cols=None,
                    max_share: float = 0.1, fit_df: DataFrame | None = None) -> DataFrame:
    """Drop flagged rows only if 0 < flagged < ``max_share`` of rows;
    otherwise keep everything. The decision is a one-row scalar computed in
    the same plan, so the result stays lazy."""
    flagged = outlier_flag(df, method, threshold, cols, fit_df, "_out")
    share = flagged.agg(F.sum(F.col("_out").cast("bigint")).alias("_nf"), F.count(F.lit(1)).alias("_n"))
    j = with_scalars(flagged, share)
    remove = (F.col("_nf") > 0) & (F.col("_nf") < F.col("_n") * max_share)
    return j.filter(~(remove & F.col("_out"))).drop("_out", "_nf", "_n")


def remove_outliers_train_only(df: DataFrame, split: str = "split", method: str = "iqr",
                               threshold: float = 1.5, cols=None) -> DataFrame:
    """Guarded removal applied to the training rows only (statistics
    from the training rows); test rows pass through untouched."""
    train = df.filter(F.col(split) == "train")
    test = df.filter(F.col(split) != "train")
    return guarded_removal(train, method, threshold, cols).unionByName(test)


def removal_fences(train: DataFrame, cols, threshold: float = 1.5, max_share: float = 0.1) -> dict:
    """E4 for eager fits: the IQR fences of ``cols`` as numbers (for
    :func:`fence_flag`), or none if no row or ``max_share`` or more of the
    rows lie outside. Two aggregates; two rows reach the driver."""
    row = _iqr_stats(train, cols, threshold).first()
    fences = {c: (row[f"_{c}_lo"], row[f"_{c}_hi"]) for c in cols}
    seen = train.agg(count_if(fence_flag(fences)).alias("out"), F.count(F.lit(1)).alias("n")).first()
    return fences if 0 < (seen["out"] or 0) < seen["n"] * max_share else {}


def any_flag(preds) -> Column:
    return reduce(lambda a, b: a | b, preds)


def fence_flag(fences: dict) -> Column:
    """True when any column is outside its fitted fences (NULL never flags)."""
    preds = [F.coalesce((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi)), F.lit(False))
             for c, (lo, hi) in fences.items() if lo is not None and hi is not None]
    return any_flag(preds) if preds else F.lit(False)
