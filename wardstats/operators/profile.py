"""Profiling operators.

Per-column statistics are computed in ONE wide aggregate over all columns
(one scan, partial aggregation per task) and then turned into long rows with
``stack``; the reference's per-column loops become a single Spark job.
Row-level reshaping (unpivot) is only used where the result is grouped by
the value itself (top values, histograms).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstats.functions.joins import lookup_join, with_scalars
from wardstats.functions.percentiles import grouped, percentile_of
from wardstats.functions.stats import count_if, r6, std1
from wardstats.operators.evaluate import hash_bucket

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns from the schema (no data is read)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def _stack(names, *fields) -> str:
    """``stack`` expression turning ``{name}__{field}`` columns into rows."""
    cols = ", ".join(f"'{n}', " + ", ".join(f"`{n}__{f}`" for f in fields) for n in names)
    return f"stack({len(names)}, {cols}) as (column_name, {', '.join(fields)})"


def _nulls(c: str) -> Column:
    return F.sum(F.col(c).isNull().cast("bigint"))


# ---------------------------------------------------------------- B1, B3, B4, B9

def table_metrics(df: DataFrame) -> DataFrame:
    """B1: rows, columns and total missing cells."""
    cols = df.columns
    miss = sum((_nulls(c) for c in cols), F.lit(0).cast("bigint"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(cols)).alias("n_columns"),
                  miss.cast("bigint").alias("missing_cells"))


def column_info(df: DataFrame) -> DataFrame:
    """Per column: type, missing count and missing % (2 decimals)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[_nulls(c).alias(f"{c}__missing") for c in cols])
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    long = wide.selectExpr("_n", _stack(cols, "missing"))
    return long.select("column_name", F.element_at(types, F.col("column_name")).alias("dtype"),
                       F.col("missing").cast("bigint").alias("missing_count"),
                       F.round(F.try_divide(F.col("missing") * 100.0, F.col("_n")), 2).alias("missing_pct"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first (rank column)."""
    info = column_info(df).filter(F.col("missing_count") > 0)
    w = Window.orderBy(F.desc("missing_count"), "column_name")
    return info.select(F.row_number().over(w).alias("rank"), "column_name", "missing_count")


def data_quality(df: DataFrame) -> DataFrame:
    """Share of non-missing cells and the >5 % / >10 % missing flags."""
    t = table_metrics(df)
    miss = F.col("missing_cells") / (F.col("n_rows") * F.col("n_columns"))
    return t.select("n_rows", "n_columns", "missing_cells", r6((1 - miss) * 100).alias("quality_pct"),
                    r6(miss).alias("missing_share"), (miss > 0.05).alias("over_5pct"), (miss > 0.1).alias("over_10pct"))


# ---------------------------------------------------------------- B2, B5, B7

def describe_numeric(df: DataFrame, cols=None) -> DataFrame:
    """B2: count, mean, std (ddof 1), min, quartiles, max per numeric column
    (pandas ``describe``), exact quartiles."""
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"), std1(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), percentile_of(x, [0.25, 0.5, 0.75]).alias(f"{c}__q"),
                 F.max(x).alias(f"{c}__max")]
    long = grouped(df, [], *aggs).selectExpr(_stack(cols, "count", "mean", "std", "min", "q", "max"))
    return long.select("column_name", F.col("count").cast("bigint").alias("count"), r6("mean").alias("mean"),
                       r6("std").alias("std"), r6("min").alias("min"), r6(F.col("q")[0]).alias("q25"),
                       r6(F.col("q")[1]).alias("q50"), r6(F.col("q")[2]).alias("q75"), r6("max").alias("max"))


def distinct_per_column(df: DataFrame, cols=None, approx: bool = False) -> DataFrame:
    """Distinct values per column, NULL counted as one value (pandas
    ``unique``). ``approx`` switches to HyperLogLog for huge cardinalities."""
    cols = cols or df.columns
    if not approx:
        return distinct_counts(df, cols, nulls=True)
    wide = df.agg(*[(F.approx_count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"{c}__n") for c in cols])
    return wide.selectExpr(_stack(cols, "n")).select("column_name", F.col("n").cast("bigint").alias("n_distinct"))


def distinct_counts(df: DataFrame, cols, nulls: bool = False) -> DataFrame:
    """(column_name, n_distinct) by an aggregate of its own per column, so a
    task holds the distinct values of one column and not rows as wide as the
    table, as several distinct counts in one aggregate do. With ``nulls``
    NULL counts as a value; then an empty table has no count."""
    extra = (lambda c: F.max(F.col(c).isNull().cast("int"))) if nulls else (lambda c: F.lit(0))
    parts = [df.select(c).agg((F.count_distinct(c) + extra(c)).cast("bigint").alias("n_distinct"))
             .select(F.lit(c).alias("column_name"), "n_distinct") for c in cols]
    return reduce(DataFrame.unionAll, parts)


def detect_types(df: DataFrame, ratio: float = 0.05, max_levels: int = 20) -> DataFrame:
    """Semantic type per column. Integer/double columns with few levels
    (distinct/rows < ``ratio`` and distinct < ``max_levels``) are
    categorical; text columns whose non-null values all parse as timestamps
    are datetime; timestamps are datetime; everything else categorical."""
    fields = df.schema.fields
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    bad = {c: count_if(F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull()) for c in texts}
    stats = df.agg(F.count(F.lit(1)).alias("_n"), *[(bad[c] == 0).alias(f"_dt{i}") for i, c in enumerate(texts)])
    names = [f.name for f in fields]
    kinds = F.create_map(*[x for f in fields for x in (F.lit(f.name), F.lit(
        "numeric" if isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType)) else
        "datetime" if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else
        "text" if isinstance(f.dataType, T.StringType) else "other"))])
    long = with_scalars(distinct_counts(df, names).withColumnRenamed("n_distinct", "nd"), stats)
    dt = F.lit(False)
    for i, c in enumerate(texts):
        dt = F.when(F.col("column_name") == c, F.col(f"_dt{i}")).otherwise(dt)
    long = long.select("column_name", "_n", "nd", dt.alias("dt"))
    kind = F.element_at(kinds, F.col("column_name"))
    ur = F.try_divide(F.col("nd"), F.col("_n"))
    sem = (F.when(kind == "numeric", F.when((ur < ratio) & (F.col("nd") < max_levels), "categorical")
                  .otherwise("numerical"))
           .when(kind == "datetime", "datetime")
           .when((kind == "text") & F.col("dt"), "datetime")
           .otherwise("categorical"))
    return long.select("column_name", kind.alias("storage_kind"), F.col("nd").cast("bigint").alias("n_distinct"),
                       r6(ur).alias("unique_ratio"), sem.alias("semantic_type"))


# Name keywords that make a column a suggested target.
TARGET_WORDS = ("wait", "time", "outcome", "satisfaction", "cost", "length", "duration")


def suggest_targets(df: DataFrame, words=TARGET_WORDS, numeric_only: bool = False) -> DataFrame:
    """Columns whose name suggests a target, with their non-null and
    distinct counts (one aggregate over the suggested columns)."""
    num = set(numeric_columns(df))
    cands = [c for c in df.columns if any(w in c.lower() for w in words) and (c in num or not numeric_only)]
    if not cands:
        return df.sparkSession.createDataFrame([], "column_name string, is_numeric boolean, non_null bigint, "
                                                   "n_distinct bigint")
    known = with_scalars(distinct_counts(df, cands), df.agg(*[F.count(c).alias(f"_nn{i}") for i, c in enumerate(cands)]))
    isnum = F.create_map(*[x for c in cands for x in (F.lit(c), F.lit(c in num))])
    seen = F.create_map(*[x for i, c in enumerate(cands) for x in (F.lit(c), F.col(f"_nn{i}"))])
    return known.select("column_name", F.element_at(isnum, F.col("column_name")).alias("is_numeric"),
                        F.element_at(seen, F.col("column_name")).cast("bigint").alias("non_null"), "n_distinct")


# ---------------------------------------------------------------- B6, B15, B16

def head_rows(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """First ``n`` rows by an explicit order (distributed top-k)."""
    return df.orderBy(*([order_by] if isinstance(order_by, str) else order_by)).limit(n)


def top_values(df: DataFrame, cols, k: int = 10, buckets: int = 256) -> DataFrame:
    """Top-k values by count per column (ties by value), NULL excluded
    like ``value_counts``.

    Counts are aggregated first (map-side combined). The ranking is salted
    in two stages so no task ranks all distinct values of a column: the top
    k of each (column, hash bucket of the value) survive stage one — the
    global top k are among them — and stage two ranks at most
    ``buckets × k`` rows per column."""
    stack = "stack({}, {}) as (column_name, value)".format(
        len(cols), ", ".join(f"'{c}', cast(`{c}` as string)" for c in cols))
    counts = df.selectExpr(stack).filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("count"))
    order = (F.desc("count"), F.col("value"))
    salted = counts.withColumn("_b", F.pmod(F.xxhash64("value"), F.lit(buckets)))
    w1 = Window.partitionBy("column_name", "_b").orderBy(*order)
    cands = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_b", "_r")
    w = Window.partitionBy("column_name").orderBy(*order)
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ordered_counts(df: DataFrame, col: str, categories, where: Column | None = None) -> DataFrame:
    """Counts in a fixed category order, zero for absent categories.
    The category list is a parameter (fixed size), attached by ``explode``."""
    d = df.filter(where) if where is not None else df
    counts = d.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    cats = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in categories])).alias("pos", col))
    j = cats.join(counts, col, "left")
    return j.select((F.col("pos") + 1).alias("position"), col, F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


# ---------------------------------------------------------------- B10, B11

def correlation_matrix(df: DataFrame, cols=None) -> DataFrame:
    """Pearson correlation of every ordered pair (long form), pairwise
    complete rows as in pandas; NULL where a side is constant. One pass: each
    row gives its complete pairs, which meet in a running aggregate of three
    moments per pair inside every task; only one row per pair leaves it."""
    cols = list(cols or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    told = F.lit(None).cast("map<int,double>")
    base = df.select(F.lit(1).alias("_one")).limit(1)
    if pairs:
        x = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
        place = {c: f"_x{i}" for i, c in enumerate(cols)}
        rows = x.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(place[a]).alias("a"), F.col(place[b]).alias("b")) for k, (a, b) in enumerate(pairs)])))
        each = rows.where("a IS NOT NULL AND b IS NOT NULL").groupBy("k").agg(
            F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("corr"))
        base, told = each.agg(F.map_from_entries(F.collect_list(F.struct("k", "corr"))).alias("_told")), F.col("_told")
    order = [(a, b, k) for k, (a, b) in enumerate(pairs)] + [(b, a, k) for k, (a, b) in enumerate(pairs)] + [(c, c, -1) for c in cols]
    names = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.lit(k).alias("k")) for a, b, k in order])
    long = base.select(told.alias("_told"), F.inline(names))
    corr_ = F.when(F.col("k") < 0, F.lit(1.0)).otherwise(F.try_element_at("_told", "k"))
    return long.select("col_a", "col_b", r6(corr_).alias("corr"))


# Name keywords of outcome-like columns.
OUTCOME_WORDS = ("satisfaction", "outcome", "quality", "score")


def outcome_correlation(df: DataFrame, target: str, words=OUTCOME_WORDS) -> DataFrame:
    """Correlation matrix over outcome-like numeric columns + target."""
    num = numeric_columns(df)
    cols = [c for c in num if any(w in c.lower() for w in words) and c != target] + [target]
    return correlation_matrix(df, cols)


# ---------------------------------------------------------------- B12-B14, B19

def histogram(df: DataFrame, col: str, bins: int = 30, keys=()) -> DataFrame:
    """Equal-width histogram over [min, max] (the maximum falls in the
    last bin, as in NumPy), every bin reported including empty ones.
    With ``keys``, one histogram per group with shared edges."""
    keys = list(keys)
    x = F.col(col).cast("double")
    d = df.select(*keys, x.alias("_x")).filter(F.col("_x").isNotNull())
    st = d.agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    j = with_scalars(d, st)
    width = F.col("_mx") - F.col("_mn")
    b = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_mn")) / width * bins), F.lit(bins - 1))) \
        .otherwise(F.lit(0)).cast("int")
    counts = j.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    # every (group, bin) cell, so empty bins are reported: one row per group
    # (an aggregate) expanded to the bins with explode
    groups = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_g")) if keys else st
    grid = with_scalars(groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")), st)
    out = lookup_join(grid, counts, [*keys, "bin"])
    w = (F.col("_mx") - F.col("_mn")) / bins
    return out.select(*keys, "bin", r6(F.col("_mn") + F.col("bin") * w).alias("lower"),
                      r6(F.when(F.col("bin") == bins - 1, F.col("_mx")).otherwise(F.col("_mn") + (F.col("bin") + 1) * w))
                      .alias("upper"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def histogram_overlay(scored: DataFrame, bins: int = 30, y: str = "y_true", p: str = "y_pred",
                      keys=()) -> DataFrame:
    """Actual and predicted histograms on shared edges."""
    keys = list(keys)
    long = scored.select(*keys, F.inline(F.array(F.struct(F.lit("actual").alias("series"), F.col(y).alias("value")),
                                                 F.struct(F.lit("predicted").alias("series"), F.col(p).alias("value")))))
    return histogram(long, "value", bins, keys=[*keys, "series"])


def kde_grid(df: DataFrame, col: str, grid: int = 64, bins: int = 4096, keys=()) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth
    (σ₁·n^(-1/5), as SciPy's ``gaussian_kde``) on ``grid`` points spanning
    [min, max] of each group.

    Values are first pre-aggregated into ``bins`` equal-width bins per group
    (bin centre × count), so the kernel sum costs bins × grid per group no
    matter how many rows there are; each bin row is expanded to the grid with
    ``explode`` (no join)."""
    keys = list(keys)
    x = F.col(col).cast("double")
    d = df.select(*keys, x.alias("_x")).filter(F.col("_x").isNotNull())
    st = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), std1("_x").alias("_sd"),
                              F.min("_x").alias("_mn"), F.max("_x").alias("_mx")) if keys else \
        d.agg(F.count(F.lit(1)).alias("_n"), std1("_x").alias("_sd"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    j = lookup_join(d, st, keys) if keys else with_scalars(d, st)
    width = F.col("_mx") - F.col("_mn")
    b = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_mn")) / width * bins), F.lit(bins - 1))) \
        .otherwise(F.lit(0)).cast("int")
    binned = j.groupBy(*keys, b.alias("_b")).agg(
        F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"), F.first("_sd").alias("_sd"),
        F.first("_mn").alias("_mn"), F.first("_mx").alias("_mx"))
    h = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    centre = F.col("_mn") + (F.col("_b") + 0.5) * (width / bins)
    ex = binned.select(*keys, "_c", "_n", h.alias("_h"), centre.alias("_ctr"), "_mn", "_mx",
                       F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    gx = F.col("_mn") + F.col("point") * ((F.col("_mx") - F.col("_mn")) / (grid - 1))
    u = F.try_divide(gx - F.col("_ctr"), F.col("_h"))  # NULL if all values are equal: no density
    contrib = F.col("_c") * F.exp(-0.5 * u * u)
    g = ex.groupBy(*keys, "point").agg(F.first(gx).alias("_gx"), F.sum(contrib).alias("_s"),
                                      F.first("_n").alias("_n"), F.first("_h").alias("_h"))
    dens = F.try_divide(F.col("_s"), F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi))
    return g.select(*keys, "point", r6("_gx").alias("x"), r6(dens).alias("density"))


# ---------------------------------------------------------------- B17, B18

def normalized_box(df: DataFrame, cols=None, max_cols: int = 8) -> DataFrame:
    """Five-number summary of z-scored (ddof 1) columns, first
    ``max_cols`` numeric columns, plus the 1.5·IQR outlier count. z is affine
    in x, so quantiles are taken on x and transformed; a second aggregate
    counts the outliers against the broadcast one-row fences."""
    cols = (cols or numeric_columns(df))[:max_cols]
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__m"), std1(x).alias(f"{c}__s"), F.min(x).alias(f"{c}__lo"),
                 percentile_of(x, [0.25, 0.5, 0.75]).alias(f"{c}__q"), F.max(x).alias(f"{c}__hi")]
    st = grouped(df, [], *aggs)
    fences = []
    for c in cols:
        q1, q3 = F.col(f"{c}__q")[0], F.col(f"{c}__q")[2]
        fences += [F.round(q1 - 1.5 * (q3 - q1), 9).alias(f"{c}__f1"), F.round(q3 + 1.5 * (q3 - q1), 9).alias(f"{c}__f2")]
    fence_row = st.select(*fences)
    j = with_scalars(df.select(*cols), fence_row)
    out = j.agg(*[count_if((F.col(c) < F.col(f"{c}__f1")) | (F.col(c) > F.col(f"{c}__f2"))).alias(f"{c}__o")
                  for c in cols])
    wide = with_scalars(out, st)
    long = wide.selectExpr(_stack(cols, "m", "s", "lo", "q", "hi", "o"))

    def z(v):
        return r6(F.try_divide(v - F.col("m"), F.col("s")))

    return long.select("column_name", z(F.col("lo")).alias("z_min"), z(F.col("q")[0]).alias("z_q1"),
                       z(F.col("q")[1]).alias("z_median"), z(F.col("q")[2]).alias("z_q3"), z(F.col("hi")).alias("z_max"),
                       F.col("o").cast("bigint").alias("n_outliers"))


def box_by_group(df: DataFrame, measure: str, group: str) -> DataFrame:
    """Quartiles, 1.5·IQR whisker ends (most extreme value inside the
    fences) and outlier count of ``measure`` per ``group``; rows without a
    group belong to none (pandas' groupby rule)."""
    x = F.col(measure).cast("double")
    d = df.select(F.col(group).alias("group_value"), x.alias("_x")).filter(F.col("_x").isNotNull() & F.col("group_value").isNotNull())
    st = grouped(d, ["group_value"], percentile_of("_x", [0.25, 0.5, 0.75]).alias("_q"),
                 F.min("_x").alias("_mn"), F.max("_x").alias("_mx"), F.count(F.lit(1)).alias("n"))
    st = st.select("*", F.round(F.col("_q")[0] - 1.5 * (F.col("_q")[2] - F.col("_q")[0]), 9).alias("_f1"),
                   F.round(F.col("_q")[2] + 1.5 * (F.col("_q")[2] - F.col("_q")[0]), 9).alias("_f2"))
    j = lookup_join(d, st.select("group_value", "_f1", "_f2"), ["group_value"])
    inside = (F.col("_x") >= F.col("_f1")) & (F.col("_x") <= F.col("_f2"))
    w = j.groupBy("group_value").agg(F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
                                      F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
                                      count_if(~inside).alias("n_outliers"))
    out = lookup_join(st, w, ["group_value"], how="inner")
    return out.select("group_value", "n", r6("_mn").alias("min"), r6(F.col("_q")[0]).alias("q1"),
                      r6(F.col("_q")[1]).alias("median"), r6(F.col("_q")[2]).alias("q3"), r6("_mx").alias("max"),
                      r6("whisker_low").alias("whisker_low"), r6("whisker_high").alias("whisker_high"), "n_outliers")


# ---------------------------------------------------------------- B20, B21

def mean_by_time(df: DataFrame, target: str, bucket_cols) -> DataFrame:
    """Mean target per time bucket, long over the bucket columns."""
    stack = "stack({}, {}) as (bucket_column, bucket)".format(
        len(bucket_cols), ", ".join(f"'{c}', cast(`{c}` as string)" for c in bucket_cols))
    long = df.selectExpr(stack, f"cast(`{target}` as double) as _y")
    return long.groupBy("bucket_column", "bucket").agg(F.count("_y").alias("n"), F.avg("_y").alias("_m")).select(
        "bucket_column", "bucket", "n", r6("_m").alias("mean_target"))


def scatter_sample(df: DataFrame, id_col: str, cols, fraction: float = 1.0, salt: str = "scatter") -> DataFrame:
    """The plotted columns of every row, or on request of a deterministic
    sample (hash of the id) that is the same on every run and engine."""
    if fraction >= 1.0:
        return df.select(id_col, *cols)
    keep = hash_bucket(F.concat(F.lit(salt), F.col(id_col).cast("string")), 10000) < int(round(fraction * 10000))
    return df.filter(keep).select(id_col, *cols)
