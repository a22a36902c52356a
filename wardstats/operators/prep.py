"""Imputation, scaling, encoding, selection and the full preprocess
(SURVEY §2.6, F1-F15) with a clean fit / apply split.

``fit`` runs a fixed, small number of aggregate jobs over the data (group
statistics; two passes of column-type detection that also yield the outlier
fences; one numeric and one stacked categorical aggregate for every
imputation, scaling and category parameter) and keeps only those parameters
— bounded, one row per column or category — on the driver, like a Spark ML
``Model``. ``apply`` is then a single lazy
projection built from the parameters: no further job, same code path for
training data, new batches and streams (the reference recomputes group
statistics on new data and skips outlier removal at apply time; here both
are fixed at fit time).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstats.functions.joins import lookup_join, settled
from wardstats.functions.percentiles import grouped, percentile_of
from wardstats.functions.stats import corr, r6, std0
from wardstats.operators import outliers as E
from wardstats.operators import transform as D
from wardstats.functions.stats import eps_div
from wardstats.operators.profile import distinct_counts, numeric_columns

#: How far rounding can keep the r² of a perfect fit from 1.
PERFECT = 1e-12
DATE_PART_SUFFIXES = ("_hour", "_day_of_week", "_month", "_quarter", "_is_weekend")


@dataclass(frozen=True)
class PrepOptions:
    """preprocessing switches (the reference's option dict)."""
    missing_strategy: str = "mean/mode"        # 'mean/mode' | 'median/mode'
    normalize: bool = True
    encode_categorical: bool = True
    feature_engineering: bool = True
    outlier_detection: bool = True
    feature_selection: bool = False
    max_features: int | None = None             # default min(50, n) (T10)
    id_mode: str = "parity"                     # 'parity' | 'word' (T3)
    treat_date_parts: str = "categorical"       # 'categorical' (parity, T6) | 'numeric'
    exclude_target_ratios: bool = True          # T8
    max_categories: int = 100
    unique_ratio: float = 0.05
    max_levels: int = 20

    def with_options(self, **kw) -> "PrepOptions":
        return replace(self, **kw)


@dataclass
class Roles:
    """Which columns play the reference's named roles (all optional)."""
    nurse: str | None = None
    specialists: str | None = None
    beds: str | None = None
    urgency: str | None = None
    region: tuple = ()


@dataclass
class PrepModel:
    """Fitted parameters; :meth:`apply` is one projection."""
    target: str | None
    options: PrepOptions
    roles: Roles
    dropped: list
    numeric: list
    categorical: list
    num_fill: dict = field(default_factory=dict)
    num_mean: dict = field(default_factory=dict)
    num_std: dict = field(default_factory=dict)
    cat_fill: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)
    complexity: dict = field(default_factory=dict)
    fences: dict = field(default_factory=dict)
    remove: bool = False
    selected: list | None = None
    #: columns over ``max_categories`` levels: their category table (value,
    #: position) and its number of rows
    index: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)

    # ------------------------------------------------------------ apply
    def feature_names(self) -> list[str]:
        names = list(self.numeric)
        if self.options.encode_categorical:
            for c in self.categorical:
                names += [f"{c}_{_py_str(v)}" for v in self.categories.get(c, [])[1:]]
        return names

    def wide(self) -> list[str]:
        """Encoded columns with more levels than columns are made for."""
        return [c for c in self.categorical if c in self.index] if self.options.encode_categorical else []

    def engineered(self, df: DataFrame) -> DataFrame:
        """Steps before encoding: id drop and feature engineering, using
        the fitted group statistics (literal maps, no join)."""
        out = df.drop(*[c for c in self.dropped if c in df.columns])
        if self.options.feature_engineering:
            out = engineer(out, self.target, self.roles, self.options, complexity=self.complexity)
        return out

    def apply(self, df: DataFrame, keep=(), remove_outliers: bool = False) -> DataFrame:
        """transform rows with the fitted parameters (works on streams).
        ``keep`` passes extra columns (e.g. an id) through;
        ``remove_outliers`` applies the guarded removal (training data)."""
        out = self.engineered(df)
        if remove_outliers and self.remove:
            # fitted fences and decision: a literal filter, no extra job
            out = out.filter(~E.fence_flag(self.fences))
        res = _positions(self, out).select(*_projection(self, out, keep))
        if self.selected is not None:
            wide = [f"{c}_position" for c in self.wide()]
            res = res.select(*keep, *self.selected, *wide, *([self.target] if self.target in res.columns else []))
        return res

    def apply_vector(self, df: DataFrame, keep=(), remove_outliers: bool = False, out: str = "features") -> DataFrame:
        """:meth:`apply` with all features in one vector column: the numeric
        and 0/1 columns, then a sparse block per wide column, as long as its
        category table less the first category."""
        from pyspark.ml.feature import OneHotEncoder, VectorAssembler

        res = self.apply(df, keep, remove_outliers)
        plain = [n for n in self.feature_names() if self.selected is None or n in self.selected]
        parts = list(plain)
        for c in self.wide():
            # no cell (first, unknown category) is the last code, which the encoder drops
            n = max(self.sizes[c], 2)
            code = F.when(F.col(f"{c}_position") < 0, F.lit(n - 1)).otherwise(F.col(f"{c}_position")).cast("double")
            meta = {"ml_attr": {"type": "nominal", "name": c, "num_vals": n}}
            res = res.withColumn(f"_code_{c}", code.alias(f"_code_{c}", metadata=meta))
            res = OneHotEncoder(inputCols=[f"_code_{c}"], outputCols=[f"_hot_{c}"], dropLast=True).fit(res).transform(res)
            parts.append(f"_hot_{c}")
        target = [self.target] if self.target in res.columns else []
        return VectorAssembler(inputCols=parts, outputCol=out).transform(res).select(*keep, out, *target)


def _py_str(v) -> str:
    """Category label as the reference prints it (``str`` of the value)."""
    if isinstance(v, float) and v.is_integer():
        return repr(v)
    return str(v)


# ---------------------------------------------------------------- engineering

def engineer(df: DataFrame, target: str | None, roles: Roles, options: PrepOptions,
             complexity: dict | None = None) -> DataFrame:
    """D1-D9 in the reference's order: date parts; staff and bed ratios;
    pairwise time ratios; capacity utilisation; urgency score; group
    complexity (fitted values passed in, or computed from ``df``)."""
    out = D.date_features(df)
    num_snapshot = numeric_columns(out)
    if roles.nurse and roles.specialists and roles.nurse in out.columns and roles.specialists in out.columns:
        out = out.withColumn("staff_efficiency_ratio", eps_div(roles.nurse, roles.specialists, 1e-6))
    if roles.beds and roles.specialists and roles.beds in out.columns and roles.specialists in out.columns:
        out = out.withColumn("beds_per_specialist", eps_div(roles.beds, roles.specialists, 1e-6))
    excl = (target,) if (target and options.exclude_target_ratios) else ()
    out = D.pairwise_ratios(out, exclude=excl)
    if roles.beds and roles.beds in out.columns:
        cands = [c for c in num_snapshot if any(w in c.lower() for w in D.CAPACITY_WORDS)]
        if cands:
            out = out.withColumn("capacity_utilization",
                                 F.try_divide(F.col(cands[0]).cast("double"), F.col(roles.beds)))
    if roles.urgency and roles.urgency in out.columns:
        out = D.urgency_numeric(out, roles.urgency)
    regions = [c for c in out.columns if "region" in c.lower()] if not roles.region else list(roles.region)
    if target and regions:
        for g in regions:
            if complexity is not None and isinstance(complexity.get(g), DataFrame):
                out = lookup_join(out, complexity[g], g)
            elif complexity is not None and g in complexity:
                pairs = list(complexity[g].items())
                m = D.map_lookup(F.col(g), pairs) if pairs else F.lit(None).cast("double")
                out = out.withColumn(f"{g}_complexity", m.cast("double"))
            elif target in out.columns:
                st = out.groupBy(g).agg(F.round(F.coalesce(F.stddev_samp(target), F.lit(0.0)), 6)
                                        .alias(f"{g}_complexity"))
                out = lookup_join(out, st, g)
    return out


# ---------------------------------------------------------------- type detection

def _detect(df: DataFrame, cols, options: PrepOptions, date_parts=frozenset(), with_fences: bool = False):
    """B7 inside the fit → (numeric, categorical, n_distinct).

    Pass 1 is one aggregate of fixed-size HyperLogLog sketches (no row
    expansion, map-side combined). Only columns the sketch puts below
    ``exact_below`` distinct values — the only ones whose exact count can
    change a decision (levels < 20, categories ≤ cap) — get an exact count
    in pass 2 as the size of a bounded value set (no row expansion); with
    ``with_fences`` the same pass computes the IQR fences of the numeric
    columns for the outlier guard. Returns (numeric, categorical,
    n_distinct, fences)."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    exact_below = max(options.max_levels, options.max_categories) * 2
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs.append(F.approx_count_distinct(c, 0.05).alias(f"{c}__hll"))
        if isinstance(fields[c], T.StringType):
            aggs.append((F.sum((F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull()).cast("int")) == 0)
                        .alias(f"{c}__dt"))
    row = df.agg(*aggs).first()
    n = row["_n"] or 0
    low = [c for c in cols if row[f"{c}__hll"] < exact_below]
    # pass 2: exact level counts of the low-cardinality columns (sets of at
    # most ~exact_below values) and, when asked, the IQR percentiles of every
    # numeric-typed column, whichever way its level count decides
    num_typed = [c for c in cols if isinstance(fields[c], (T.IntegerType, T.LongType, T.DoubleType, T.FloatType))
                 and c not in date_parts] if with_fences else []
    aggs2 = [F.size(F.collect_set(c)).alias(c) for c in low] + \
        [percentile_of(F.col(c).cast("double"), [0.25, 0.75]).alias(f"{c}__iqr") for c in num_typed]
    row2 = grouped(df, [], *aggs2).first() if aggs2 else None
    exact = {c: row2[c] for c in low} if row2 is not None else {}
    numeric, categorical, nds = [], [], {}
    for c in cols:
        nd = exact[c] if c in exact else row[f"{c}__hll"]
        nds[c] = nd
        t = fields[c]
        is_part = c in date_parts and options.treat_date_parts == "categorical"
        if isinstance(t, (T.IntegerType, T.LongType, T.DoubleType, T.FloatType)) and not is_part:
            if n and nd / n < options.unique_ratio and nd < options.max_levels:
                categorical.append(c)
            else:
                numeric.append(c)
        elif isinstance(t, T.StringType):
            if row[f"{c}__dt"]:
                continue  # text dates: parsed upstream (T4), never a feature here
            categorical.append(c)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            continue
        else:
            categorical.append(c)
    fences = {}
    if with_fences and row2 is not None:
        for c in numeric:
            q = row2[f"{c}__iqr"]
            if q is not None and q[0] is not None:
                fences[c] = (round(q[0] - 1.5 * (q[1] - q[0]), 9), round(q[1] + 1.5 * (q[1] - q[0]), 9))
            else:
                fences[c] = (None, None)
    return numeric, categorical, nds, fences


# ---------------------------------------------------------------- fit

def _param_aggs(numeric, strategy, tag: str, keep: Column | None):
    """Numeric parameter aggregates over the rows where ``keep`` holds."""
    def w(x):
        return x if keep is None else F.when(keep, x)

    aggs = [F.count(w(F.lit(1))).alias(f"_n{tag}")]
    for c in numeric:
        x = w(F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"{c}__nn{tag}"), F.avg(x).alias(f"{c}__m{tag}"), F.var_pop(x).alias(f"{c}__v{tag}")]
        if strategy.startswith("median"):
            aggs.append(percentile_of(x, 0.5).alias(f"{c}__med{tag}"))
    return aggs


def _numeric_from(row, numeric, strategy, tag: str) -> dict:
    n = row[f"_n{tag}"]
    out = {"num_fill": {}, "num_mean": {}, "num_std": {}}
    for c in numeric:
        nn, m, v = row[f"{c}__nn{tag}"], row[f"{c}__m{tag}"], row[f"{c}__v{tag}"]
        fill = row[f"{c}__med{tag}"] if strategy.startswith("median") else m
        fill = 0.0 if fill is None else float(fill)
        k = n - nn
        # moments of the imputed column from those of the observed values
        mean_i = ((m or 0.0) * nn + fill * k) / n if n else 0.0
        var_i = ((nn * ((v or 0.0) + ((m or 0.0) - mean_i) ** 2) + k * (fill - mean_i) ** 2) / n) if n else 0.0
        out["num_fill"][c], out["num_mean"][c] = fill, mean_i
        out["num_std"][c] = math.sqrt(var_i) if var_i > 0 else 0.0
    return out


def _typed(v: str, t: T.DataType):
    if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return int(v)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return float(v)
    if isinstance(t, T.BooleanType):
        return v == "true"
    return v


def _category_counts(df: DataFrame, categorical, keep: Column | None) -> dict:
    """Value counts of every categorical column in ONE grouped aggregate:
    the columns are stacked to (column, value) rows and counted (all rows and
    rows where ``keep`` holds). The result has at most sum(levels) rows —
    bounded by the level cap checked before — and is collected."""
    if not categorical:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    stack = "stack({}, {}) as (_col, _val)".format(
        len(categorical), ", ".join(f"'{c}', cast(`{c}` as string)" for c in categorical))
    x = df.select(*categorical, (keep if keep is not None else F.lit(True)).alias("_keep"))
    g = x.selectExpr(stack, "_keep").filter(F.col("_val").isNotNull()).groupBy("_col", "_val").agg(
        F.count(F.lit(1)).alias("n_all"), F.sum(F.col("_keep").cast("bigint")).alias("n_keep"))
    out: dict = {c: [] for c in categorical}
    for r in g.collect():
        out[r["_col"]].append((_typed(r["_val"], types[r["_col"]]), r["n_all"], r["n_keep"] or 0))
    return out


def _categorical_from(counts: dict, use_keep: bool) -> dict:
    out = {"cat_fill": {}, "categories": {}}
    for c, vals in counts.items():
        present = [(v, nk if use_keep else na) for v, na, nk in vals if (nk if use_keep else na) > 0]
        cats = sorted(v for v, _ in present)
        # mode: most frequent, smallest value on ties
        mode = min(present, key=lambda vc: (-vc[1], vc[0]))[0] if present else None
        out["cat_fill"][c], out["categories"][c] = mode, cats
    return out


def _kept_table(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared checkpoint folder."""
    from wardstats.functions.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _narrow(categorical, nds, max_categories) -> tuple[list, list]:
    """Columns that get a 0/1 column per category, and those with more levels
    than that (``nds``: their counts)."""
    wide = [c for c in categorical if nds.get(c, 0) > max_categories]
    return [c for c in categorical if c not in wide], wide


def _category_tables(df: DataFrame, wide, keep: Column | None) -> dict:
    """Mode and category table of columns of any cardinality: values are
    counted and numbered by distributed jobs, and only the mode (one row) and
    the number of categories come to the driver."""
    out: dict = {"cat_fill": {}, "index": {}, "sizes": {}}
    for c in wide:
        rows = df.where(F.col(c).isNotNull() if keep is None else F.col(c).isNotNull() & keep)
        counts = _kept_table(rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n")))
        first = counts.agg(F.min(F.struct((-F.col("_n")).alias("less"), F.col(c).alias("v"))).alias("m"), F.count(F.lit(1)).alias("n")).first()
        out["cat_fill"][c], out["sizes"][c] = first["m"]["v"] if first["m"] else None, first["n"]
        out["index"][c] = distributed_rank(counts.select(c), c).select(c, (F.col("_rank") - 1).cast("bigint").alias("position"))
    return out


def _with_tables(params: dict, tables: dict) -> dict:
    params["cat_fill"].update(tables["cat_fill"])
    return {**params, "index": tables["index"], "sizes": tables["sizes"]}


def fit_params(df: DataFrame, numeric, categorical, strategy: str = "mean/mode", max_categories: int = 100,
               nds: dict | None = None) -> dict:
    """Every parameter in two aggregates: fill value, mean and std₀ of the
    imputed numeric columns (one global aggregate); mode and sorted
    category list of the categorical columns (one stacked value count;
    columns over ``max_categories`` levels get a category table instead)."""
    if nds is None and categorical:
        nds = df.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in categorical]).first().asDict()
        nds = {c: n / 2 for c, n in nds.items()}  # an estimate: only what is clearly over
    narrow, wide = _narrow(categorical, nds or {}, max_categories)
    row = grouped(df, [], *_param_aggs(numeric, strategy, "", None)).first()
    out = _numeric_from(row, numeric, strategy, "")
    out.update(_categorical_from(_category_counts(df, narrow, None), False))
    return _with_tables(out, _category_tables(df, wide, None))


def fit_params_guarded(df: DataFrame, numeric, categorical, fences: dict, strategy: str = "mean/mode",
                       max_categories: int = 100, nds: dict | None = None,
                       max_share: float = 0.1) -> tuple[dict, bool]:
    """E3 + F1-F8 without an extra scan for the guard: numeric parameters
    over all rows and over the rows inside the outlier fences plus the
    flagged count in one aggregate, category counts for both variants in
    one grouped aggregate; the guard (remove only if 0 < flagged <
    ``max_share`` of rows) then picks one set."""
    narrow, wide = _narrow(categorical, nds or {}, max_categories)
    flag = E.fence_flag(fences)
    aggs = _param_aggs(numeric, strategy, "", None) + \
        _param_aggs(numeric, strategy, "_k", ~flag) + [F.sum(flag.cast("bigint")).alias("_nf")]
    row = grouped(df, [], *aggs).first()
    nf, n = row["_nf"] or 0, row["_n"] or 0
    remove = bool(0 < nf < n * max_share)
    out = _numeric_from(row, numeric, strategy, "_k" if remove else "")
    out.update(_categorical_from(_category_counts(df, narrow, ~flag), remove))
    return _with_tables(out, _category_tables(df, wide, ~flag if remove else None)), remove


def fit(df: DataFrame, target: str | None = None, options: PrepOptions = PrepOptions(),
        roles: Roles = Roles()) -> PrepModel:
    """C1 → D1-D9 → B7 → E3 → F1-F8 (→ F13), returns the fitted model."""
    dropped = D.id_columns(df, target, options.id_mode)
    work = df.drop(*dropped)
    complexity = {}
    if options.feature_engineering:
        regions = list(roles.region) or [c for c in work.columns if "region" in c.lower()]
        if target and target in work.columns:
            for g in regions:
                # a literal map of few groups, a joined table of many; at most cap + 1 rows reach the driver
                cap = options.max_categories
                st = work.groupBy(g).agg(F.round(F.coalesce(F.stddev_samp(target), F.lit(0.0)), 6).alias(f"{g}_complexity"))
                rows = st.limit(cap + 1).collect()
                if len(rows) > cap:
                    complexity[g] = _kept_table(st.where(F.col(g).isNotNull()))
                else:
                    complexity[g] = {r[g]: r[f"{g}_complexity"] for r in rows if r[g] is not None}
        work = engineer(work, target, roles, options, complexity=complexity)
    feats = [c for c in work.columns if c != target]
    parts = {f"{c}{s}" for c in D.timestamp_columns(df) for s in DATE_PART_SUFFIXES} \
        if options.feature_engineering else set()
    guard = options.outlier_detection
    numeric, categorical, nds, fences = _detect(work, feats, options, parts, with_fences=guard)
    cats = categorical if options.encode_categorical else []
    remove = False
    if guard and numeric:
        params, remove = fit_params_guarded(work, numeric, cats, fences, options.missing_strategy,
                                            options.max_categories, nds)
    else:
        fences = {}
        params = fit_params(work, numeric, cats, options.missing_strategy, options.max_categories, nds)
    model = PrepModel(target, options, roles, dropped, numeric, categorical, complexity=complexity,
                      fences=fences, remove=remove, **params)
    if not options.encode_categorical:
        model.categorical = []
    if options.feature_selection and target:
        k = options.max_features or min(50, len(model.feature_names()))
        scores = select_k_best(model.apply(work), target, model.feature_names(), k)
        model.selected = [r["feature"] for r in scores.filter("selected").orderBy("position").collect()]
    return model


def fit_transform(df: DataFrame, target: str | None = None, options: PrepOptions = PrepOptions(),
                  roles: Roles = Roles(), keep=()) -> tuple[DataFrame, PrepModel]:
    """Fit, then transform the fitting data (outliers removed as in the
    reference). ``keep`` passes extra columns through (e.g. an id)."""
    model = fit(df, target, options, roles)
    return model.apply(df, keep, remove_outliers=True), model


def _positions(model: PrepModel, out: DataFrame) -> DataFrame:
    """``out`` with the position of each wide column's category among the
    columns that one-hot encoding would make; -1 has none of them."""
    for c in model.wide():
        value = F.coalesce(F.col(c), F.lit(model.cat_fill[c]).cast(out.schema[c].dataType))
        place = model.index[c].withColumnRenamed("position", f"{c}_position")
        out = lookup_join(out.withColumn(c, value), place, c)
    return out


def _projection(model: PrepModel, out: DataFrame, keep) -> list[Column]:
    exprs: list[Column] = [F.col(k) for k in keep]
    for c in model.numeric:
        x = F.coalesce(F.col(c).cast("double"), F.lit(model.num_fill[c]))
        if model.options.normalize:
            x = (x - F.lit(model.num_mean[c])) / F.lit(model.num_std[c] or 1.0)
        exprs.append(x.alias(c))
    for c in model.wide():
        exprs.append(F.coalesce(f"{c}_position", F.lit(-1)).cast("bigint").alias(f"{c}_position"))
    for c in (model.categorical if model.options.encode_categorical else []):
        if c in model.index:
            continue
        v = F.coalesce(F.col(c), F.lit(model.cat_fill[c]).cast(out.schema[c].dataType))
        for cat in model.categories[c][1:]:
            exprs.append(F.when(v == F.lit(cat), 1.0).otherwise(0.0).alias(f"{c}_{_py_str(cat)}"))
    if model.target and model.target in out.columns:
        exprs.append(F.col(model.target))
    return exprs


def column_transform(df: DataFrame, numeric, categorical, strategy: str = "mean/mode", normalize: bool = True,
                     keep=(), target: str | None = None, fit_df: DataFrame | None = None) -> DataFrame:
    """ColumnTransformer equivalent with explicit column lists — numeric
    branch (impute → scale) then categorical branch (mode → one-hot drop
    first); everything else dropped."""
    params = fit_params(fit_df if fit_df is not None else df, numeric, categorical, strategy)
    model = PrepModel(target, PrepOptions(normalize=normalize), Roles(), [], list(numeric), list(categorical),
                      **params)
    return _positions(model, df).select(*_projection(model, df, keep))


# ---------------------------------------------------------------- single steps

def impute(df: DataFrame, cols, strategy: str = "mean") -> DataFrame:
    """Fill NULLs with the column mean, median (exact) or mode
    (smallest value on ties). The statistics are one-row scalar subqueries,
    so the result stays a single lazy plan."""
    from wardstats.functions.joins import with_scalars

    if strategy == "mean":
        st = df.agg(*[F.avg(F.col(c)).alias(f"_f_{c}") for c in cols])
    elif strategy == "median":
        st = grouped(df, [], *[percentile_of(c, 0.5).alias(f"_f_{c}") for c in cols])
    elif strategy in ("mode", "most_frequent"):
        # counts per value first, then the most frequent (the smallest of equal ones): no task holds a column's values
        st = None
        for c in cols:
            counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
            one = counts.agg(F.min(F.struct(-F.col("_n"), F.col(c).alias("v")))["v"].alias(f"_f_{c}"))
            st = one if st is None else with_scalars(st, one)
    else:
        raise ValueError(strategy)
    j = with_scalars(df, st)
    if strategy in ("mean", "median"):  # numeric result, as the reference's float output
        new = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_f_{c}").cast("double")) for c in cols}
    else:
        new = {c: F.coalesce(F.col(c), F.col(f"_f_{c}").cast(df.schema[c].dataType)) for c in cols}
    return j.withColumns(new).drop(*st.columns)


def forward_fill(df: DataFrame, cols, key: str, ts: str, tie: str | None = None, bucket: str = "day") -> DataFrame:
    """carry the last non-NULL value forward within ``key`` in ``ts``
    order (ties by ``tie``).

    Skew-safe two-level scan: rows are windowed per (key, time bucket), so a
    hot key is spread over its buckets; the last value of every earlier
    bucket comes from a small per-(key, bucket) summary scanned with a
    window over buckets only."""
    order = [F.col(ts)] + ([F.col(tie)] if tie else [])
    # one struct as key: a NULL key or time in it is equal to another
    d = df.withColumn("_k", F.struct(F.col(key).alias("key"), F.date_trunc(bucket, F.col(ts)).alias("bucket")))
    okey = F.struct(*order)
    summ = d.groupBy("_k").agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(okey.alias("o"), F.col(c).alias("v")))).alias(f"_l_{c}")
        for c in cols])
    wprev = Window.partitionBy("_k.key").orderBy("_k.bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select("_k", *[F.last(F.col(f"_l_{c}.v"), ignorenulls=True).over(wprev).alias(f"_c_{c}")
                                       for c in cols])
    win = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # the summary has one row per (key, bucket): a shuffle join on exactly the
    # window's partition keys, so the rows are exchanged once for both
    filled = d.join(carry.hint("shuffle_merge"), "_k", "left")
    return filled.withColumns({c: F.coalesce(F.last(F.col(c), ignorenulls=True).over(win), F.col(f"_c_{c}"))
                               for c in cols}).drop("_k", *[f"_c_{c}" for c in cols])


def standard_scale(df: DataFrame, cols, fit_df: DataFrame | None = None) -> DataFrame:
    """(x − mean) / std₀ with statistics from ``fit_df`` (e.g. the
    training split); a zero std yields 0 (sklearn scales by 1)."""
    from wardstats.functions.joins import with_scalars

    src = fit_df if fit_df is not None else df
    st = src.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), std0(c).alias(f"_s_{c}"))])
    j = with_scalars(df, st)
    new = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
           for c in cols}
    return j.withColumns(new).drop(*st.columns)


def one_hot(df: DataFrame, cols, categories: dict | None = None, max_categories: int = 100,
            drop_first: bool = True, keep_source: bool = False) -> DataFrame:
    """F8: one-hot with sorted categories, first dropped, unknown/NULL → all
    zeros, names ``{col}_{value}``. Categories are passed in or learned. A
    column with more than ``max_categories`` levels becomes ``{col}_position``,
    the position among those columns (-1: none of them, NULL included)."""
    wide: list = []
    if categories is None:
        nd = {r["column_name"]: r["n_distinct"] for r in distinct_counts(df, cols).collect()} if cols else {}
        wide = [c for c in cols if nd[c] > max_categories]
        few = [c for c in cols if c not in wide]
        row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in few]).first() if few else {}
        categories = {c: list(row[c]) for c in few}
    out = df
    for c in wide:
        values = df.select(c).where(F.col(c).isNotNull()).distinct()
        shift = 1 if drop_first else 0
        place = distributed_rank(values, c).select(c, (F.col("_rank") - shift).cast("bigint").alias(f"{c}_position"))
        out = lookup_join(out, settled(place), c).withColumn(f"{c}_position", F.coalesce(f"{c}_position", F.lit(-1).cast("bigint")))
    new = {}
    for c in cols:
        cats = categories.get(c, [])
        for v in cats[1:] if drop_first else cats:
            new[f"{c}_{_py_str(v)}"] = F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0)
    out = out.withColumns(new)
    return out if keep_source else out.drop(*cols)


def distributed_rank(values: DataFrame, c: str, partitions: int | None = None) -> DataFrame:
    """0-based position of each distinct value of ``values[c]`` in sorted
    order without a single-partition window: the values are range-partitioned
    and sorted, each partition numbers its own rows, and a partition-sized
    table of prefix offsets (one row per partition) turns local numbers into
    global ones. The ranged values are checkpointed (shared checkpoint
    folder) so counts and numbers come from the same partitioning."""
    from wardstats.functions.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(values.sparkSession)
    n = partitions or values.sparkSession.sparkContext.defaultParallelism
    ranged = values.repartitionByRange(n, c).sortWithinPartitions(c) \
        .withColumn("_pid", F.spark_partition_id()).checkpoint()
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_pid").orderBy(c)) - 1)
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the window runs over `partitions` rows only
    offsets = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return local.join(F.broadcast(offsets), "_pid").select(c, (F.col("_off") + F.col("_i")).alias("_rank"))


def ordinal_encode(df: DataFrame, cols) -> DataFrame:
    """category → 0-based position in sorted order, NULL stays NULL. The
    code table is one row per distinct value, numbered by
    :func:`distributed_rank` and joined back; of few values it is broadcast,
    so that no task gets all rows of one value."""
    out = df
    for c in cols:
        values = df.select(c).where(F.col(c).isNotNull()).distinct()
        codes = settled(distributed_rank(values, c).select(c, F.col("_rank").cast("double").alias(f"_code_{c}")))
        out = lookup_join(out, codes, c).withColumn(c, F.col(f"_code_{c}")).drop(f"_code_{c}")
    return out


def one_hot_sparse(df: DataFrame, col: str, id_col: str, drop_first: bool = True) -> DataFrame:
    """F8 for any number of categories: the non-zero cells of the one-hot
    matrix as rows (id, position, value). Positions are those of the columns
    that :func:`one_hot` would make (sorted categories, the first dropped);
    NULLs and the dropped category have no cell."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    first = 1 if drop_first else 0
    codes = distributed_rank(values, col).select(col, (F.col("_rank") - first).cast("bigint").alias("position"))
    cells = lookup_join(df.select(id_col, col), codes.where("position >= 0"), col, how="inner")
    return cells.select(id_col, "position", F.col(col).alias("value"))


def select_k_best(df: DataFrame, target: str, features, k: int | None = None) -> DataFrame:
    """univariate F-test of a linear fit per feature, F = r²/(1−r²)·(n−2)
    (sklearn ``f_regression``), infinite for a perfect fit (r² = 1 but for
    rounding); top ``k`` (default min(50, n)) selected."""
    k = k or min(50, len(features))
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[corr(f, target).alias(f) for f in features])
    stack = "stack({}, {}) as (feature, r)".format(len(features), ", ".join(f"'{f}', `{f}`" for f in features))
    long = wide.selectExpr("_n", stack)
    r2 = F.col("r") * F.col("r")
    fstat = F.when(r2 >= 1 - PERFECT, F.lit(float("inf"))).otherwise(F.round(r2 / (1 - r2) * (F.col("_n") - 2), 9))
    w = Window.orderBy(F.desc_nulls_last("f_score"), "feature")
    ranked = long.select("feature", r6("r").alias("r"), fstat.alias("f_score")) \
        .withColumn("position", F.row_number().over(w))
    return ranked.select("feature", "r", r6("f_score").alias("f_score"), "position",
                         (F.col("position") <= k).alias("selected"))


def preprocess_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """rows and columns before vs after preprocessing (one row)."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    from wardstats.functions.joins import with_scalars

    out = with_scalars(b, a)
    return out.select("rows_before", "rows_after", F.lit(len(before.columns)).alias("columns_before"),
                      F.lit(len(after.columns)).alias("columns_after"))
