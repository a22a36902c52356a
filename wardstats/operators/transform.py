"""Projections, filters and feature functions.

Everything here is a narrow projection or filter (no shuffle) except
:func:`group_complexity`, which is one partial aggregation plus a
size-checked lookup join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstats.functions.joins import lookup_join
from wardstats.functions.stats import eps_div, name_has, safe_div, std1
from wardstats.operators.profile import numeric_columns

# Identifier keywords, urgency scores, ordinal maps, bins.
ID_WORDS = ("id", "name")
URGENCY_SCORES = (("Low", 1), ("Medium", 2), ("High", 3), ("Critical", 4))
AGE_GROUP_INDEX = (("0 to 17", 1), ("18 to 29", 2), ("30 to 49", 3), ("50 to 69", 4), ("70 or Older", 5))
GENDER_INDEX = (("U", 0), ("F", 1), ("M", 2))
RISK_INDEX = (("Minor", 1), ("Moderate", 2), ("Major", 3), ("Extreme", 4))
EXPERIENCE_BANDS = ((0, 5, "Novice"), (5, 10, "Intermediate"), (10, 20, "Experienced"), (20, None, "Veteran"))
LOS_EDGES = (0, 5, 10, 20, 30, 50, 120)
CAPACITY_WORDS = ("patient", "visit", "case", "admission")


# ---------------------------------------------------------------- C1-C7

def id_columns(df: DataFrame, target: str | None = None, mode: str = "parity") -> list[str]:
    """Identifier-like columns. ``parity``: name contains 'id' or 'name'
    anywhere (so 'Resident' matches, as in the reference); ``word``: only as
    a whole word."""
    out = []
    for c in df.columns:
        if c == target:
            continue
        if mode == "parity":
            hit = name_has(c, ID_WORDS)
        else:
            hit = any(re.search(rf"(^|[^a-z]){w}([^a-z]|$)", c.lower()) for w in ID_WORDS)
        if hit:
            out.append(c)
    return out


def drop_id_columns(df: DataFrame, target: str | None = None, mode: str = "parity", extra=()) -> DataFrame:
    """Drop identifier columns (and an explicit list)."""
    return df.drop(*id_columns(df, target, mode), *extra)


def feature_subset(df: DataFrame, cols=None, default_n: int = 10, exclude=()) -> DataFrame:
    """C4: chosen features, or the first ``default_n`` columns."""
    cols = cols or [c for c in df.columns if c not in exclude][:default_n]
    return df.select(*cols)


def filter_keep_nulls(df: DataFrame, col: str, value) -> DataFrame:
    """``col != value`` keeping rows where ``col`` is NULL (pandas)."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(value)))


def dropna_subset(df: DataFrame, subset) -> DataFrame:
    """Drop rows with a NULL in any of ``subset``."""
    return df.dropna(subset=list(subset))


def replace_and_cast(df: DataFrame, col: str, literal: str = "120 +", replacement=120,
                     to: str = "int", lenient: bool = False) -> DataFrame:
    """Replace a literal, then cast (``try_cast`` when lenient)."""
    c = F.when(F.col(col) == literal, F.lit(str(replacement))).otherwise(F.col(col))
    return df.withColumn(col, c.try_cast(to) if lenient else c.cast(to))


def is_weekend_name(col: str, days=("Saturday", "Sunday")) -> Column:
    """Membership test on a day-name column."""
    return F.col(col).isin(list(days))


# ---------------------------------------------------------------- D1-D7

def timestamp_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def date_features(df: DataFrame, cols=None, drop_source: bool = True) -> DataFrame:
    """Hour, day_of_week (Monday = 0), month, quarter and is_weekend per
    timestamp column; the source column is dropped."""
    cols = cols if cols is not None else timestamp_columns(df)
    new = {}
    for c in cols:
        ts = F.col(c)
        new[f"{c}_hour"] = F.hour(ts)
        new[f"{c}_day_of_week"] = F.weekday(ts)
        new[f"{c}_month"] = F.month(ts)
        new[f"{c}_quarter"] = F.quarter(ts)
        new[f"{c}_is_weekend"] = (F.weekday(ts) >= 5).cast("int")
    out = df.withColumns(new)
    return out.drop(*cols) if drop_source else out


def ratio_features(df: DataFrame, nurse: str, specialists: str, beds: str, eps: float = 1e-6) -> DataFrame:
    """Staff efficiency ratio, beds per specialist (ε-guarded) and the
    patients-per-nurse copy of the nurse ratio."""
    return df.withColumns({
        "staff_efficiency_ratio": eps_div(nurse, specialists, eps),
        "beds_per_specialist": eps_div(beds, specialists, eps),
        "patients_per_nurse": F.col(nurse),
    })


def pairwise_ratios(df: DataFrame, exclude=(), eps: float = 1e-6) -> DataFrame:
    """For numeric columns with 'time' in the name, every pair i<j as
    ``{ci}_to_{cj}_ratio = ci / (cj + eps)``. ``exclude`` keeps the target out
    (the reference would include it)."""
    num = set(numeric_columns(df))
    tcols = [c for c in df.columns if "time" in c.lower() and c in num and c not in exclude]
    new = {f"{a}_to_{b}_ratio": eps_div(a, b, eps) for i, a in enumerate(tcols) for b in tcols[i + 1:]}
    return df.withColumns(new) if new else df


def capacity_utilization(df: DataFrame, beds: str) -> DataFrame:
    """First numeric column named patient/visit/case/admission ÷ beds
    (NULL instead of inf when beds is 0)."""
    num = numeric_columns(df)
    cands = [c for c in num if any(w in c.lower() for w in CAPACITY_WORDS)]
    if not cands:
        return df
    return df.withColumn("capacity_utilization", safe_div(F.col(cands[0]).cast("double"), F.col(beds)))


def map_lookup(col: str | Column, pairs, default=None) -> Column:
    """Dictionary lookup as a literal map (no join); ``default`` for misses."""
    m = F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])
    c = F.col(col) if isinstance(col, str) else col
    v = F.element_at(m, c)
    return v if default is None else F.coalesce(v, F.lit(default))


def urgency_numeric(df: DataFrame, col: str = "urgency_level", out: str = "urgency_numeric") -> DataFrame:
    """Low 1 … Critical 4, anything else (incl. NULL) 2."""
    return df.withColumn(out, F.coalesce(map_lookup(F.coalesce(F.col(col), F.lit("")), URGENCY_SCORES),
                                         F.lit(2)))


def ordinal_maps(df: DataFrame, age: str, gender: str, risk: str) -> DataFrame:
    """Dictionary encodings; unknown and NULL map to 0."""
    def enc(c, pairs):
        return F.coalesce(map_lookup(F.coalesce(F.col(c), F.lit("")), pairs), F.lit(0))

    return df.withColumns({age: enc(age, AGE_GROUP_INDEX), gender: enc(gender, GENDER_INDEX),
                           risk: enc(risk, RISK_INDEX)})


def group_complexity(df: DataFrame, target: str, group_cols=None, fit_df: DataFrame | None = None) -> DataFrame:
    """Std (ddof 1) of the target per group (NULL → 0), mapped back as
    ``{col}_complexity``. ``fit_df`` (e.g. the training split) supplies the
    statistics so test rows do not leak into them."""
    group_cols = group_cols or [c for c in df.columns if "region" in c.lower()]
    src = fit_df if fit_df is not None else df
    out = df
    for g in group_cols:
        st = src.groupBy(g).agg(F.coalesce(std1(target), F.lit(0.0)).alias(f"{g}_complexity"))
        out = lookup_join(out, st, g)
    return out


# ---------------------------------------------------------------- D10-D13

def staff_features(df: DataFrame, overtime: str, shift: str, experience: str, score: str,
                   previous: str, eps: float = 1e-5) -> DataFrame:
    """Overtime ratio, experience band (right-closed bins, values
    ≤ 0 get no band) and satisfaction change."""
    x = F.col(experience)
    band = None
    for lo, hi, label in EXPERIENCE_BANDS:
        cond = (x > lo) if hi is None else ((x > lo) & (x <= hi))
        band = F.when(cond, label) if band is None else band.when(cond, label)
    return df.withColumns({
        "overtime_ratio": eps_div(overtime, shift, eps),
        "experience_level": band,
        "satisfaction_change": F.col(score) - F.col(previous),
    })


def los_bins(df: DataFrame, col: str, edges=LOS_EDGES) -> DataFrame:
    """Right-closed bins over ``edges``; text label as the reference
    prints it ('(0- 5]', …, '(50- 120+]', 'nan' outside) and the numeric
    label (upper edge)."""
    x = F.col(col)
    text = num = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        cond = (x > lo) & (x <= hi)
        hi_txt = f"{hi}+" if hi == 120 else str(hi)
        lab = f"({lo}- {hi_txt}]"
        text = F.when(cond, lab) if text is None else text.when(cond, lab)
        num = F.when(cond, hi) if num is None else num.when(cond, hi)
    return df.withColumns({"los_bin": text.otherwise(F.lit("nan")), "los_label": num})
