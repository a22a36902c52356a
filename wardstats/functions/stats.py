"""Column-expression helpers shared by every operator.

All helpers return JVM-side Column expressions (no Python UDFs), so they stay
inside whole-stage codegen and partial (map-side) aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Doubles in operator outputs are rounded to this many digits so results are
# stable across engines (last-bit differences in sums and percentiles).
OUT_DIGITS = 6
# Thresholds (interpolated percentiles) are rounded before comparisons, so
# `x > p90` does not flip on the last float bit.
THRESHOLD_DIGITS = 9


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column, digits: int = OUT_DIGITS) -> Column:
    """Round a double for output."""
    return F.round(col(c).cast("double"), digits)


def thr(c):
    """Round a threshold (a column or a wanted percentile) before it is
    compared with row values."""
    if not isinstance(c, (str, Column)):
        return c.rounded(THRESHOLD_DIGITS)
    return F.round(col(c), THRESHOLD_DIGITS)


def std0(c: str | Column) -> Column:
    """Population standard deviation (NumPy ``np.std``, sklearn scalers)."""
    return F.stddev_pop(col(c))


def std1(c: str | Column) -> Column:
    """Sample standard deviation (pandas ``Series.std``)."""
    return F.stddev_samp(col(c))


def pct(c: str | Column, p, accuracy: int | None = None) -> Column:
    """Linear-interpolation percentile (NumPy default) as a plain aggregate.

    Its buffer holds one counter per distinct value of the group, so it is
    for small tables and low-cardinality columns; row-sized groups go through
    :func:`wardstats.functions.percentiles.grouped`. ``p`` is a fraction or a
    list; ``accuracy`` asks for the sketch ``percentile_approx`` instead."""
    if accuracy:
        return F.percentile_approx(col(c), p, accuracy)
    if isinstance(p, (list, tuple)):
        return F.percentile(col(c), F.array(*[F.lit(float(x)) for x in p]))
    return F.percentile(col(c), F.lit(float(p)))


def corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation; NULL where either side is constant (``F.corr``
    divides by zero there)."""
    a, b = col(a).cast("double"), col(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Division that yields NULL instead of raising (ANSI) or inf on zero."""
    return F.try_divide(col(a), col(b))


def eps_div(a: str | Column, b: str | Column, eps: float) -> Column:
    """``a / (b + eps)``: the reference's epsilon-guarded ratio."""
    return col(a) / (col(b) + F.lit(eps))


def share(cond: Column) -> Column:
    """Share of rows where ``cond`` holds (NULL counts as false)."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def name_has(name: str, words) -> bool:
    """Case-insensitive substring test on a column *name* (schema-level)."""
    low = name.lower()
    return any(w in low for w in words)
