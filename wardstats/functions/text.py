"""Text helpers that give byte-identical results on any engine.

Numbers inside text are formatted from integer arithmetic on
``floor(|x| * 10^d + 0.5)`` (round half up), which is exact IEEE arithmetic,
instead of a printf-style formatter whose tie rounding differs by engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardstats.functions.stats import col


def fmt_num(c, digits: int = 1) -> Column:
    """``x`` as fixed-point text with ``digits`` decimals (half up)."""
    c = col(c)
    scale = 10 ** digits
    t = F.floor(F.abs(c) * F.lit(float(scale)) + F.lit(0.5)).cast("bigint")
    sign = F.when((c < 0) & (t > 0), F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(t / F.lit(scale)).cast("bigint").cast("string")
    if digits == 0:
        return F.concat(sign, whole)
    frac = F.lpad((t % F.lit(scale)).cast("string"), digits, "0")
    return F.concat(sign, whole, F.lit("."), frac)


def fmt_pct(c, digits: int = 1) -> Column:
    """Fraction ``x`` as percent text, e.g. 0.1234 -> '12.3%'."""
    return F.concat(fmt_num(col(c) * F.lit(100.0), digits), F.lit("%"))


def fmt_num_sql(expr: str, digits: int = 1) -> str:
    """DuckDB twin of :func:`fmt_num`."""
    scale = 10 ** digits
    t = f"CAST(floor(abs({expr}) * {float(scale)}::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
    sign = f"(CASE WHEN ({expr}) < 0 AND {t} > 0 THEN '-' ELSE '' END)"
    whole = f"CAST({t} // {scale} AS VARCHAR)"
    if digits == 0:
        return f"({sign} || {whole})"
    frac = f"lpad(CAST({t} % {scale} AS VARCHAR), {digits}, '0')"
    return f"({sign} || {whole} || '.' || {frac})"


def fmt_pct_sql(expr: str, digits: int = 1) -> str:
    return f"({fmt_num_sql(f'({expr}) * 100.0::DOUBLE', digits)} || '%')"
