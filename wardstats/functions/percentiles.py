"""Exact percentiles of large groups without one task per group.

A percentile needs two neighbouring order statistics. One aggregate sketches
every group (``percentile_approx``, memory bounded by its accuracy) and so
brackets each wanted percentile between two values of the group. That cuts
the values into segments, brackets and the gaps between them. A second pass
counts the values, those inside brackets by themselves, all others of a gap
together; both are pre-aggregated per task, so that at most some
``4 / ACCURACY`` of a group's rows per percentile stay distinct.

Ranks are found in two levels. Segment totals, a few rows per group, give each
segment's offset and so name the one segment that holds a wanted rank; inside
a bracket cumulative counts name the value. No window spans more than one
bracket's values, and rows are never multiplied by the percentiles.
Interpolation is linear (NumPy's default). Results don't depend on the
accuracy."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstats.functions.joins import lookup_join, settled

#: Accuracy of the sketch that brackets percentiles.
ACCURACY = 10_000
#: More than one aggregate has percentiles.
WIDTH = 100_000


@dataclass(frozen=True)
class Percentile:
    """A wanted percentile (or a list) of a column, as an aggregate of
    :func:`grouped`; NULL and NaN-free doubles are taken, NULLs ignored."""

    value: Column
    probs: tuple
    single: bool
    name: str = ""
    digits: int | None = None

    def alias(self, name: str) -> "Percentile":
        return replace(self, name=name)

    def rounded(self, digits: int) -> "Percentile":
        return replace(self, digits=digits)


def percentile_of(value, probs) -> Percentile:
    single = not isinstance(probs, (list, tuple))
    return Percentile(F.col(value) if isinstance(value, str) else value, (float(probs),) if single else tuple(map(float, probs)), single)


def _attached(big: DataFrame, small: DataFrame, keys: list) -> DataFrame:
    """``big`` with the one other column of ``small``, by key or as a scalar."""
    if keys:
        return lookup_join(big, small, keys)
    return big.select("*", small.scalar().alias(small.columns[0]))


def _below(x: Column):
    return lambda end: end < x


def grouped(df: DataFrame, keys, *aggs) -> DataFrame:
    """``df.groupBy(*keys).agg(*aggs)`` where aggregates may be
    :class:`Percentile`; a NULL key is a group like any other."""
    wanted = [a for a in aggs if isinstance(a, Percentile)]
    plain = [a for a in aggs if not isinstance(a, Percentile)]
    keys = list(keys)
    if not wanted:
        return df.groupBy(*keys).agg(*plain) if keys else df.agg(*plain)
    margin = 2.0 / ACCURACY
    several = range(len(wanted))
    probs = [sorted(set(w.probs)) for w in wanted]
    rows = df.withColumns({f"_x{i}": w.value.cast("double") for i, w in enumerate(wanted)})
    sketches = []
    for i in several:
        ends = [max(0.0, p - margin) for p in probs[i]] + [min(1.0, p + margin) for p in probs[i]]
        sketches.append(F.percentile_approx(f"_x{i}", ends, ACCURACY).alias(f"_s{i}"))
    first = rows.groupBy(*keys).agg(*plain, *sketches)
    if keys and not df.isStreaming:  # few groups must not leave few tasks
        first = settled(first, 256 + sum(16 * len(p) for p in probs) + 32 * len(plain))
    brackets = [e for i in several for e in (F.slice(f"_s{i}", 1, len(probs[i])).alias(f"_lo{i}"), F.slice(f"_s{i}", len(probs[i]) + 1, len(probs[i])).alias(f"_hi{i}"))]
    spread = _attached(rows.select(*keys, *[f"_x{i}" for i in several]), first.select(*keys, F.struct(*brackets).alias("_ends")), keys)
    # both ends of brackets grow with the percentile: the first that ends at x or later is the only one to look into
    cells = []
    for i in several:
        x = F.col(f"_x{i}")
        if len(probs[i]) <= 8:
            gap = sum((F.when(F.col(f"_ends._hi{i}")[j] < x, 1).otherwise(0) for j in range(len(probs[i]))), F.lit(0))
        else:
            gap = F.size(F.filter(f"_ends._hi{i}", _below(x)))
        inside = F.coalesce(F.get(F.col(f"_ends._lo{i}"), gap) <= x, F.lit(False))
        cells.append(F.struct(F.lit(i).alias("_i"), (2 * gap + inside.cast("int")).alias("_segment"), F.when(inside, x).alias("_v"), x.alias("_x")))
    values = spread.select(*keys, F.inline(F.array(*cells))).where("_x IS NOT NULL")
    few = values.groupBy(*keys, "_i", "_segment", "_v").agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    group = Window.partitionBy(*keys, "_i")
    totals = few.groupBy(*keys, "_i", "_segment").agg(F.sum("_c").alias("_c"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    totals = totals.withColumn("_off", F.sum("_c").over(group.orderBy("_segment")) - F.col("_c")).withColumn("_n", F.sum("_c").over(group))
    # the ranks on either side of each percentile, where the segment holds them
    at = F.lit(None)
    for i in several:
        at = F.when(F.col("_i") == i, F.array(*[F.lit(p) for p in probs[i]])).otherwise(at)

    def rank(p: Column, j: Column, upper: bool) -> Column:
        place = (F.col("_n") - 1) * p
        return F.struct(j.alias("_j"), F.lit(upper).alias("_upper"), (F.ceil(place) if upper else F.floor(place)).alias("_k"), (place - F.floor(place)).alias("_w"))

    ranks = F.concat(F.transform(at, lambda p, j: rank(p, j, False)), F.transform(at, lambda p, j: rank(p, j, True)))
    asked = totals.withColumn("_ranks", F.filter(ranks, lambda r: (F.col("_off") <= r["_k"]) & (r["_k"] < F.col("_off") + F.col("_c")))).where(F.size("_ranks") > 0)
    # a bracket has a row per value, a gap one row, of which only its ends are ever asked for
    inside = F.sum("_c").over(Window.partitionBy(*keys, "_i", "_segment").orderBy("_v"))
    held = few.select(*keys, "_i", "_segment", "_c", "_low", "_high", inside.alias("_inside"))
    placed = lookup_join(held, asked.select(*keys, "_i", "_segment", "_off", "_ranks"), [*keys, "_i", "_segment"], "inner")
    begin, end = F.col("_off") + F.col("_inside") - F.col("_c"), F.col("_off") + F.col("_inside")
    found = placed.select(*keys, "_i", "_low", "_high", begin.alias("_begin"), F.inline(F.filter("_ranks", lambda r: (begin <= r["_k"]) & (r["_k"] < end))))
    found = found.withColumn("_value", F.when(F.col("_k") == F.col("_begin"), F.col("_low")).otherwise(F.col("_high")))
    found = found.groupBy(*keys, "_i", "_j").agg(F.max(F.when(~F.col("_upper"), F.col("_value"))).alias("_a"), F.max(F.when(F.col("_upper"), F.col("_value"))).alias("_b"), F.max("_w").alias("_w"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")
    entry = F.struct((F.col("_i") * WIDTH + F.col("_j")).alias("key"), value.alias("_value"))
    told = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_told"))  # an entry per percentile
    columns = []
    for i, w in enumerate(wanted):
        parts = [F.try_element_at("_told", F.lit(i * WIDTH + probs[i].index(p))) for p in w.probs]
        parts = parts if w.digits is None else [F.round(x, w.digits) for x in parts]
        columns.append((parts[0] if w.single else F.array(*parts)).alias(w.name))
    out = _attached(first.drop(*[f"_s{i}" for i in several]), told, keys)
    return out.select(*[c for c in out.columns if c != "_told"], *columns)
