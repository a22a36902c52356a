"""Joining statistics back to row-sized tables without unbounded broadcasts.

Global (key-less) aggregates are one row by construction and are attached
with a scalar subquery (`DataFrame.scalar()`), which Catalyst evaluates once
and folds into the projection; several scalar subqueries over the same
aggregate are merged into one job by Catalyst's `MergeScalarSubqueries`.

Keyed statistics (one row per group) are joined with :func:`lookup_join`; the
engine decides between broadcast and shuffle from the size it measures. It
measures after it has dealt the big side by key, so that a few groups leave a
few tasks, whatever their size: statistics that may have few groups go through
:func:`settled` first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstats.functions.session import ensure_checkpoint_dir

#: A settled table is broadcast up to this many bytes.
BROADCAST_BYTES = 32 << 20


def settled(small: DataFrame, row_bytes: int = 256) -> DataFrame:
    """``small`` computed once, into the shared checkpoint folder, and to be
    broadcast if its counted rows of ``row_bytes`` stay below
    ``BROADCAST_BYTES``; else the join shuffles both sides."""
    ensure_checkpoint_dir(small.sparkSession)
    rows = BROADCAST_BYTES // row_bytes
    kept = small.checkpoint()
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join ``small`` (one row per key) to ``big`` (row-sized) on equal keys,
    NULL keys being equal to each other. Nothing runs or stays cached here:
    Spark broadcasts the small side if its measured size allows, and splits
    skewed partitions of the shuffle join otherwise."""
    keys = [on] if isinstance(on, str) else list(on)
    renamed = small.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return big.join(renamed, cond, how).drop(*[f"_key_{k}" for k in keys])


def with_scalars(df: DataFrame, stats: DataFrame, names=None) -> DataFrame:
    """Attach the columns of a one-row ``stats`` frame to every row of ``df``
    as scalar subqueries (no join, no broadcast of data-sized input)."""
    names = list(names or stats.columns)
    packed = stats.select(F.struct(*names).alias("_s")).scalar()
    return df.select("*", *[packed.getField(n).alias(n) for n in names])
