"""Unions and differences by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_key(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All rows, each key once: that of the first frame that has it."""
    columns = [c for c in frames[0].columns if c not in keys]
    parts = [f.select(*keys, F.struct(F.lit(k).alias("_k"), *columns).alias("_row")) for k, f in enumerate(frames)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    first = both.groupBy(*keys).agg(F.min("_row").alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in frames[0].columns])


def append_missing(base: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` and the rows of ``more`` whose keys it lacks."""
    return base.unionByName(more.join(base.select(*keys).distinct(), list(keys), "left_anti").select(*base.columns))


def without(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of ``base`` whose keys none of ``others`` has; a null key never matches."""
    for other in others:
        base = base.join(other.select(*keys).distinct(), list(keys), "left_anti")
    return base
