"""One row, or a few, for each key: latest, best by rank, first distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should end in a unique column."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def latest_per_key(df: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """The row with the greatest ``at`` of each key, the smallest ``tie`` among equals; a null ``at`` comes last.

    Rows are reduced before they are shuffled: only a struct of all columns travels, once for
    each key and task, so a key that holds most rows costs no more than others.
    """
    columns = [c for c in df.columns if c not in keys]
    whole = F.struct(F.col(at).isNotNull().alias("_has"), F.col(at).alias("_at"), *[F.col(c) for c in columns])
    ordered = F.struct(F.col(at).isNotNull(), F.col(at), -F.col(tie))
    best = df.groupBy(*keys).agg(F.max_by(whole, ordered).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def best_by_rank(df: DataFrame, keys: Sequence[str], rank: Column, value: str, name: str) -> DataFrame:
    """For each key the ``value`` with the least rank, the smallest value among equals."""
    return df.groupBy(*keys).agg(F.min(F.struct(rank.alias("r"), F.col(value).alias("v")))["v"].alias(name))


def first_distinct(df: DataFrame, keys: Sequence[str], value: str, name: str, most: int = 3) -> DataFrame:
    """For each key its ``most`` smallest distinct values, joined by commas; nulls don't count."""
    once = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    few = once.withColumn("_place", place).where(F.col("_place") <= most)
    return few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias(name))
