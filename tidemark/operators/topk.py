"""Ranked selection: capped classes, slots, diversity and budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped_classes(df: DataFrame, key: str, caps: Mapping[str, int], total: int, order: Sequence[Column], unique: str) -> DataFrame:
    """``df`` with ``taken``: of each class in turn the first rows up to its cap, and up to what the ones before leave of ``total``.

    Classes are found in one pass: counts tell how many of each are taken before any row is
    ranked, and only rows that may be taken are ranked at all.
    """
    counts = {r[key]: r.n for r in df.where(F.col(key).isin(*caps)).groupBy(key).agg(F.count("*").alias("n")).collect()}
    left, taken = total, {}
    for name, cap in caps.items():
        taken[name] = max(0, min(cap, left, counts.get(name, 0)))
        left -= taken[name]
    parts = [df.where(F.col(key) == name).orderBy(*order).limit(n).select(unique) for name, n in taken.items() if n]
    if not parts:
        return df.withColumn("taken", F.lit(False))
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    marked = chosen.withColumn("taken", F.lit(True))
    return df.join(marked, unique, "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def diverse_pick(df: DataFrame, key: str, order: Sequence[Column], most: int) -> DataFrame:
    """``most`` rows: the first of every ``key`` before any second one, each in ``order``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    few = df.withColumn("_place", place).where(F.col("_place") <= most)
    return few.orderBy(F.when(F.col("_place") == 1, 0).otherwise(1), *order).limit(most).drop("_place")


def admit(df: DataFrame, order: Sequence[Column], slots: int, daily: int, unique: str) -> DataFrame:
    """``df`` with ``outcome``: the first min(slots, daily) rows are ``admitted``, others wait for a slot or for another day."""
    most = max(0, min(slots, daily))
    first = df.orderBy(*order).limit(most).select(unique).withColumn("_in", F.lit(True))
    outcome = F.when(F.col("_in"), "admitted").otherwise("daily_limit" if daily <= slots else "no_slot")
    return df.join(first, unique, "left").withColumn("outcome", outcome).drop("_in")
