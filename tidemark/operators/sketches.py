"""Sketches that add up: distinct counts and quantiles by day, merged for any range of days without going back to the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct counts err by 1.04 / sqrt(2 ** this), 0.4 % on average; ranks of quantiles by about 1.3 % with K of 200, 0.35 % with 800.
DISTINCT_BITS, QUANTILE_K = 16, 800


def daily_sketches(rows: DataFrame, day: Column, keys: Sequence[str], id_: str, value: str) -> DataFrame:
    """day, keys, n, ids and values: for each day and key the number of rows, a sketch of distinct ids and one of values.

    Sketches are added up before the shuffle and have a bounded size, so a hot key costs one row
    a task.  Null ids and values don't count; a group without any has null sketches.
    """
    return rows.groupBy(day.alias("day"), *keys).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(id_), F.lit(DISTINCT_BITS)).alias("ids"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_K)).alias("values"),
    )


def merged(daily: DataFrame, keys: Sequence[str], first: Column, last: Column, points: Sequence[float]) -> DataFrame:
    """keys, n, distinct_ids and a column pNN for each of ``points``: over the days from ``first`` to ``last``, both included."""
    within = daily.where(F.col("day").between(first, last))
    sums = within.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("values").alias("values"))
    quantiles = [F.kll_sketch_get_quantile_double("values", F.lit(float(p))).alias(f"p{round(100 * p)}") for p in points]
    return sums.select(*keys, "n", F.hll_sketch_estimate("ids").alias("distinct_ids"), *quantiles)
