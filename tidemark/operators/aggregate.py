"""Dense counts, shares and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import percent
from tidemark.sources.scratch import folder


def dense_counts(df: DataFrame, key: Column, domain: Sequence[str], name: str = "key", rest: str | None = None) -> DataFrame:
    """One row for each value of ``domain``, with its number of rows, 0 where there are none; other values count as ``rest`` or not at all."""
    spark: SparkSession = df.sparkSession
    wanted = [*domain, rest] if rest and rest not in domain else list(domain)
    known = F.when(key.isin(*domain), key)
    counts = df.select((F.coalesce(known, F.lit(rest)) if rest else known).alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    keys = spark.createDataFrame([(k, v) for v, k in enumerate(wanted)], f"{name} string, place int")
    return keys.join(F.broadcast(counts), name, "left").select(name, "place", F.coalesce("n", F.lit(0)).alias("n"))


def with_share(counts: DataFrame, count: str, name: str = "share") -> DataFrame:
    """``counts`` with each row's percentage of the sum of ``count``; for tables that are already aggregated."""
    total = counts.agg(F.sum(count).alias("_total"))
    return counts.join(F.broadcast(total)).withColumn(name, percent(F.col(count), F.col("_total"))).drop("_total")


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float], parts: int = 200) -> DataFrame:
    """Percentiles by nearest rank: the value at place ceil(p n), exact and from the values themselves; nulls don't count.

    Values are counted, a key's counts are dealt to ``parts`` ranges by rough quantiles, and
    only the range in which a place falls is put in order: no task holds all values of a key.
    """
    rows = df.where(F.col(value).isNotNull())
    bounds = rows.groupBy(*keys).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10 * parts).alias("_bounds"))
    path = folder(df.sparkSession, "rank-bounds")
    bounds.write.parquet(path)
    bounds = df.sparkSession.read.schema(bounds.schema).parquet(path)
    same = reduce(lambda s, k: s & F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")), keys, F.lit(True))
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n")).alias("c").join(bounds.alias("b"), same)  # written before, so Spark knows its size
    below = F.size(F.filter("_bounds", lambda b: b < F.col(f"c.{value}")))
    counts = counts.select(*[F.col(f"c.{k}").alias(k) for k in keys], F.col(f"c.{value}").alias(value), "_n", below.alias("_part"))
    line = Window.partitionBy(*keys).orderBy("_part")
    sums = counts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_here"))
    sums = sums.withColumn("_until", F.sum("_here").over(line)).withColumn("_all", F.sum("_here").over(Window.partitionBy(*keys)))
    places = F.array(*[F.struct(F.lit(f"p{round(100 * p)}").alias("name"), F.ceil(F.lit(p) * F.col("_all")).alias("place")) for p in points])
    hit = F.filter(places, lambda x: (x["place"] <= F.col("_until")) & (x["place"] > F.col("_until") - F.col("_here")))
    wanted = sums.withColumn("_hit", hit).where(F.size("_hit") > 0).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), (F.col("_until") - F.col("_here")).alias("_before"), "_hit")
    both = reduce(lambda s, k: s & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.col("_part") == F.col("_p"))
    within = counts.join(wanted, both).withColumn("_until", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value)))
    reached = lambda name: F.min(F.when(F.exists("_hit", lambda x: (x["name"] == name) & (x["place"] <= F.col("_until"))), F.col(value)))
    return within.groupBy(*keys).agg(*[reached(f"p{round(100 * p)}").alias(f"p{round(100 * p)}") for p in points])
