"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table, word_count
from tidemark.operators.queue import ordered_places

BLOCK_TOKENS, DOCS_PER_SHARD, SEED, WEIGHTS, MOST_REPEATS = 64, 10_000, "tidemark-mix-1", (5, 2, 1), 3
HASH_RANGE = float(1 << 60)
#: Ranges into which sources or quotients are counted at a time; so many rows of sums reach the driver.
BUCKETS = 512


def seeded_order(doc_id: Column, seed: str) -> Column:
    """60 bits of the md5 of the seed and the id: the place of a document in its source's seeded order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def buckets_of(rows: DataFrame, value: str, low: float, high: float, *sums: str) -> list[Row]:
    """Of the rows whose ``value`` lies in [low, high], in BUCKETS equal ranges: least and greatest value, count and ``sums``, in order of value."""
    part = F.least(F.floor((F.col(value) - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1)) if high > low else F.lit(0)
    held = rows.where(F.col(value).between(low, high)).groupBy(part.alias("part"))
    found = held.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]).collect()
    return sorted(found, key=lambda r: r.low)


def water_level(sources: DataFrame, everything: int, weights: int) -> float:
    """The level at which what sources take, their limit or the level times their weight if that is less, sums up to ``everything``.

    ``sources`` has ratio (limit by weight), limit and weight.  Sums by ranges of ratio tell in
    which range the level lies; that range is cut again until one ratio is left.
    """
    ends = sources.agg(F.min("ratio"), F.max("ratio")).first()
    taken = over = 0
    while True:
        for b in buckets_of(sources, "ratio", ends[0], ends[1], "limit", "weight"):
            reached = taken + b.limit + Fraction(b.high) * (weights - over - b.weight)
            if reached >= everything or b.high == ends[1]:
                break
            taken, over = taken + b.limit, over + b.weight
        if b.low == b.high:
            full = reached < everything  # then all have their limit
            return (everything - taken - (b.limit if full else 0)) / max(1, weights - over - (b.weight if full else 0))
        ends = (b.low, b.high)


def water_fill(sources: DataFrame, weights: Sequence[int], most_repeats: int) -> DataFrame:
    """``sources`` (source, source_size, n_docs) plus ordinal, weight and target.

    Sources in code point order, null last, take the weights in turn and share the sum of
    all sizes; a target stops at ``most_repeats`` times its source's size and what it gives
    up is shared again by weight, up to one level for all that are below their limit.  Neither
    their order nor the level needs all sources in one task.
    """
    placed = ordered_places(sources, [F.col("source").asc_nulls_last()], "ordinal")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("ordinal") - 1) % len(weights) + 1).cast("int"))
    limit = (F.col("source_size") * most_repeats).cast("long")
    ranked = materialise(placed.withColumn("weight", weight).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight")), "mix-limits")
    total = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = water_level(ranked, total.size, total.weight) if total.size is not None else 0.0
    target = F.when(F.col("ratio") < level, F.col("limit").cast("double")).otherwise(F.lit(float(level)) * F.col("weight"))
    return ranked.withColumn("target", target).select("source", "source_size", "n_docs", "ordinal", "target")


def apportioned(parties: DataFrame, key: str, votes: str, seats: int) -> DataFrame:
    """``parties`` plus ``quota``: the ``seats`` go to the highest quotients votes / (2 s - 1), ties to the smaller key.

    The divisor that settles m parties lies within m / 2 seats of votes / seats, so only the
    seats between two rounded bounds, about 2 m of them, are looked at; the last quotient that
    wins is found by counts in ranges, and only seats at that quotient are put in order.
    """
    sums = parties.agg(F.count("*").alias("m"), F.sum(votes).alias("total")).first()
    m, total, v = sums.m, sums.total or 0, F.col(votes)
    if not total:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    sure = F.when(v > 0, F.greatest(F.lit(0), F.ceil(v * (seats - m / 2) / total - 0.5) - 1)).otherwise(0).cast("long")
    open_to = F.when(v > 0, F.greatest(F.lit(0), F.floor(v * (seats + m / 2) / total + 0.5) + 1)).otherwise(0).cast("long")
    bounds = parties.withColumn("sure", sure).withColumn("open_to", open_to)
    left = seats - (bounds.agg(F.sum("sure")).first()[0] or 0)
    each = bounds.where("open_to > sure").select(F.col(key).alias("_key"), v.alias("v"), F.explode(F.sequence(F.col("sure") + 1, F.col("open_to"))).alias("seat"))
    each = materialise(each.select("_key", (F.col("v") / (2 * F.col("seat") - 1)).alias("quotient")), "mix-quotients")
    ends = each.agg(F.min("quotient"), F.max("quotient")).first()
    above = 0
    while left > 0 and ends[0] is not None:
        for b in reversed(buckets_of(each, "quotient", ends[0], ends[1])):
            if above + b.n >= left or b.low == ends[0]:
                break
            above += b.n
        ends = (b.low, b.high)
        if b.low == b.high:
            break
    last = F.lit(ends[0] if left > 0 else None).cast("double")
    tied = ordered_places(each.where(F.col("quotient") == last), [F.col("_key")], "place")
    won = each.where(F.col("quotient") > last).select("_key").unionByName(tied.where(F.col("place") <= left - above).select("_key"))
    won = won.groupBy("_key").agg(F.count("*").alias("won")).withColumnRenamed("_key", key)
    quota = (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota")
    return bounds.join(won, key, "left").select(*parties.columns, quota)


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """``parties`` plus ``quota``: each group's ``seats`` go to the highest quotients votes / (2 s - 1), ties to the smaller key.

    The divisor that settles a group of m parties lies within m / 2 seats of votes / seats, so
    only the seats between two rounded bounds, about 2 m of them, are ranked.
    """
    whole = Window.partitionBy(*group)
    v, n, m, total = F.col(votes), F.col(seats), F.count("*").over(whole), F.sum(votes).over(whole)
    sure = F.when(v > 0, F.greatest(F.lit(0), F.ceil(v * (n - m / 2) / total - 0.5) - 1)).otherwise(0).cast("long")
    open_to = F.when(v > 0, F.greatest(F.lit(0), F.floor(v * (n + m / 2) / total + 0.5) + 1)).otherwise(0).cast("long")
    bounds = parties.withColumn("sure", sure).withColumn("open_to", open_to).withColumn("left", n - F.sum("sure").over(whole))
    quotients = bounds.where("open_to > sure").select(
        *group, key, "left", v.alias("v"), F.explode(F.sequence(F.col("sure") + 1, F.col("open_to"))).alias("seat")
    )
    place = F.row_number().over(whole.orderBy((F.col("v") / (2 * F.col("seat") - 1)).desc(), key))
    won = quotients.withColumn("place", place).where("place <= left").groupBy(*group, key).agg(F.count("*").alias("won"))
    quota = (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota")
    return bounds.join(won, [*group, key], "left").select(*parties.columns, quota)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    block_tokens: int = BLOCK_TOKENS,
    docs_per_shard: int = DOCS_PER_SHARD,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    Blocks of ``block_tokens`` words go to sources, then to the shards of a source, by highest
    quotients.  A shard lines its documents up in seeded order and takes its quota of blocks
    from the front, all round as often as the quota asks.  A hot source has more shards, so no
    window holds more than about ``docs_per_shard`` rows.

    Null texts have size 0 and give 0; a null source is a source of its own, last in order;
    null or repeated ids share a place in the order and count as rows of their own; an empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        seeded_order(F.col("doc_id"), seed).alias("place"),
    )
    rows = materialise(rows, "mix-rows")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    filled = materialise(water_fill(materialise(totals, "mix-totals"), weights, most_repeats), "mix-targets")
    words = filled.agg(F.sum("source_size")).first()[0] or 0
    sources = apportioned(filled, "ordinal", "target", math.floor(words / block_tokens + 0.5))
    sources = materialise(
        sources.select("source", "source_size", "ordinal", "target", F.col("quota").alias("source_quota"), F.ceil(F.col("n_docs") / docs_per_shard).alias("n_shards")),
        "mix-sources",
    )
    shard = F.floor(F.col("place") / HASH_RANGE * F.col("n_shards")).cast("long")
    placed = rows.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("shard", shard)
    shards = placed.groupBy("ordinal", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = sainte_lague(shards, ["ordinal"], "shard", "shard_size", "source_quota")
    words = F.least(F.col("quota") * block_tokens, F.col("shard_size") * most_repeats)
    rounds = F.when(F.col("shard_size") > 0, F.floor(words / F.greatest(F.col("shard_size"), F.lit(1)))).otherwise(0).cast("long")
    shards = shards.withColumn("rounds", rounds).withColumn("rest", words - F.col("rounds") * F.col("shard_size"))
    line = Window.partitionBy("ordinal", "shard").orderBy("place", "size")
    until = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("until"), F.col("rest")) - F.col("until") + F.col("size"))
    return (
        placed.withColumn("until", until)
        .join(shards.select("ordinal", "shard", "rounds", "rest"), ["ordinal", "shard"])
        .select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix the whole ``documents`` table."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM r GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ordinal, source_size * {MOST_REPEATS} AS lim FROM s),
w AS (SELECT *, CASE (ordinal - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM o),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
f AS (SELECT *, CASE WHEN lim / weight < level THEN lim::DOUBLE
         ELSE max(CASE WHEN NOT lim / weight < level THEN level END) OVER () * weight END AS target FROM l),
n AS (SELECT floor(sum(source_size) / {BLOCK_TOKENS} + 0.5)::BIGINT AS blocks, max(target) AS most FROM f),
q AS (SELECT ordinal, seat, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, ordinal) AS place
      FROM (SELECT ordinal, target, unnest(range(1, ceil(target / {BLOCK_TOKENS})::BIGINT + 3)) AS seat FROM f WHERE target > 0)),
a AS (SELECT f.*, ceil(n_docs / {DOCS_PER_SHARD})::BIGINT AS n_shards,
         (SELECT count(*) FROM q, n WHERE q.ordinal = f.ordinal AND q.place <= n.blocks) AS quota FROM f),
p AS (SELECT r.*, a.source_size, a.target, a.ordinal, a.quota AS source_quota, floor(r.place / {HASH_RANGE:.1f} * a.n_shards)::BIGINT AS shard
      FROM r JOIN a ON r.source IS NOT DISTINCT FROM a.source),
h AS (SELECT ordinal, shard, sum(size)::BIGINT AS shard_size, any_value(source_quota) AS source_quota FROM p GROUP BY ALL),
hq AS (SELECT ordinal, shard, count(*) AS quota FROM (
        SELECT ordinal, shard, source_quota, row_number() OVER (PARTITION BY ordinal ORDER BY shard_size / (2 * seat - 1) DESC, shard) AS place
        FROM (SELECT *, unnest(range(1, source_quota + 1)) AS seat FROM h WHERE shard_size > 0)) WHERE place <= source_quota GROUP BY ALL),
t AS (SELECT h.*, least(coalesce(hq.quota, 0) * {BLOCK_TOKENS}, shard_size * {MOST_REPEATS}) AS words FROM h LEFT JOIN hq USING (ordinal, shard)),
u AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS rounds FROM t),
z AS (SELECT p.*, u.rounds, u.words - u.rounds * u.shard_size AS rest,
         sum(size) OVER (PARTITION BY p.ordinal, p.shard ORDER BY p.place, p.size ROWS UNBOUNDED PRECEDING) AS until
      FROM p JOIN u USING (ordinal, shard))
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(until, rest) - until + size))::BIGINT AS taken FROM z
"""
