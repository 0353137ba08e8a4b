"""Joins in time: the last row at or before each moment, and the intervals around it, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 32


def micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def as_of(rows: DataFrame, states: DataFrame, keys: Sequence[str], at: str, since: str, tie: str, span_seconds: int = 86_400) -> DataFrame:
    """``rows`` with ``state``: of the ``states`` of the same keys the last one whose ``since`` is not after ``at``, as a struct; null where there is none.

    Both go into one line for each key and span of time, in which the last state is carried
    forward; what earlier spans leave is carried over between spans, one row for each, so a hot
    key is spread over its spans and no pair is compared.  Of states at one moment the last by ``tie`` counts.

    Null moments or keys find nothing; states with a null ``since`` don't count; an empty table of
    states gives nulls.
    """
    span = span_seconds * 1_000_000
    held = F.struct(*[F.col(f"`{c}`") for c in states.columns])
    empty = F.lit(None)
    place = F.floor(F.col("_at") / span).alias("_span")
    left = rows.select(*keys, micros(at).alias("_at"), F.lit(1).alias("_kind"), empty.cast(states.schema[tie].dataType).alias("_tie"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), F.lit(None).cast(states.select(held.alias("s")).schema["s"].dataType).alias("_state"))
    right = states.where(F.col(since).isNotNull()).select(*keys, micros(since).alias("_at"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), empty.cast(left.schema["_row"].dataType).alias("_row"), held.alias("_state"))
    both = left.where(F.col("_at").isNotNull()).unionByName(right).select("*", place)
    line = Window.partitionBy(*keys, "_span").orderBy("_at", "_kind", "_tie")
    within = both.withColumn("_here", F.last("_state", ignorenulls=True).over(line)).where("_kind = 1")
    last = right.select("*", place).groupBy(*keys, "_span").agg(F.max_by("_state", F.struct("_at", "_tie")).alias("_left"))
    spans = both.select(*keys, "_span").distinct().join(last, [*keys, "_span"], "left")
    before = F.last("_left", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.select(*keys, "_span", before.alias("_before")).where("_before is not null")
    found = within.join(carried, [*keys, "_span"], "left").select("_row.*", F.coalesce("_here", "_before").alias("state"))
    lost = left.where(F.col("_at").isNull()).select("_row.*", F.col("_state").alias("state"))
    return found.unionByName(lost)


def cells(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """(level, cell) of the fewest cells of widths 1, 2, 4, ... that together are [low, high): at most two of each width."""
    up = lambda l: F.shiftright(low + F.shiftleft(F.lit(1).cast("long"), l) - 1, l)  # noqa: E731, E741
    down = lambda l: F.shiftright(high, l)  # noqa: E731, E741
    cell = lambda l, c, ok: F.when(ok, F.struct(F.lit(l).alias("level"), c.alias("cell")))  # noqa: E731, E741
    each = [x for l in range(levels) for x in (cell(l, up(l), (up(l) < down(l)) & (up(l) % 2 != 0)), cell(l, down(l) - 1, (up(l) < down(l)) & (down(l) % 2 != 0)))]  # noqa: E741
    return F.array_compact(F.array(*each))


def within_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, unit_seconds: int = 3600) -> DataFrame:
    """Every row of ``points`` beside every row of ``intervals`` with equal keys and start <= at < end, as columns ``point`` and ``interval``.

    An interval is cut into cells of ``unit_seconds`` times powers of two, a few dozen however
    long it is; a point looks up the one cell of each width that it lies in, for the widths that
    occur, so the join is by equality and meets only what overlaps up to a unit.

    Null keys, moments or ends match nothing; intervals that end before they start are empty; an
    empty table gives no rows.
    """
    unit = unit_seconds * 1_000_000
    low, high = F.floor(micros(start) / unit).cast("long"), (F.floor((micros(end) - 1) / unit) + 1).cast("long")
    cut = intervals.where(micros(start) < micros(end)).select(*keys, F.struct("*").alias("interval"), F.explode(cells(low, high)).alias("_c"))
    cut = cut.select(*keys, "interval", F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell"))
    occurring = sorted(r[0] for r in cut.select("_level").distinct().collect())  # at most LEVELS numbers
    lookup = F.array(*[F.struct(F.lit(l).alias("level"), F.shiftright(F.floor(micros(at) / unit).cast("long"), l).alias("cell")) for l in occurring or [0]])  # noqa: E741
    asked = points.where(F.col(at).isNotNull()).select(*keys, F.struct("*").alias("point"), F.explode(lookup).alias("_c"))
    asked = asked.select(*keys, "point", F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell"))
    moment = lambda c, n: F.unix_micros(F.col(c)[n].cast("timestamp"))
    met = asked.join(cut, [*keys, "_level", "_cell"])
    return met.where((moment("interval", start) <= moment("point", at)) & (moment("point", at) < moment("interval", end))).select("point", "interval")
