"""Keyed state as batch plans: first and last sightings, status transitions, leases, trailing windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import stale
from tidemark.functions.rules import first_match

STATUSES = ("active", "closed", "restricted", "unreachable", "invalid", "discovered", "stale", "ignored")
# For each new status the old ones that stay against it.
KEEPS = {
    "active": ("closed",), "closed": (), "restricted": ("active", "closed"), "unreachable": ("closed", "restricted", "ignored", "stale"),
    "invalid": ("active", "closed", "restricted"), "discovered": ("invalid", "ignored", "stale", "active", "closed", "restricted"),
    "stale": ("closed", "restricted"), "ignored": ("stale",),
}


def next_status(old: Column, new: Column) -> Column:
    """What a link's status becomes: definite states win, and closed, restricted or set-aside ones stay as each case says."""
    rules = [((new == status) & (old.isin(*kept) if kept else F.lit(False)), old) for status, kept in KEEPS.items()]
    return first_match([(new.isNull(), old), (old.isNull(), new), *rules], new)


def fold_status(events: DataFrame, keys: Sequence[str], at: str, tie: str, status: str, span: Column | None = None) -> DataFrame:
    """The status of each key after all its events in order, by `next_status`; it depends on the order, so it is a fold and no maximum.

    ``span`` is a column that never falls as ``at`` rises, such as its day.  The events of a key
    and span become one map from every status before to that after; a key's few maps are then
    composed in order, so a hot key is spread over tasks by its spans.  An unknown status counts as null.
    """
    names = F.array(*[F.lit(x) for x in STATUSES])
    number = F.when(F.col(status).isNotNull(), F.array_position(names, F.col(status))).cast("int")
    # Rows: the new status; columns: the old one; 0 stands for none.
    table = [list(range(len(STATUSES) + 1))]
    table += [[new if k == 0 or STATUSES[k - 1] not in KEEPS[name] else k for k in range(len(STATUSES) + 1)] for new, name in enumerate(STATUSES, 1)]
    steps = F.array(*[F.array(*[F.lit(x) for x in row]) for row in table])
    part = F.lit(0) if span is None else span
    pieces = events.select(*keys, part.alias("_span"), F.struct(at, tie, F.coalesce(number, F.lit(0)).alias("to")).alias("_e"))
    pieces = pieces.groupBy(*keys, "_span").agg(F.array_sort(F.collect_list("_e")).alias("_line"))
    same = F.array(*[F.lit(k) for k in range(len(STATUSES) + 1)])
    after = F.aggregate("_line", same, lambda m, e: F.transform(m, lambda s: F.get(F.get(steps, e["to"]), s)))
    line = pieces.select(*keys, F.struct("_span", after.alias("to")).alias("_m")).groupBy(*keys).agg(F.array_sort(F.collect_list("_m")).alias("_maps"))
    folded = F.aggregate("_maps", F.lit(0), lambda s, m: F.get(m["to"], s))
    return line.select(*keys, F.get(names, folded - 1).alias(status))


def sightings(events: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """first_seen, last_seen and seen_count of each key."""
    return events.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("seen_count"))


def merge_sightings(state: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``state`` (keys, first_seen, last_seen, seen_count) after another batch of the same form."""
    both = state.unionByName(batch)
    return both.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"))


def trailing_count(events: DataFrame, key: str, at: str, seconds: int, name: str = "in_window") -> DataFrame:
    """``events`` with the number of the key's events in the ``seconds`` up to and with each one."""
    micros = F.unix_micros(F.col(at))
    window = Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return events.withColumn(name, F.count("*").over(window))


def claim_plan(jobs: DataFrame, as_of: Column, stale_seconds: int, most_running: int) -> DataFrame:
    """job_id and action: stale running jobs expire, and the next waiting ones are claimed while fewer than ``most_running`` run.

    A plan, not a lock: Spark has no atomic claim, so one writer applies it.
    """
    running = F.col("status") == "running"
    expired = running & stale(F.col("locked_at"), as_of, stale_seconds)
    alive = jobs.where(running & ~expired).count()
    order = [F.col("priority"), F.col("queued_at").asc_nulls_last(), F.col("created_at"), F.col("job_id")]
    claimed = jobs.where(F.col("status") == "pending").orderBy(*order).limit(max(0, most_running - alive)).select("job_id", F.lit("claim").alias("action"))
    return jobs.where(expired).select("job_id", F.lit("expire").alias("action")).unionByName(claimed)
