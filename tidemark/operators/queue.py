"""Queues, locks and lookups as plans: who may claim, what expires, what is still fresh.  `sources.versions` lets only one of several writers apply a plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import stale
from tidemark.functions.rules import first_match
from tidemark.sources.scratch import folder

TERMINAL = ("completed", "failed", "limited", "cancelled")


def ordered_places(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in one order over the whole table, without a window over it.

    Rows are dealt to tasks by ranges of the order and ranked there; the sums of what the ranges
    before hold, one row for each, are added.  ``order`` should decide between all rows.
    """
    path = folder(rows.sparkSession, "ordered")
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(path)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    here = dealt.withColumn("_here", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return here.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_here")).drop("_part", "_here", "_before")


def claim_by_id(jobs: DataFrame, requests: DataFrame, as_of: Column, stale_seconds: int, most_running: int) -> DataFrame:
    """``requests`` (external_id, worker) with job_id and outcome: the newest job of each id is returned if it has ended, left to a live holder, renewed for its own, or claimed while there are free slots.

    ``jobs`` has job_id, external_id, status, locked_by, locked_at and created_at; stale leases
    have ended before anything is claimed.  Waiting jobs get the ``most_running`` slots less those
    that run, one each, in the order of external ids: k free slots make exactly k claims, where
    so many wait.  A worker's own running job keeps its slot unless more run than may.  An id asked
    for by several workers goes to the first by name; for the others it is held.
    """
    most = max(1, most_running)
    expired = (F.col("status") == "running") & stale(F.col("locked_at"), as_of, stale_seconds)
    now = jobs.withColumn("status", F.when(expired, "failed").otherwise(F.col("status")))
    running = now.where("status = 'running'").count()
    newest = now.groupBy("external_id").agg(F.max_by(F.struct("job_id", "status", "locked_by"), F.struct("created_at", "job_id")).alias("j"))
    first = F.row_number().over(Window.partitionBy("external_id").orderBy("worker"))
    own = (F.col("j.status") == "running") & (F.col("j.locked_by") == F.col("worker"))
    rows = requests.join(newest, "external_id", "left").withColumn("_own", F.coalesce(own, F.lit(False))).withColumn("_first", first)
    told = first_match([
        (F.col("j").isNull(), "not_found"), (F.col("j.status").isin(*TERMINAL), "returned"), ((F.col("j.status") == "running") & ~F.col("_own"), "held"),
        (F.col("_own"), "claimed" if running <= most else "no_slot"), (F.col("_first") > 1, "held"),
    ])
    rows = rows.select("external_id", "worker", F.col("j.job_id").alias("job_id"), told.alias("outcome"))
    waiting = ordered_places(rows.where("outcome is null").select("external_id", "worker", "job_id"), [F.col("external_id"), F.col("worker")])
    granted = waiting.select("external_id", "worker", "job_id", F.when(F.col("place") <= most - running, "claimed").otherwise("no_slot").alias("outcome"))
    return rows.where("outcome is not null").unionByName(granted)


def claim_next(jobs: DataFrame, worker: str, as_of: Column, stale_seconds: int, most_running: int) -> DataFrame:
    """``jobs`` (job_id, status, priority, queued_at, created_at, locked_by, locked_at, attempts) after one worker asked for the next one.

    Stale leases fail; if fewer than ``most_running`` run, the waiting job that comes first by
    priority, time of queueing (null last), creation and id is the worker's.  With none, nothing else changes.
    """
    expired = (F.col("status") == "running") & stale(F.col("locked_at"), as_of, stale_seconds)
    gone = lambda c, new: F.when(F.col("_expired"), new).otherwise(F.col(c)).alias(c)
    none = F.lit(None)
    changed = {"status": "failed", "locked_by": none, "locked_at": none}
    now = jobs.withColumn("_expired", F.coalesce(expired, F.lit(False))).select(*[gone(c, changed[c]) if c in changed else F.col(c) for c in jobs.columns])
    free = max(1, most_running) - now.where("status = 'running'").count()
    idle = F.col("locked_at").isNull() | stale(F.col("locked_at"), as_of, stale_seconds)
    order = [F.col("priority"), F.col("queued_at").asc_nulls_last(), F.col("created_at"), F.col("job_id")]
    next_ = now.where((F.col("status") == "pending") & idle).orderBy(*order).limit(1 if free > 0 else 0).select("job_id", F.lit(True).alias("_mine"))
    mine = {"status": F.lit("running"), "locked_by": F.lit(worker), "locked_at": as_of, "attempts": F.coalesce("attempts", F.lit(0)) + 1}
    rows = now.join(F.broadcast(next_), "job_id", "left")
    return rows.select(*[F.when(F.col("_mine"), mine[c]).otherwise(F.col(c)).alias(c) if c in mine else F.col(c) for c in jobs.columns])


def claim_with_fallback(tables: Sequence[tuple[str, DataFrame]], worker: str, as_of: Column, stale_seconds: int, most_running: int) -> tuple[str, DataFrame] | None:
    """The first of several queues in which the worker gets a job, by its name, and that queue afterwards; None where all are empty or full."""
    for name, jobs in tables:
        after = claim_next(jobs, worker, as_of, stale_seconds, most_running)
        held = lambda df: df.where((F.col("status") == "running") & (F.col("locked_by") == worker)).count()
        if held(after) > held(jobs.where(~stale(F.col("locked_at"), as_of, stale_seconds))):
            return name, after
    return None


def recover_runs(runs: DataFrame, as_of: Column, stale_seconds: int) -> DataFrame:
    """``runs`` (status, started_at) with stale running ones failed."""
    gone = (F.col("status") == "running") & stale(F.col("started_at"), as_of, stale_seconds)
    return runs.withColumn("status", F.when(gone, "failed").otherwise(F.col("status")))


def with_lock(counts: DataFrame, name: str) -> DataFrame:
    """``counts`` (status, n), one row for each status, with whether a new run may start or conflicts with one that is running."""
    busy = F.max(F.when((F.col("status") == "running") & (F.col("n") > 0), 1)).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn(name, F.when(busy == 1, "conflict").otherwise("acquired"))


def latest_within(rows: DataFrame, keys: Sequence[str], at: str, tie: str, as_of: Column, seconds: int) -> DataFrame:
    """The newest row of each key that is at most ``seconds`` old: what a cache with that time to live would give."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    alive = rows.where((micros <= F.unix_micros(as_of)) & (micros >= F.unix_micros(as_of) - seconds * 1_000_000))
    others = [c for c in rows.columns if c not in keys]
    best = alive.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(at), F.col(tie))).alias("_row"))
    return best.select(*keys, "_row.*")


def pending(starts: DataFrame, ends: DataFrame, key: str, as_of: Column, seconds: int) -> DataFrame:
    """The starts (key, at) of the last ``seconds`` after which their key has no end."""
    micros, now = F.unix_micros(F.col("at").cast("timestamp")), F.unix_micros(as_of)
    open_ = starts.where((micros <= now) & (micros > now - seconds * 1_000_000))
    last_end = ends.groupBy(key).agg(F.max("at").alias("_end"))
    return open_.join(last_end, key, "left").where(F.col("_end").isNull() | (F.col("_end") < F.col("at"))).drop("_end")


def updated_from(rows: DataFrame, source: DataFrame, key: str, column: str, mapping: dict[str, str]) -> DataFrame:
    """``rows`` with ``column`` set from the joined ``source`` (key, column) through ``mapping``; unmapped and unmatched ones stay."""
    new = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.col("_new"))
    joined = rows.join(source.select(key, F.col(column).alias("_new")), key, "left")
    return joined.withColumn(column, F.coalesce(new, F.col(column))).drop("_new")


def frontier(links: DataFrame, seeds: DataFrame, depth: int, most: int) -> DataFrame:
    """seed, node and depth: what a crawl of each seed visits in ``depth`` rounds, the ``most`` best of a seed by score, then depth.

    ``links`` has source, target and score, ``seeds`` a column seed.  Each round is one join and
    one grouped minimum; a node counts at its least depth.
    """
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(float("inf")).alias("score"))
    edge = seen
    for k in range(1, depth + 1):
        step = edge.select("seed", F.col("node").alias("source")).join(links, "source").groupBy("seed", F.col("target").alias("node")).agg(F.max("score").alias("score"))
        edge = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(k).alias("depth"), "score")
        seen = seen.unionByName(edge)
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.col("score").desc(), "depth", "node"))
    return seen.withColumn("_place", place).where(F.col("_place") <= most).select("seed", "node", "depth")
