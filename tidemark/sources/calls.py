"""Functions called by name from SQL that return tables: Python table functions over partitioned tables."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row


class ClaimNext:
    """For one queue, its running jobs first and then the waiting ones in order: the waiting ones that get a free slot.

    Called as ``claim_next(TABLE(jobs) PARTITION BY queue ORDER BY (running DESC, ...), worker, as_of,
    stale_seconds, most_running)``; jobs have queue, job_id, status and locked_at.  It holds two numbers,
    however long a queue is.  Stale leases come back as ``expire``.
    """

    def __init__(self) -> None:
        self.taken = 0

    def eval(self, job: Row, worker: str, as_of, stale_seconds: int, most_running: int) -> Iterator[tuple]:
        if job["status"] == "running":
            if job["locked_at"] is not None and job["locked_at"] < as_of - timedelta(seconds=max(stale_seconds, 30)):
                yield job["queue"], job["job_id"], "expire", None
            else:
                self.taken += 1
        elif job["status"] == "pending" and self.taken < max(1, most_running):
            self.taken += 1
            yield job["queue"], job["job_id"], "claim", worker


class Backoff:
    """The days on which a source is tried again, given a day, its base interval and how many failures may follow: one row for each."""

    def eval(self, day, base: int, failures: int) -> Iterator[tuple]:
        if day is None or base is None:
            return
        for k in range((failures or 0) + 1):
            wait = min(14, base * {0: 1, 1: 1, 2: 2, 3: 3}.get(k, 7)) if k else base
            day = day + timedelta(days=wait)
            yield k, day


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    spark.udtf.register("claim_next", udtf(ClaimNext, returnType="queue string, job_id bigint, action string, worker string"))
    spark.udtf.register("retry_days", udtf(Backoff, returnType="attempt int, day date"))
