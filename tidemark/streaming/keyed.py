"""State of one key over a stream, with Spark's state API: a limit on starts and a cache whose entries end."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.scratch import folder
from tidemark.streaming.runs import LIMIT, SPAN_SECONDS, event_stream, finished

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """Keep state in RocksDB, which the state API needs, while a stream starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int]]:
    """(micros, event_id) of a key's rows in one batch, in order; a batch has as many as its files hold, which the trigger bounds."""
    yield from sorted((int(m), int(e)) for part in rows for m, e in zip(part["micros"], part["event_id"], strict=True))


class Limiter(StatefulProcessor):
    """Admits a start if fewer than ``limit`` admitted ones lie in the span before it.

    State is a list of the admitted times that still count, ``limit`` at most; a timer drops it
    once the watermark has passed them, so users that stay away leave nothing.
    """

    def __init__(self, limit: int, span_seconds: int) -> None:
        self.limit, self.span = limit, span_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent, out = [r[0] for r in self.recent.get()], []
        for at, event in in_order(rows):
            recent = [r for r in recent if r > at - self.span]
            out.append((event, key[0], len(recent) < self.limit))
            if out[-1][2]:
                recent.append(at)
        self.recent.put([(r,) for r in recent])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if recent:
            self.handle.registerTimer((recent[-1] + self.span) // 1000 + 1)
        yield pd.DataFrame(out, columns=["event_id", "user_id", "admitted"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "user_id": pd.Series(dtype="int64"), "admitted": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


class Cache(StatefulProcessor):
    """A lookup is a hit while the entry that the last miss made is at most ``seconds`` old; a timer drops entries that have ended."""

    def __init__(self, seconds: int) -> None:
        self.ttl = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        made, out = self.made.get()[0] if self.made.exists() else None, []
        for at, event in in_order(rows):
            hit = made is not None and at <= made + self.ttl
            made = made if hit else at
            out.append((event, key[0], hit))
        self.made.update((made,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((made + self.ttl) // 1000 + 1)
        yield pd.DataFrame(out, columns=["event_id", "key", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.made.clear()
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "key": pd.Series(dtype="str"), "hit": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def processed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, name: str) -> DataFrame:
    """All rows of a stream (key, event_id, micros, at) through a processor, once for each file that has landed."""
    spark = rows.sparkSession
    out = folder(spark, name)
    with rocks(spark):
        told = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
        finished(told.writeStream.format("parquet").option("path", out).outputMode("append"), spark, name)
    return spark.read.schema(schema).parquet(out)


def limited(spark: SparkSession, sf_dir: str, limit: int = LIMIT, span_seconds: int = SPAN_SECONDS, late: str = "40 days") -> DataFrame:
    """event_id, user_id, admitted: a limit on starts in a sliding window.  Refused starts don't count, so no window frame can say it."""
    rows = event_stream(spark, sf_dir).withWatermark("at", late).select("user_id", "event_id", F.unix_micros("at").alias("micros"), "at")
    return processed(rows, "user_id", Limiter(limit, span_seconds), "event_id long, user_id long, admitted boolean", "limited")


def cached(spark: SparkSession, sf_dir: str, seconds: int, late: str = "40 days") -> DataFrame:
    """event_id, key, hit: lookups of a user's kind of event in a cache with that time to live."""
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key")
    rows = event_stream(spark, sf_dir).withWatermark("at", late).select(key, "event_id", F.unix_micros("at").alias("micros"), "at")
    return processed(rows, "key", Cache(seconds), "event_id long, key string, hit boolean", "cached")


def unanswered(spark: SparkSession, sf_dir: str, start: str, end: str, seconds: int, late: str) -> DataFrame:
    """event_id, user_id, answer: each start beside the ends of its user within ``seconds``, null where there is none, as the watermark lets a stream know it.

    The state of either side ends ``seconds`` and ``late`` after a row, whatever the stream's length.
    """
    out = folder(spark, "unanswered")
    events = event_stream(spark, sf_dir)
    left = events.where(F.col("event_type") == start).select("event_id", "user_id", F.col("at").alias("began")).withWatermark("began", late)
    right = events.where(F.col("event_type") == end).select(F.col("event_id").alias("answer"), F.col("user_id").alias("_user"), F.col("at").alias("ended")).withWatermark("ended", late)
    near = (F.col("user_id") == F.col("_user")) & (F.col("ended") >= F.col("began")) & (F.col("ended") <= F.col("began") + F.expr(f"interval {seconds} seconds"))
    rows = left.join(right, near, "leftOuter").select("event_id", "user_id", "began", "answer")
    finished(rows.writeStream.format("parquet").option("path", out).outputMode("append"), spark, "unanswered")
    return spark.read.schema("event_id long, user_id long, began timestamp, answer long").parquet(out)


def sessions(spark: SparkSession, sf_dir: str, gap: str, late: str) -> DataFrame:
    """user_id, starts, n: sessions that end after ``gap`` without an event; each batch writes what it changed and the last word on a session counts."""
    out = folder(spark, "sessions")
    rows = event_stream(spark, sf_dir).withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    rows = rows.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("starts"), "n")
    finished(rows.writeStream.format("parquet").option("path", out).outputMode("append"), spark, "sessions")
    return spark.read.schema("user_id long, starts timestamp_ntz, n long").parquet(out)
