"""Streams over landed event files.  Each run reads what is there, keeps its state in checkpoints and ends.

The same builders serve a stream that never ends: leave out ``available_now``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.select import first_per_key
from tidemark.operators.state import merge_sightings, sightings
from tidemark.sources.scratch import folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LIMIT, SPAN_SECONDS = 2, 6 * 3600


def event_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 4) -> DataFrame:
    """Event files as they land, with ``at``, their event time."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def finished(writer, spark: SparkSession, name: str) -> None:
    """Run a stream writer over what there is, with its checkpoint in the shared folder."""
    writer.option("checkpointLocation", folder(spark, f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()


def first_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and kind; keys already seen are held in state."""
    out = folder(spark, "first-keys")
    rows = event_stream(spark, sf_dir).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type", "event_id")
    finished(rows.writeStream.format("parquet").option("path", out).outputMode("append"), spark, "first-keys")
    return spark.read.parquet(out)


def hourly(spark: SparkSession, sf_dir: str, late: str = "40 days") -> DataFrame:
    """Counts and sums of hourly windows by kind; each batch writes the windows it changed, and the last word counts."""
    out = folder(spark, "hourly")
    total = F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long"))
    rows = event_stream(spark, sf_dir).withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), total.alias("total"))
    rows = rows.select(F.col("w.start").cast("timestamp_ntz").alias("starts"), "event_type", "n", "total")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    finished(rows.writeStream.foreachBatch(write).outputMode("update"), spark, "hourly")
    written = spark.read.parquet(out).drop("part")
    return first_per_key(written, ["starts", "event_type"], [F.col("batch").desc()]).drop("batch")


def sightings_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, first_seen, last_seen, seen_count; batch n merges into version n and writes n + 1, so a repeat gives the same."""
    out = folder(spark, "sightings")
    last = [0]

    def merge(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        now = sightings(batch, ["user_id"], "ts")
        if batch_id:
            now = merge_sightings(own.read.parquet(f"{out}/version={batch_id}"), now, ["user_id"])
        now.write.mode("overwrite").parquet(f"{out}/version={batch_id + 1}")
        last[0] = batch_id + 1

    finished(event_stream(spark, sf_dir).writeStream.foreachBatch(merge), spark, "sightings")
    return spark.read.parquet(f"{out}/version={last[0]}")
