"""Time, queues, versions, sketches and streams over the given tables: joins in time, calls by name, sources and sinks of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import queue, sketches, temporal
from tidemark.plans.base import query, table
from tidemark.plans.collection import moment
from tidemark.sources import calls, hits, versions
from tidemark.sources.scratch import folder

ORDER_AT = "TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 7919) % 2592000)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers as states and intervals within the month that the events span."""
    seconds = (F.col("o_orderkey") * 7919) % 2_592_000
    at = F.timestamp_micros(F.unix_micros(moment("2024-01-01")) + seconds * 1_000_000)
    until = F.timestamp_micros(F.unix_micros(at) + (F.floor("o_totalprice").cast("long") % 100_000) * 1_000_000)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderstatus", at.alias("since"), until.alias("until"))


@query(f"""WITH o AS (SELECT o_custkey AS user_id, o_orderkey, o_orderstatus, {ORDER_AT} AS since FROM orders)
SELECT event_id, o.o_orderkey AS order_key, o.o_orderstatus AS status FROM events e ASOF LEFT JOIN (SELECT user_id, since, max_by(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_orderkey) AS o_orderkey FROM o GROUP BY ALL) o ON e.user_id = o.user_id AND e.ts >= o.since""")
def state_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The order that was the last of its customer at the moment of each event."""
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    found = temporal.as_of(events, _orders(spark, d).drop("until"), ["user_id"], "at", "since", "o_orderkey")
    return found.select("event_id", F.col("state.o_orderkey").alias("order_key"), F.col("state.o_orderstatus").alias("status"))


@query(f"""WITH o AS (SELECT o_custkey AS user_id, o_orderkey, {ORDER_AT} AS since, {ORDER_AT} + to_seconds(floor(o_totalprice)::BIGINT % 100000) AS until FROM orders)
SELECT event_id, o_orderkey AS order_key FROM events e JOIN o ON e.user_id = o.user_id AND e.ts >= o.since AND e.ts < o.until""")
def events_within_orders(spark: SparkSession, d: str) -> DataFrame:
    """Events beside the orders of their user in whose interval they fall."""
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
    met = temporal.within_intervals(events, _orders(spark, d), ["user_id"], "at", "since", "until")
    return met.select(F.col("point.event_id").alias("event_id"), F.col("interval.o_orderkey").alias("order_key"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS exact_ids, TRUE AS ids_close, TRUE AS median_close, TRUE AS tail_close FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-19' GROUP BY 1""")
def sketch_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Two weeks from daily sketches, held against the exact counts and ranks of the same rows: 2 % of ids, 2 % of ranks."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    daily = sketches.daily_sketches(events, F.col("day"), ["event_type"], "user_id", "value")
    first, last = F.lit("2024-01-05").cast("date"), F.lit("2024-01-19").cast("date")
    rough = sketches.merged(daily, ["event_type"], first, last, (0.5, 0.95))
    within = events.where(F.col("day").between(first, last)).join(rough.select("event_type", "p50", "p95"), "event_type")
    exact = within.groupBy("event_type").agg(
        F.count_distinct("user_id").alias("exact_ids"), F.avg((F.col("value") < F.col("p50")).cast("int")).alias("below50"), F.avg((F.col("value") <= F.col("p50")).cast("int")).alias("upto50"),
        F.avg((F.col("value") < F.col("p95")).cast("int")).alias("below95"), F.avg((F.col("value") <= F.col("p95")).cast("int")).alias("upto95"),
    )
    rows = rough.join(exact, "event_type")
    close = lambda p, name: ((F.col(f"below{name}") <= p + 0.02) & (F.col(f"upto{name}") >= p - 0.02))
    return rows.select("event_type", "n", "exact_ids", (F.abs(F.col("distinct_ids") - F.col("exact_ids")) <= 0.02 * F.col("exact_ids")).alias("ids_close"), close(0.5, "50").alias("median_close"), close(0.95, "95").alias("tail_close"))


JOBS = "CASE WHEN value > 80 THEN 'running' WHEN value > 20 THEN 'pending' ELSE 'completed' END"


@query(f"""WITH j AS (SELECT event_type AS queue, event_id AS job_id, {JOBS} AS status, user_id % 3 AS priority, ts FROM events WHERE ts < TIMESTAMP '2024-01-20 12:00:00'),
k AS (SELECT *, status = 'running' AND ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 43200 SECONDS AS gone FROM j), f AS (SELECT queue, count(*) FILTER (WHERE status = 'running' AND NOT gone) AS running FROM k GROUP BY 1)
SELECT queue, job_id, 'expire' AS action, NULL AS worker FROM k WHERE gone UNION ALL
SELECT queue, job_id, 'claim', 'w7' FROM (SELECT k.queue, job_id, running, row_number() OVER (PARTITION BY k.queue ORDER BY priority, ts, job_id) AS r FROM k JOIN f USING (queue) WHERE status = 'pending') WHERE r <= 25 - running""")
def claims_by_call(spark: SparkSession, d: str) -> DataFrame:
    """Who gets the free slots of each queue, by a function of that name called from SQL."""
    calls.register(spark)
    status = F.expr(JOBS)
    jobs = table(spark, d, "events").where(F.col("ts").cast("timestamp") < moment("2024-01-20 12:00:00")).select(
        F.col("event_type").alias("queue"), F.col("event_id").alias("job_id"), status.alias("status"), (F.col("user_id") % 3).alias("priority"), F.col("ts").alias("queued_at"), F.col("ts").alias("locked_at")
    )
    jobs.withColumn("running", (F.col("status") == "running").cast("int")).createOrReplaceTempView("waiting_jobs")
    return spark.sql("SELECT * FROM claim_next(TABLE(waiting_jobs) PARTITION BY queue ORDER BY (running DESC, priority, queued_at, job_id), 'w7', TIMESTAMP_NTZ '2024-01-20 12:00:00', 43200, 25)")


@query("""WITH j AS (SELECT event_id AS job_id, CASE WHEN value > 99 THEN 'running' ELSE 'pending' END AS status, (user_id % 3)::INTEGER AS priority, ts FROM events WHERE event_type = 'signup'),
p AS (SELECT job_id, row_number() OVER (ORDER BY priority, ts, job_id) AS r FROM j WHERE status = 'pending'), f AS (SELECT 3 + count(*) FILTER (WHERE status = 'running') AS most, count(*) FILTER (WHERE status = 'running') AS running FROM j)
SELECT 3 AS versions, job_id, 'w' || r AS locked_by FROM p, f WHERE r <= 3 AND running + r <= most""")
def claims_by_version(spark: SparkSession, d: str) -> DataFrame:
    """Three workers ask one after the other for the next job; each claim is a version of the queue that only one writer can make."""
    at = F.lit("2024-02-20 00:00:00").cast("timestamp")
    events = table(spark, d, "events").where("event_type = 'signup'")
    jobs = events.select(
        F.col("event_id").alias("job_id"), F.when(F.col("value") > 99, "running").otherwise("pending").alias("status"), (F.col("user_id") % 3).cast("int").alias("priority"), F.col("ts").cast("timestamp").alias("queued_at"),
        F.col("ts").cast("timestamp").alias("created_at"), F.lit(None).cast("string").alias("locked_by"), F.lit(None).cast("timestamp").alias("locked_at"), F.lit(0).alias("attempts"),
    )
    most = 3 + jobs.where("status = 'running'").count()
    root = folder(spark, "queue")
    for k in (1, 2, 3):
        ask = lambda held, k=k: {"jobs": queue.claim_next(held.get("jobs", jobs), f"w{k}", at, 120, most)}
        versions.update(spark, root, ask, f"claim of w{k}")
    after = versions.read_version(spark, root)["jobs"]
    return after.where("locked_by is not null").select(F.lit(len(versions.versions(spark, root))).alias("versions"), "job_id", "locked_by")


@query("""SELECT r_name AS region, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, 2 AS version FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def snapshot_of_tables(spark: SparkSession, d: str) -> DataFrame:
    """Eight tables made visible at once: a first version with four, a second with all, and a repeat of it that changes nothing; then read back."""
    root = folder(spark, "snapshot")
    names = ("region", "nation", "customer", "orders", "supplier", "part", "benchmark", "labels")
    tables = {n: table(spark, d, n) for n in names}
    versions.write_version(spark, root, {n: tables[n].limit(0) for n in names[:4]}, "first")
    for _ in range(2):
        number = versions.write_version(spark, root, tables, "all")
    t = versions.read_version(spark, root)
    rows = t["region"].join(t["nation"], F.col("n_regionkey") == F.col("r_regionkey")).join(t["customer"], F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t["orders"], F.col("o_custkey") == F.col("c_custkey"), "left")
    counts = rows.groupBy(F.col("r_name").alias("region")).agg(F.count_distinct("n_nationkey").alias("nations"), F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"))
    return counts.withColumn("version", F.lit(number))


HITS_SQL = """SELECT source, count(*) AS n, count(DISTINCT title) AS titles, min(published) AS first_at FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'news' ELSE 'blog' END AS source, 'q' || page_id % 4 AS query,
  trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g')) AS title, url, TIMESTAMP '2024-01-01' + to_hours(page_id % 500) AS published FROM pages) WHERE title <> '' """


def _landed(spark: SparkSession, d: str) -> str:
    """Pages as search hits, in files by kind of source."""
    from tidemark.functions.text import page_title

    root = folder(spark, "hits")
    source = F.element_at(F.array(F.lit("web"), F.lit("news"), F.lit("blog")), (F.col("page_id") % 3 + 1).cast("int"))
    at = F.date_format(F.timestamp_micros(F.unix_micros(moment("2024-01-01")) + (F.col("page_id") % 500) * 3_600_000_000), "yyyy-MM-dd'T'HH:mm:ssXXX")
    rows = table(spark, d, "pages").select(source.alias("source"), F.concat(F.lit("q"), (F.col("page_id") % 4).cast("string")).alias("query"), page_title(F.col("html")).alias("title"), "url", at.alias("published"))
    rows.write.partitionBy("source").json(root)
    return root


@query(HITS_SQL + "AND source IN ('web', 'blog') AND query = 'q1' GROUP BY 1")
def hits_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Landed search hits of two kinds and one query, both filters pushed to the files."""
    hits.register(spark)
    rows = spark.read.format("hits").load(_landed(spark, d)).where("source in ('web', 'blog') and query = 'q1'")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"), F.min("published").cast("timestamp_ntz").alias("first_at"))


@query(HITS_SQL + "GROUP BY 1")
def hits_stream(spark: SparkSession, d: str) -> DataFrame:
    """All landed search hits, by a stream over their files."""
    from tidemark.streaming.runs import finished

    hits.register(spark)
    out = folder(spark, "hits-seen")
    finished(spark.readStream.format("hits").load(_landed(spark, d)).writeStream.format("parquet").option("path", out).outputMode("append"), spark, "hits-seen")
    rows = spark.read.schema(hits.SCHEMA).parquet(out)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"), F.min("published").cast("timestamp_ntz").alias("first_at"))
