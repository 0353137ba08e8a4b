"""Streams over landed files, run to their end: first sightings, limits by key, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.base import query


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the event stream, each once."""
    from tidemark.streaming.runs import first_keys

    return first_keys(spark, d).select("user_id", "event_type")


@query("""SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS n, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of the event stream by kind."""
    from tidemark.streaming.runs import hourly

    return hourly(spark, d)


@query("""SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen_count FROM events GROUP BY 1""")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """First and last sighting of each user, kept up to date batch by batch."""
    from tidemark.streaming.runs import sightings_state

    return sightings_state(spark, d)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT user_id, event_id, r, TRUE AS admitted, [us] AS recent FROM e WHERE r = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.r, len(list_filter(s.recent, lambda x: x > e.us - 21600000000)) < 2,
    CASE WHEN len(list_filter(s.recent, lambda x: x > e.us - 21600000000)) < 2 THEN list_append(list_filter(s.recent, lambda x: x > e.us - 21600000000), e.us) ELSE list_filter(s.recent, lambda x: x > e.us - 21600000000) END
  FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1) SELECT event_id, user_id, admitted FROM s""")
def stateful_limiter(spark: SparkSession, d: str) -> DataFrame:
    """Which starts of each user a limit in a sliding window admits."""
    from tidemark.streaming.keyed import limited

    return limited(spark, d)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT user_id, event_type, event_id, r, FALSE AS hit, us AS made FROM e WHERE r = 1 UNION ALL
  SELECT e.user_id, e.event_type, e.event_id, e.r, e.us <= s.made + 86400000000, CASE WHEN e.us <= s.made + 86400000000 THEN s.made ELSE e.us END FROM s JOIN e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.r = s.r + 1)
SELECT event_id, user_id || '/' || event_type AS key, hit FROM s""")
def ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    """Which lookups find what an earlier one left in a cache of one day."""
    from tidemark.streaming.keyed import cached

    return cached(spark, d, 86_400)


@query("""WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS answer, user_id, ts FROM events WHERE event_type = 'purchase'), m AS (SELECT max(ts) AS newest FROM events)
SELECT c.event_id, c.user_id, answer FROM c LEFT JOIN p ON p.user_id = c.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOURS, m WHERE c.ts < newest - INTERVAL 4 DAYS""")
def stream_unanswered(spark: SparkSession, d: str) -> DataFrame:
    """Clicks beside the purchases of the next six hours, or beside none, by an outer join of two streams; those that the watermark has settled."""
    from pyspark.sql import functions as F

    from tidemark.plans.base import table
    from tidemark.streaming.keyed import unanswered

    settled = table(spark, d, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("interval 4 days")).alias("until"))
    return unanswered(spark, d, "click", "purchase", 6 * 3600, "2 days").join(F.broadcast(settled)).where("began < until").select("event_id", "user_id", "answer")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOURS THEN 1 ELSE 0 END AS opens FROM events), g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e), m AS (SELECT max(ts) AS newest FROM events)
SELECT * FROM (SELECT user_id, min(ts) AS starts, count(*) AS n FROM g GROUP BY user_id, s), m WHERE starts < newest - INTERVAL 4 DAYS""".replace("SELECT * FROM (SELECT user_id", "SELECT user_id, starts, n FROM (SELECT user_id"))
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user that end after four hours without an event, by a stream; those that the watermark has settled."""
    from pyspark.sql import functions as F

    from tidemark.plans.base import table
    from tidemark.streaming.keyed import sessions

    settled = table(spark, d, "events").agg((F.max("ts") - F.expr("interval 4 days")).alias("until"))
    return sessions(spark, d, "4 hours", "2 days").join(F.broadcast(settled)).where("starts < until").select("user_id", "starts", "n")
