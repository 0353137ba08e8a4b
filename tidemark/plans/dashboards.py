"""Aggregate views: daily and keyed overviews, rates, shares, funnels and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import coverage, half_up, mean, percent, percent_or_null, unit_ratio
from tidemark.functions.rules import first_match
from tidemark.operators.aggregate import dense_counts, nearest_rank, with_share
from tidemark.plans.base import query, table


def cents(x: str) -> Column:
    """Hundredths as whole numbers, so that sums don't depend on their order."""
    return F.floor(F.col(x) * 100 + 0.5).cast("long")


def item_scores(spark: SparkSession, d: str) -> DataFrame:
    """One row for each order with lines: number of lines, of returned ones, and sums in hundredths."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.sum(cents("l_discount")).alias("discount"), F.sum(cents("l_tax")).alias("tax"), F.sum(cents("l_quantity")).alias("quantity"),
    )


SCORES_SQL = """s AS (SELECT l_orderkey, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
  sum(floor(l_discount * 100 + 0.5)::BIGINT)::BIGINT AS discount, sum(floor(l_tax * 100 + 0.5)::BIGINT)::BIGINT AS tax,
  sum(floor(l_quantity * 100 + 0.5)::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY l_orderkey)"""


@query(f"""WITH {SCORES_SQL}
SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_finished,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent, count(*) FILTER (WHERE n_returned > 0) AS n_with_return,
  coalesce(sum(n_lines), 0)::BIGINT AS n_lines, count(*) FILTER (WHERE n_lines IS NULL) AS n_without_lines,
  CASE WHEN coalesce(sum(n_lines), 0) > 0 THEN floor(sum(discount)::DOUBLE / sum(n_lines)::DOUBLE * 100 + 0.5) / 100 ELSE 0 END AS mean_discount
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY 1""")
def daily_overview(spark: SparkSession, d: str) -> DataFrame:
    """Orders by day, with the scores of their lines: counts under conditions and a rounded mean."""
    rows = table(spark, d, "orders").join(item_scores(spark, d), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    lines = F.coalesce(F.sum("n_lines"), F.lit(0))
    return rows.groupBy(F.to_date("o_orderdate").cast("string").alias("day")).agg(
        F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"), F.count_if(F.col("n_returned") > 0).alias("n_with_return"),
        lines.cast("long").alias("n_lines"), F.count_if(F.col("n_lines").isNull()).alias("n_without_lines"),
        mean(F.sum("discount"), lines).alias("mean_discount"),
    )


@query(f"""WITH {SCORES_SQL}
SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, o_orderpriority AS platform, count(*) AS n,
  CASE WHEN count(n_lines) > 0 THEN floor(sum(discount)::DOUBLE / count(n_lines)::DOUBLE * 100 + 0.5) / 100 ELSE 0 END AS mean_discount,
  CASE WHEN count(n_lines) > 0 THEN floor(sum(tax)::DOUBLE / count(n_lines)::DOUBLE * 100 + 0.5) / 100 ELSE 0 END AS mean_tax,
  CASE WHEN count(n_lines) > 0 THEN floor(sum(quantity)::DOUBLE / count(n_lines)::DOUBLE * 100 + 0.5) / 100 ELSE 0 END AS mean_quantity
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY ALL""")
def platform_stats(spark: SparkSession, d: str) -> DataFrame:
    """Orders by month and priority with three means over those that have scores."""
    rows = table(spark, d, "orders").join(item_scores(spark, d), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    scored = F.count("n_lines")
    return rows.groupBy(F.trunc("o_orderdate", "month").cast("string").alias("month"), F.col("o_orderpriority").alias("platform")).agg(
        F.count("*").alias("n"), mean(F.sum("discount"), scored).alias("mean_discount"),
        mean(F.sum("tax"), scored).alias("mean_tax"), mean(F.sum("quantity"), scored).alias("mean_quantity"),
    )


@query("""SELECT date_trunc('month', l_shipdate)::DATE::VARCHAR AS month, l_returnflag AS kind, l_linestatus AS status,
  CASE WHEN l_discount >= 0.05 THEN 'high' ELSE 'low' END AS severity, p_brand AS title, count(*) AS n
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def issue_stats(spark: SparkSession, d: str) -> DataFrame:
    """Findings by five keys."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    severity = F.when(F.col("l_discount") >= 0.05, "high").otherwise("low")
    keys = [F.trunc("l_shipdate", "month").cast("string").alias("month"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status"), severity.alias("severity"), F.col("p_brand").alias("title")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


@query("""SELECT year(o_orderdate)::INTEGER AS year, coalesce(r_name, 'unknown') AS region, coalesce(n_name, 'unknown') AS nation,
  coalesce(c_mktsegment, 'unknown') AS sector, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 300000) AS n_high,
  count(DISTINCT c_custkey) AS n_organizations
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""")
def org_risk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Orders by year and coalesced attributes of who placed them."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    known = lambda c, name: F.coalesce(F.col(c), F.lit("unknown")).alias(name)
    return rows.groupBy(F.year("o_orderdate").alias("year"), known("r_name", "region"), known("n_name", "nation"), known("c_mktsegment", "sector")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 300000).alias("n_high"), F.count_distinct("c_custkey").alias("n_organizations")
    )


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n_key_evidence
FROM orders WHERE o_totalprice > 400000 OR (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND o_totalprice > 300000)""")
def recent_high_risk(spark: SparkSession, d: str) -> DataFrame:
    """Orders of high risk with the number of their key lines, 0 where there are none."""
    o = table(spark, d, "orders")
    high = o.where((F.col("o_totalprice") > 400000) | ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300000)))
    evidence = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = high.join(evidence, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", "o_orderpriority", "o_totalprice", F.coalesce("n", F.lit(0)).alias("n_key_evidence"))


@query("""WITH e AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')
SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice > 300000) AS n_high, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_attention,
  floor(count(*) FILTER (WHERE o_totalprice > 300000)::DOUBLE / count(*)::DOUBLE * 1000 + 0.5) / 10 AS high_rate,
  floor(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))::DOUBLE / count(*)::DOUBLE * 1000 + 0.5) / 10 AS attention_rate,
  floor(sum(floor(o_totalprice * 100 + 0.5)::BIGINT)::DOUBLE / count(*)::DOUBLE * 1 + 0.5) / 1 AS mean_price, count(*) > 0 AND count(*) < 30 AS early FROM e""")
def summary_kpis(spark: SparkSession, d: str) -> DataFrame:
    """One row of counts and rates over all eligible orders."""
    eligible = table(spark, d, "orders").where(F.col("o_orderstatus") != "P")
    n, high, attention = F.count("*"), F.count_if(F.col("o_totalprice") > 300000), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return eligible.agg(
        n.alias("n"), high.alias("n_high"), attention.alias("n_attention"), percent(high, n).alias("high_rate"), percent(attention, n).alias("attention_rate"),
        mean(F.sum(cents("o_totalprice")), n, 0).alias("mean_price"), ((n > 0) & (n < 30)).alias("early"),
    )


@query("""SELECT date_trunc('week', coalesce(o_orderdate, TIMESTAMP '1995-01-01'))::DATE::VARCHAR AS week, count(*) AS n,
  floor(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*)::DOUBLE * 1000 + 0.5) / 10 AS finished_rate FROM orders GROUP BY 1""")
def trend_by_week(spark: SparkSession, d: str) -> DataFrame:
    """Counts and rates by week; a null date counts for the first one of the range."""
    when = F.coalesce(F.col("o_orderdate").cast("timestamp"), F.lit("1995-01-01").cast("timestamp"))
    return table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("week", when)).cast("string").alias("week")).agg(F.count("*").alias("n"), percent(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("finished_rate"))


DOMAIN = ("view", "click", "signup", "refund")


@query("""WITH d(key, place) AS (VALUES ('view', 0), ('click', 1), ('signup', 2), ('refund', 3), ('other', 4)),
c AS (SELECT CASE WHEN event_type IN ('view', 'click', 'signup', 'refund') THEN event_type ELSE 'other' END AS key, count(*) AS n FROM events GROUP BY 1)
SELECT key, place::INTEGER AS place, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (key)""")
def dense_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    """Events by kind over a fixed domain: 0 where there are none, others together."""
    return dense_counts(table(spark, d, "events"), F.col("event_type"), DOMAIN, rest="other")


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
  floor(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*)::DOUBLE * 1000 + 0.5) / 10 AS rate,
  floor(min(o_totalprice) / 7000 * 100 + 0.5) / 100 AS rounded FROM orders GROUP BY 1""")
def rate_half_up(spark: SparkSession, d: str) -> DataFrame:
    """Percentages with one place, halves up on doubles."""
    finished = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), finished.alias("finished"), percent(finished, F.count("*")).alias("rate"), half_up(F.min("o_totalprice") / 7000, 2).alias("rounded"))


@query("""SELECT p_type AS bucket, count(*) AS n, floor(count(*)::DOUBLE / (SELECT count(*) FROM part)::DOUBLE * 1000 + 0.5) / 10 AS share FROM part GROUP BY 1""")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    """Each bucket's percentage of all."""
    return with_share(table(spark, d, "part").groupBy(F.col("p_type").alias("bucket")).agg(F.count("*").alias("n")), "n")


@query("""SELECT p_brand AS label, count(*) AS n_findings, count(DISTINCT l_orderkey) AS n_affected
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1""")
def count_distinct_affected(spark: SparkSession, d: str) -> DataFrame:
    """Findings and the distinct orders they affect, by label."""
    rows = table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n_findings"), F.count_distinct("l_orderkey").alias("n_affected"))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS candidates, count(*) FILTER (WHERE event_type = 'click') AS valid,
    count(*) FILTER (WHERE event_type = 'purchase') AS fresh, count(*) FILTER (WHERE event_type = 'error') AS invalid, count(*) FILTER (WHERE event_type = 'signup') AS duplicates
  FROM events WHERE value > 30 GROUP BY user_id)
SELECT *, CASE WHEN candidates > 0 AND valid <= candidates THEN valid::DOUBLE / candidates::DOUBLE END AS conversion,
  CASE WHEN valid > 4 OR fresh > 4 THEN 'keep' WHEN candidates = 0 THEN 'stop_review' ELSE 'improve' END AS tier FROM c""")
def query_performance_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each search with its conversion, null outside 0 to 1, and its tier."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    c = table(spark, d, "events").where("value > 30").groupBy("user_id").agg(kind("view").alias("candidates"), kind("click").alias("valid"), kind("purchase").alias("fresh"), kind("error").alias("invalid"), kind("signup").alias("duplicates"))
    tier = first_match([((F.col("valid") > 4) | (F.col("fresh") > 4), "keep"), (F.col("candidates") == 0, "stop_review")], "improve")
    return c.withColumn("conversion", unit_ratio(F.col("valid"), F.col("candidates"))).withColumn("tier", tier)


@query("""SELECT count(DISTINCT user_id) AS n_users, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
  count(*) FILTER (WHERE event_type = 'click')::DOUBLE / count(*) FILTER (WHERE event_type = 'view')::DOUBLE AS click_ratio,
  greatest(count(*) FILTER (WHERE event_type = 'error'), count(DISTINCT user_id)) AS restricted,
  CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') <= 0 THEN 1.0
       ELSE least(1.0, count(*) FILTER (WHERE event_type = 'click')::DOUBLE / count(*) FILTER (WHERE event_type = 'purchase')::DOUBLE) END AS coverage FROM events""")
def ops_funnel(spark: SparkSession, d: str) -> DataFrame:
    """A block of counts and ratios in one pass."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    users = F.count_distinct("user_id")
    return table(spark, d, "events").agg(
        users.alias("n_users"), kind("view").alias("views"), kind("click").alias("clicks"), kind("purchase").alias("purchases"),
        F.try_divide(kind("click").cast("double"), kind("view").cast("double")).alias("click_ratio"), F.greatest(kind("error"), users).alias("restricted"),
        coverage(kind("click"), kind("purchase")).alias("coverage"),
    )


@query("""SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high,
  count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1""")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Counts by two keys in one pass, one of them across."""
    wide = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.count(F.lit(1)))
    zero = lambda c, name: F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(name)
    return wide.select("status", zero("1-URGENT", "urgent"), zero("2-HIGH", "high"), zero("5-LOW", "low"))


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1""")
def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by nearest rank."""
    return nearest_rank(table(spark, d, "events"), ["event_type"], "value", (0.5, 0.95, 0.99))


@query("""SELECT sum(greatest(n - 1, 0))::BIGINT AS duplicates, count(*) AS keys, max(n) AS most FROM (SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL)""")
def duplicate_proxy(spark: SparkSession, d: str) -> DataFrame:
    """How many rows repeat a key."""
    counts = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count("*").alias("n"))
    return counts.agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("duplicates"), F.count("*").alias("keys"), F.max("n").alias("most"))


@query("""SELECT event_type, count(*) FILTER (WHERE value > 50 AND ts < TIMESTAMP '2024-01-30 23:30:00') AS stuck,
  CASE WHEN count(*) FILTER (WHERE value > 0 AND value < 80) > 0 THEN floor(sum(floor(value * 100 + 0.5)::BIGINT) FILTER (WHERE value > 0 AND value < 80)::DOUBLE
    / count(*) FILTER (WHERE value > 0 AND value < 80)::DOUBLE + 0.5) ELSE 0 END AS mean_duration FROM events GROUP BY 1""")
def stuck_detection(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what runs too long, and a rounded mean over plausible durations alone."""
    plausible = (F.col("value") > 0) & (F.col("value") < 80)
    old = F.col("ts") < F.lit("2024-01-30 23:30:00").cast("timestamp_ntz")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if((F.col("value") > 50) & old).alias("stuck"), mean(F.sum(F.when(plausible, cents("value"))), F.count_if(plausible), 0).alias("mean_duration"))


@query("""SELECT user_id, arg_max(event_type, (total, event_type)) AS slowest, max(total) AS most FROM
  (SELECT user_id, event_type, sum(floor(value * 100 + 0.5)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL) GROUP BY 1""")
def phase_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The phase in which each job spent most, and how much."""
    phases = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum(cents("value")).alias("total"))
    return phases.groupBy("user_id").agg(F.max_by("event_type", F.struct("total", "event_type")).alias("slowest"), F.max("total").alias("most"))


@query("""WITH g AS (SELECT p_brand AS category, p_type AS title, max(CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END)::INTEGER AS worst,
    list_sort(list(DISTINCT l_suppkey)) AS evidence, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45 GROUP BY ALL)
SELECT category, title, CASE worst WHEN 2 THEN 'critical' WHEN 1 THEN 'high' ELSE 'info' END AS severity, n, array_to_string(list_slice(evidence, 1, 3), ',') AS evidence,
  greatest(len(evidence) - 3, 0)::INTEGER AS more FROM g""")
def findings_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Findings merged by title: worst severity, up to three pieces of evidence and how many more there are."""
    rank = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    rows = table(spark, d, "lineitem").where("l_quantity > 45").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    g = rows.groupBy(F.col("p_brand").alias("category"), F.col("p_type").alias("title")).agg(F.max(rank).alias("worst"), F.sort_array(F.collect_set("l_suppkey")).alias("e"), F.count("*").alias("n"))
    severity = F.when(F.col("worst") == 2, "critical").when(F.col("worst") == 1, "high").otherwise("info")
    return g.select("category", "title", severity.alias("severity"), "n", F.array_join(F.slice("e", 1, 3).cast("array<string>"), ",").alias("evidence"), F.greatest(F.size("e") - 3, F.lit(0)).alias("more"))


@query("""SELECT l_linestatus AS item, count(*) FILTER (WHERE l_returnflag <> 'N') AS applicable, count(*) FILTER (WHERE l_returnflag = 'A') AS compliant,
  count(*) FILTER (WHERE l_returnflag = 'R') AS gap,
  CASE WHEN count(*) FILTER (WHERE l_returnflag <> 'N') > 0 THEN floor(count(*) FILTER (WHERE l_returnflag = 'A')::DOUBLE / count(*) FILTER (WHERE l_returnflag <> 'N')::DOUBLE * 1000 + 0.5) / 10 END AS rate
FROM (SELECT l_linestatus, l_returnflag FROM lineitem UNION ALL SELECT 'proxy', CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END FROM orders) GROUP BY 1""")
def notice_compliance(spark: SparkSession, d: str) -> DataFrame:
    """Compliance by item from two sources; its rate is null where nothing applies."""
    status = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("item"), F.col("l_returnflag").alias("flag"))
    rows = rows.unionByName(table(spark, d, "orders").select(F.lit("proxy").alias("item"), status.alias("flag")))
    applicable, compliant = F.count_if(F.col("flag") != "N"), F.count_if(F.col("flag") == "A")
    return rows.groupBy("item").agg(applicable.alias("applicable"), compliant.alias("compliant"), F.count_if(F.col("flag") == "R").alias("gap"), percent_or_null(compliant, applicable).alias("rate"))


@query("""SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) FILTER (WHERE event_type = 'purchase') AS used, greatest(0, 70 - count(*) FILTER (WHERE event_type = 'purchase'))::BIGINT AS remaining,
  least(greatest(0, 70 - count(*) FILTER (WHERE event_type = 'purchase')), greatest(0, 100 - count(*) - greatest(0, 30 - count(*) FILTER (WHERE event_type = 'click'))))::BIGINT AS cap FROM events GROUP BY 1""")
def budget_carry_over(spark: SparkSession, d: str) -> DataFrame:
    """What a day's budget has left, and the cap after the other partition's share is set aside."""
    mine, other = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "click")
    left, reserved = F.greatest(F.lit(0), 70 - mine), F.greatest(F.lit(0), 30 - other)
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(mine.alias("used"), left.alias("remaining"), F.least(left, F.greatest(F.lit(0), 100 - F.count("*") - reserved)).alias("cap"))


@query("""SELECT c_mktsegment, r_name, grouping(c_mktsegment)::INTEGER AS all_segments, grouping(r_name)::INTEGER AS all_regions, count(*) AS n
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY CUBE (c_mktsegment, r_name)""")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts for every combination of two keys and their totals."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.cube("c_mktsegment", "r_name").agg(F.grouping("c_mktsegment").cast("int").alias("all_segments"), F.grouping("r_name").cast("int").alias("all_regions"), F.count("*").alias("n"))
