"""Filters, joins, counts, orders, queues and nested values of the collector and the review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, ranges, text
from tidemark.functions.numbers import half_up, mean, unit_ratio
from tidemark.functions.rules import all_of, first_match, rank_in
from tidemark.operators import cases, collecting, queue
from tidemark.operators.select import latest_per_key
from tidemark.plans.base import deal, query, table

NOW = "2024-01-20 12:00:00"


def moment(at: str):
    return F.lit(at).cast("timestamp")


# --- filters -------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT event_id, (ts + INTERVAL 9 HOURS)::DATE AS day FROM events),
r(name, a, b) AS (VALUES ('today', DATE '2024-01-20', DATE '2024-01-20'), ('7d', DATE '2024-01-14', DATE '2024-01-20'), ('30d', DATE '2023-12-22', DATE '2024-01-20'), ('custom', DATE '2024-01-03', DATE '2024-01-09'), ('all', NULL, NULL))
SELECT name, a::VARCHAR AS first_day, b::VARCHAR AS last_day, (SELECT count(*) FROM d WHERE (a IS NULL OR day >= a) AND (b IS NULL OR day <= b)) AS n FROM r""")
def range_presets(spark: SparkSession, d: str) -> DataFrame:
    """Events in each of the ranges of days that a request may name, in one pass."""
    today = "2024-01-20"
    asked = [ranges.resolve_days(today, "TODAY"), ranges.resolve_days(today), ranges.resolve_days(today, "30d"), ranges.resolve_days(today, "7d", "2024-01-09", "2024-01-03"), ranges.resolve_days_strictly(today, "all")]
    day = dates.local_date(F.col("ts").cast("timestamp"))
    counts = table(spark, d, "events").select(day.alias("day")).agg(*[F.count_if(r.holds(F.col("day"))).alias(r.name) for r in asked])
    rows = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.first).alias("first_day"), F.lit(r.last).alias("last_day"), F.col(r.name).alias("n")) for r in asked])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


@query("""SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-09 15:00:00' AND ts < TIMESTAMP '2024-01-10 15:00:00' GROUP BY 1""")
def instants_of_a_day(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type within the half-open bounds of one local day."""
    at, day = F.col("ts").cast("timestamp"), F.lit("2024-01-10").cast("date")
    return table(spark, d, "events").where((at >= dates.day_start(day)) & (at < dates.day_end(day))).groupBy("event_type").agg(F.count("*").alias("n"))


STATUS_SQL = "CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'discovered' WHEN 'error' THEN 'invalid' ELSE 'closed' END"


@query(f"""WITH s AS (SELECT {STATUS_SQL} AS status FROM events), p(name) AS (VALUES ('default'), ('non_invalid'), ('all'), ('closed'))
SELECT name, count(*) FILTER (WHERE CASE name WHEN 'default' THEN status IN ('active', 'discovered') WHEN 'non_invalid' THEN status <> 'invalid' WHEN 'all' THEN true ELSE status = name END) AS n FROM p, s GROUP BY 1""")
def status_presets(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each named choice of statuses keeps."""
    status = first_match([(F.col("event_type") == k, F.lit(v)) for k, v in (("view", "active"), ("click", "discovered"), ("error", "invalid"))], "closed")
    names = ("default", "non_invalid", "all", "closed")
    counts = table(spark, d, "events").select(status.alias("status")).agg(*[F.count_if(ranges.status_preset(F.col("status"), n)).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("r")).select("r.*")


@query("""SELECT p_partkey, starts_with(p_name, 'small') AS by_prefix, contains(lower(p_name), 'in') OR contains(lower(p_brand), 'in') OR contains(lower(p_type), 'in') AS by_any, p_brand LIKE '%#1_' AS by_pattern,
  contains(p_brand, '#1_') AS literal, p_type IS NULL OR p_type = 'PROMO' AS null_or_promo FROM part WHERE (p_size > 5 OR p_size IS NULL)""")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    """Prefix, substring over several columns without regard to case, a pattern whose wildcards count and a text whose don't, and a disjunction with null."""
    rows = table(spark, d, "part").where(F.col("p_size").isNull() | (F.col("p_size") > 5))
    by_any = reduce(lambda s, c: s | F.contains(F.lower(c), F.lit("in")), ("p_brand", "p_type"), F.contains(F.lower("p_name"), F.lit("in")))
    return rows.select("p_partkey", F.startswith("p_name", F.lit("small")).alias("by_prefix"), by_any.alias("by_any"), F.col("p_brand").like("%#1_").alias("by_pattern"), F.contains("p_brand", F.lit("#1_")).alias("literal"), (F.col("p_type").isNull() | (F.col("p_type") == "PROMO")).alias("null_or_promo"))


UI, EVIDENCE, RISK, CASE = ("unreviewed", "send", "candidate", "done", "hold"), (cases.READY, cases.SOME, cases.FEW, cases.TO_DO), ("critical", "high", "medium", "low"), ("private", "archived", "reviewing", "published", "paused")


def review_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases for review made from orders."""
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (F.floor(F.col("o_orderkey") / k) % len(names) + 1).cast("int"))
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), pick(UI, 1).alias("ui"), pick(EVIDENCE, 2).alias("evidence"), pick(RISK, 3).alias("risk"), pick(CASE, 5).alias("state"), (F.col("o_orderkey") % 11 == 0).alias("report"),
        (F.col("o_custkey") % 2 == 0).alias("public"), (F.col("o_custkey") % 3 > 0).alias("personal"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("topic"), F.col("o_totalprice").alias("score"),
    )
    return rows.withColumn("priority", first_match([(F.col("report"), "A"), (F.col("personal") & F.col("risk").isin("critical", "high"), "A"), (F.col("personal"), "B")], "C"))


def _list(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


CASES_SQL = f"""c AS (SELECT *, CASE WHEN report THEN 'A' WHEN personal AND risk IN ('critical', 'high') THEN 'A' WHEN personal THEN 'B' ELSE 'C' END AS priority FROM (SELECT o_orderkey AS id, ({_list(UI)})[1 + o_orderkey % 5] AS ui,
  ({_list(EVIDENCE)})[1 + (o_orderkey // 2) % 4] AS evidence, ({_list(RISK)})[1 + (o_orderkey // 3) % 4] AS risk, ({_list(CASE)})[1 + (o_orderkey // 5) % 5] AS state, o_orderkey % 11 = 0 AS report, o_custkey % 2 = 0 AS public,
  o_custkey % 3 > 0 AS personal, o_orderdate AS seen_at, o_orderpriority AS topic, o_totalprice AS score FROM orders))"""
_VIEWS_SQL = {
    "unreviewed": "ui = 'unreviewed'", "highOrReport": "risk IN ('critical', 'high') OR report", "outreach": "ui IN ('send', 'candidate')", "publicSector": "public", "evidenceReady": f"evidence IN ('{cases.READY}', '{cases.SOME}')",
    "evidenceMissing": f"evidence IN ('{cases.FEW}', '{cases.TO_DO}')", "captureNeeded": f"evidence = '{cases.TO_DO}'",
    "priorityEvidence": f"priority = 'A' AND risk IN ('critical', 'high') AND public AND personal AND evidence IN ('{cases.FEW}', '{cases.TO_DO}') AND ui IN ('unreviewed', 'send', 'candidate')", "reportReady": "true", "all": "true",
    "unpublished": "state IN ('private', 'archived')", "reviewing": "state = 'reviewing'", "published": "state = 'published'", "paused": "state = 'paused'",
}


@query(f"WITH {CASES_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER (WHERE {w}) AS n FROM c" for n, w in _VIEWS_SQL.items()))
def review_views(spark: SparkSession, d: str) -> DataFrame:
    """How many cases each of the fourteen views of the review shows, in one pass."""
    c = F.col
    named = cases.views(c("ui"), c("evidence"), c("risk"), c("report"), c("public"), c("personal"), c("priority"), c("state"))
    counts = review_cases(spark, d).agg(*[F.count_if(p).alias(n) for n, p in named.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c(n).alias("n")) for n in named])).alias("r")).select("r.*")


@query(f"""WITH {CASES_SQL} SELECT id, priority, evidence FROM c WHERE risk IN ('critical', 'high') AND state <> 'archived' AND public AND NOT report AND personal AND priority IN ('A', 'B') AND ui <> 'done' AND seen_at >= TIMESTAMP '1996-01-01' AND seen_at < TIMESTAMP '2000-01-01'
  AND evidence <> '{cases.READY}' AND contains(lower(topic), 'e') AND score > 1000 AND id % 2 = 0""")
def review_filters(spark: SparkSession, d: str) -> DataFrame:
    """The conjunction of a dozen predicates of which each may be left out, with flags of three states."""
    c = F.col
    asked = {"public": ranges.flag("true"), "report": ranges.flag("0"), "personal": ranges.flag("TRUE"), "other": ranges.flag("maybe")}
    day = F.to_date("at")
    given = [
        c("risk").isin("critical", "high"), c("state") != "archived", ranges.when_flag(c("public"), asked["public"]), ranges.when_flag(c("report"), asked["report"]), ranges.when_flag(c("personal"), asked["personal"]), ranges.when_flag(c("id") < 0, asked["other"]),
        c("priority").isin("A", "B"), c("ui") != "done", day.between("1996-01-01", "1999-12-31"), c("evidence") != cases.READY, F.contains(F.lower("topic"), F.lit("e")), c("score") > 1000, c("id") % 2 == 0, None,
    ]
    return review_cases(spark, d).where(all_of(given)).select("id", "priority", "evidence")


# --- joins ---------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, coalesce(CASE s WHEN 'R' THEN 'closed' WHEN 'A' THEN 'limited' END, o_orderstatus) AS status FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS s FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_orderkey = o_orderkey""")
def update_from_join(spark: SparkSession, d: str) -> DataFrame:
    """Statuses set from those of another table, through a map."""
    source = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("status"))
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return queue.updated_from(rows, source, "o_orderkey", "status", {"R": "closed", "A": "limited"})


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS again,
  row_number() OVER (ORDER BY EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), c_acctbal DESC, c_custkey) AS place FROM customer
WHERE c_nationkey NOT IN (3, 5) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_totalprice > 400000) ORDER BY place LIMIT 40""")
def open_for_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """Neither blocked nor running ones, those never scanned before those done once."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation").where("n_nationkey in (3, 5)").select(F.col("n_nationkey").alias("c_nationkey"))), "c_nationkey", "left_anti")
    rows = rows.join(orders.where("o_orderstatus = 'O' and o_totalprice > 400000"), "c_custkey", "left_anti")
    done = orders.where("o_orderstatus = 'F'").select("c_custkey").distinct().withColumn("again", F.lit(True))
    first = rows.join(done, "c_custkey", "left").withColumn("again", F.coalesce("again", F.lit(False))).orderBy("again", F.col("c_acctbal").desc(), "c_custkey").limit(40)
    return first.select("c_custkey", "again", F.row_number().over(Window.orderBy("again", F.col("c_acctbal").desc(), "c_custkey")).cast("long").alias("place"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_totalprice > 450000), e AS (
  SELECT l_orderkey, l_linenumber, id FROM lineitem JOIN a ON l_orderkey = id UNION SELECT l_orderkey, l_linenumber, id FROM lineitem JOIN a ON l_partkey = id UNION SELECT l_orderkey, l_linenumber, id FROM lineitem JOIN a ON l_suppkey = o_custkey)
SELECT id, count(*) AS n FROM e GROUP BY 1""")
def evidence_by_three_keys(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a case by any of three keys, each piece once."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    wanted = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("id"), "o_custkey")
    n = lines.count()
    # The few cases are the side that a task holds, by a hash of them; lines pass by unsorted.
    ways = [deal(lines, n, a).join(wanted.hint("shuffle_hash"), F.col(a) == F.col(b)).select("l_orderkey", "l_linenumber", "id") for a, b in (("l_orderkey", "id"), ("l_partkey", "id"), ("l_suppkey", "o_custkey"))]
    pieces = deal(reduce(DataFrame.unionByName, ways), n, "l_orderkey", "l_linenumber", "id").distinct()
    return pieces.groupBy("id").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey <> 7 LEFT JOIN region ON r_regionkey = n_regionkey""")
def two_hop_map(spark: SparkSession, d: str) -> DataFrame:
    """From an id through one table to another; what the first lacks stays without the second."""
    nation, region = table(spark, d, "nation").where("n_nationkey <> 7"), table(spark, d, "region")
    rows = table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("""SELECT o_orderkey, coalesce(n, 0) AS n_lines, coalesce(parts, 0) AS n_parts, c_mktsegment AS segment, n_name AS nation, r_name AS region FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def enriched_cases(spark: SparkSession, d: str) -> DataFrame:
    """A case with what five other tables know of it, each brought to its grain before the join."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.count_distinct("l_partkey").alias("n_parts"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    rows = rows.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return rows.select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'widget') OR contains(p_name, 'gear') THEN CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'blue') THEN 'blue' WHEN contains(p_name, 'small') THEN 'small' END END AS place,
  CASE WHEN contains(p_name, 'widget') THEN 'widget' WHEN contains(p_name, 'gear') THEN 'gear' WHEN contains(p_name, 'ring') THEN 'ring' END AS keyword FROM part""")
def compound_match(spark: SparkSession, d: str) -> DataFrame:
    """A place, where a text names a facility as well; and the first keyword it holds at all."""
    name = F.col("p_name")
    has = lambda w: F.contains(name, F.lit(w))
    facility = has("widget") | has("gear")
    place = F.when(facility, first_match([(has(w), F.lit(w)) for w in ("red", "blue", "small")]))
    return table(spark, d, "part").select("p_partkey", place.alias("place"), first_match([(has(w), F.lit(w)) for w in ("widget", "gear", "ring")]).alias("keyword"))


@query("""WITH r(rule, field, least) AS (VALUES ('big', 'price', 300000.0), ('old', 'age', 1000.0), ('loyal', 'orders', 3.0)), f AS (SELECT o_orderkey, o_custkey, o_totalprice, floor(epoch_us(TIMESTAMP '2001-08-01' - o_orderdate) / 86400000000.0) AS age FROM orders),
x AS (SELECT o_orderkey, map(['price', 'age', 'orders'], [o_totalprice, age, (o_custkey % 7)::DOUBLE]) AS m FROM f)
SELECT o_orderkey, rule, m[field] >= least AS met FROM x, r WHERE o_orderkey % 5 = 0""")
def rules_by_parameter(spark: SparkSession, d: str) -> DataFrame:
    """Each row against each rule of a table of fields and bounds: values in a map, rules in a literal array, no join of rows."""
    age = F.floor((F.unix_micros(moment("2001-08-01")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86_400_000_000.0)
    values = F.create_map(F.lit("price"), F.col("o_totalprice"), F.lit("age"), age.cast("double"), F.lit("orders"), (F.col("o_custkey") % 7).cast("double"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(f).alias("field"), F.lit(x).alias("least")) for r, f, x in (("big", "price", 300000.0), ("old", "age", 1000.0), ("loyal", "orders", 3.0))])
    rows = table(spark, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", values.alias("m"), F.explode(rules).alias("r"))
    return rows.select("o_orderkey", "r.rule", (F.try_element_at("m", F.col("r.field")) >= F.col("r.least")).alias("met"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, page_id % 7 AS org FROM pages)
SELECT host, count(DISTINCT org) AS orgs, count(*) AS n, count(DISTINCT org) > 1 AS shared FROM h GROUP BY 1""")
def shared_origins(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that several organizations give as their own: a grouped count instead of a join of peers."""
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), (F.col("page_id") % 7).alias("org"))
    counts = rows.groupBy("host").agg(F.count_distinct("org").alias("orgs"), F.count("*").alias("n"))
    return counts.withColumn("shared", F.col("orgs") > 1)


@query("""WITH m AS (SELECT p_partkey AS file, p_partkey % 50 AS page, p_name FROM part), s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 300 END AS file, event_id % 50 AS page FROM events),
f AS (SELECT page, min(p_name) AS by_page FROM m GROUP BY 1) SELECT event_id, coalesce(m.p_name, f.by_page) AS meta FROM s LEFT JOIN m ON m.file = s.file LEFT JOIN f ON f.page = s.page""")
def page_meta(spark: SparkSession, d: str) -> DataFrame:
    """Meta data of a shot by its file, else by the number of its page."""
    meta = table(spark, d, "part").select(F.col("p_partkey").alias("file"), (F.col("p_partkey") % 50).alias("page"), "p_name")
    shots = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 300).alias("file"), (F.col("event_id") % 50).alias("page"))
    by_page = meta.groupBy("page").agg(F.min("p_name").alias("by_page"))
    return shots.join(meta.drop("page"), "file", "left").join(by_page, "page", "left").select("event_id", F.coalesce("p_name", "by_page").alias("meta"))


# --- counts --------------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS query, count(*) FILTER (WHERE event_type = 'view') AS found, count(DISTINCT ts::DATE) AS runs FROM events WHERE ts::DATE IN (SELECT DISTINCT ts::DATE FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAYS AND ts < TIMESTAMP '2024-01-20 12:00:00')
GROUP BY 1 ORDER BY found DESC, runs DESC, query LIMIT 12""")
def top_queries(spark: SparkSession, d: str) -> DataFrame:
    """The twelve queries that found most in the runs of a week."""
    rows = table(spark, d, "events").withColumn("run", F.to_date("ts"))
    recent = rows.where((F.col("ts").cast("timestamp") >= moment("2024-01-13 12:00:00")) & (F.col("ts").cast("timestamp") < moment(NOW))).select("run").distinct()
    sums = rows.join(F.broadcast(recent), "run", "left_semi").groupBy(F.col("user_id").alias("query")).agg(F.count_if(F.col("event_type") == "view").alias("found"), F.count_distinct("run").alias("runs"))
    return sums.orderBy(F.col("found").desc(), F.col("runs").desc(), "query").limit(12)


@query("""WITH s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS good FROM events WHERE ts >= TIMESTAMP '2024-01-17 12:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1)
SELECT c_custkey AS query, coalesce(n, 0) AS n, coalesce(good, 0) AS good, CASE WHEN coalesce(n, 0) = 0 THEN 'no_runs' WHEN coalesce(good, 0) > 1 THEN 'keep' WHEN coalesce(good, 0) = 0 AND n > 5 THEN 'stop_review' ELSE 'improve' END AS tier FROM customer LEFT JOIN s ON user_id = c_custkey WHERE c_custkey < 200""")
def query_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Every configured query with its sums of three days, zero where it didn't run, and a tier."""
    at = F.col("ts").cast("timestamp")
    sums = table(spark, d, "events").where((at >= moment("2024-01-17 12:00:00")) & (at < moment(NOW))).groupBy(F.col("user_id").alias("query")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("good"))
    rows = table(spark, d, "customer").where("c_custkey < 200").select(F.col("c_custkey").alias("query")).join(sums, "query", "left")
    rows = rows.select("query", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.lit(0)).alias("good"))
    n, good = F.col("n"), F.col("good")
    return rows.withColumn("tier", first_match([(n == 0, "no_runs"), (good > 1, "keep"), ((good == 0) & (n > 5), "stop_review")], "improve"))


@query("""WITH t AS (SELECT * FROM events WHERE (ts + INTERVAL 9 HOURS)::DATE = DATE '2024-01-20') SELECT count(*) FILTER (WHERE NOT starts_with(event_type, 'err')) AS runs, coalesce(nullif(count(*) FILTER (WHERE event_type = 'refund'), 0), count(*) FILTER (WHERE event_type = 'view')) AS found,
  coalesce(nullif(count(*) FILTER (WHERE event_type = 'click'), 0), count(*)) AS clicked FROM t""")
def today_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Today's runs without those of a marker; statistics come before what the runs say, unless they are zero."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    today = table(spark, d, "events").where(dates.local_date(F.col("ts").cast("timestamp")) == F.lit("2024-01-20").cast("date"))
    return today.agg(F.count_if(~F.startswith("event_type", F.lit("err"))).alias("runs"), F.coalesce(F.nullif(kind("refund"), F.lit(0)), kind("view")).alias("found"), F.coalesce(F.nullif(kind("click"), F.lit(0)), F.count("*")).alias("clicked"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS success, count(*) FILTER (WHERE l_returnflag = 'R') AS partial, count(*) FILTER (WHERE l_linestatus = 'F') AS complete,
  floor(sum(l_quantity) / count(l_quantity) * 100 + 0.5) / 100 AS mean_pages, 0 < count(*) AND count(*) < 30 AS early FROM lineitem WHERE l_linenumber = 2""")
def capture_quality(spark: SparkSession, d: str) -> DataFrame:
    """How many captures succeeded, in part or whole, their mean length, and whether they are too few to tell."""
    n = F.count("*")
    rows = table(spark, d, "lineitem").where("l_linenumber = 2")
    return rows.agg(n.alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("success"), F.count_if(F.col("l_returnflag") == "R").alias("partial"), F.count_if(F.col("l_linestatus") == "F").alias("complete"), mean(F.sum("l_quantity"), F.count("l_quantity")).alias("mean_pages"), ((n > 0) & (n < 30)).alias("early"))


_KPIS = {
    "n": "true", "unreviewed": "ui = 'unreviewed'", "to_send": "ui IN ('send', 'candidate')", "critical": "risk = 'critical'", "severe": "risk IN ('critical', 'high')", "report": "report", "public": "public", "public_severe": "public AND risk IN ('critical', 'high')", "personal": "personal",
    "a": "priority = 'A'", "b": "priority = 'B'", "c": "priority = 'C'", "ready": f"evidence = '{cases.READY}'", "to_capture": f"evidence = '{cases.TO_DO}'", "published": "state = 'published'", "paused": "state = 'paused'", "recent": "seen_at >= TIMESTAMP '2001-01-01 00:00:00'",
}


@query(f"WITH {CASES_SQL} SELECT " + ", ".join(f"count(*) FILTER (WHERE {w}) AS {n}" for n, w in _KPIS.items()) + " FROM c")
def review_kpis(spark: SparkSession, d: str) -> DataFrame:
    """Seventeen counts of the review in one pass."""
    c = F.col
    severe = cases.severe(c("risk"))
    counts = {
        "n": F.lit(True), "unreviewed": c("ui") == "unreviewed", "to_send": c("ui").isin("send", "candidate"), "critical": c("risk") == "critical", "severe": severe, "report": c("report"), "public": c("public"), "public_severe": c("public") & severe, "personal": c("personal"),
        "a": c("priority") == "A", "b": c("priority") == "B", "c": c("priority") == "C", "ready": c("evidence") == cases.READY, "to_capture": c("evidence") == cases.TO_DO, "published": c("state") == "published", "paused": c("state") == "paused", "recent": c("at") >= F.lit("2001-01-01").cast("timestamp_ntz"),
    }
    return review_cases(spark, d).agg(*[F.count_if(p).alias(n) for n, p in counts.items()])


@query("""SELECT (ts + INTERVAL 9 HOURS)::DATE AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type = 'purchase') AS done FROM events GROUP BY 1""")
def local_day_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Statuses by local day."""
    day = dates.local_date(F.col("ts").cast("timestamp")).alias("day")
    return table(spark, d, "events").groupBy(day).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "purchase").alias("done"))


@query("""WITH q AS (SELECT count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'signup') AS s, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20')
SELECT v AS pages, c AS dated, e AS failed, greatest(e, s) AS restricted, CASE WHEN n > 0 THEN (n - e)::DOUBLE / n END AS success, CASE WHEN v > 0 AND c <= v THEN c::DOUBLE / v END AS dated_share, coalesce(CASE WHEN v > 0 AND c <= v THEN c::DOUBLE / v END < 0.5, false) AS dated_low,
  coalesce((e::DOUBLE / n) > 0.3, false) AS failing_high, e > 0 OR s > 100 AS stuck, v + c AS eligible FROM q""")
def crawl_quality(spark: SparkSession, d: str) -> DataFrame:
    """Sums, rates and warnings of the crawls since a day; a rate outside 0 to 1 is none, and warns of nothing."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    q = table(spark, d, "events").where(F.col("ts").cast("timestamp") >= moment("2024-01-20")).agg(kind("view").alias("v"), kind("click").alias("c"), kind("error").alias("e"), kind("signup").alias("s"), F.count("*").alias("n"))
    v, c, e, s, n = (F.col(x) for x in ("v", "c", "e", "s", "n"))
    dated = unit_ratio(c, v)
    return q.select(v.alias("pages"), c.alias("dated"), e.alias("failed"), F.greatest(e, s).alias("restricted"), unit_ratio(n - e, n).alias("success"), dated.alias("dated_share"), F.coalesce(dated < 0.5, F.lit(False)).alias("dated_low"), F.coalesce(unit_ratio(e, n) > 0.3, F.lit(False)).alias("failing_high"), ((e > 0) | (s > 100)).alias("stuck"), (v + c).alias("eligible"))


@query("""WITH a AS (SELECT s_nationkey, range(0, s_suppkey % 4) AS urls FROM supplier) SELECT s_nationkey, count(*) FILTER (WHERE len(urls) > 0) AS n, sum(len(urls))::BIGINT AS total FROM a GROUP BY 1""")
def rejected_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Rows with an array that isn't empty, read from JSON, and the lengths of the arrays."""
    written = F.to_json(F.when(F.col("s_suppkey") % 4 > 0, F.sequence(F.lit(1), F.col("s_suppkey") % 4)).otherwise(F.array().cast("array<long>")))
    rows = table(spark, d, "supplier").select("s_nationkey", F.from_json(written, "array<long>").alias("urls"))
    return rows.groupBy("s_nationkey").agg(F.count_if(F.size("urls") > 0).alias("n"), F.sum(F.size("urls")).alias("total"))


@query("""WITH l AS (SELECT CASE WHEN event_id % 3 = 0 THEN '[cap] a=' || (event_id % 5)::VARCHAR || ' b=' || (event_id % 7)::VARCHAR ELSE 'no marker ' || event_type END AS log, CASE WHEN user_id % 4 = 0 THEN 'cron' ELSE 'manual' END AS trigger FROM events)
SELECT trigger, count(*) FILTER (WHERE starts_with(log, '[cap]')) AS marked, coalesce(sum(TRY_CAST(nullif(regexp_extract(log, '\\ba=([0-9]+)', 1), '') AS BIGINT)), 0)::BIGINT AS a, coalesce(sum(TRY_CAST(nullif(regexp_extract(log, '\\bb=([0-9]+)', 1), '') AS BIGINT)), 0)::BIGINT AS b, count(*) > 5000 AS exceeds FROM l GROUP BY 1""")
def run_markers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in the markers of run logs, summed by what started the run."""
    log = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[cap] a="), (F.col("event_id") % 5).cast("string"), F.lit(" b="), (F.col("event_id") % 7).cast("string"))).otherwise(F.concat(F.lit("no marker "), "event_type"))
    rows = table(spark, d, "events").select(log.alias("log"), F.when(F.col("user_id") % 4 == 0, "cron").otherwise("manual").alias("trigger"))
    read = lambda name: F.coalesce(F.sum(F.nullif(F.regexp_extract("log", rf"\b{name}=([0-9]+)", 1), F.lit("")).try_cast("long")), F.lit(0)).alias(name)
    return rows.groupBy("trigger").agg(F.count_if(F.startswith("log", F.lit("[cap]"))).alias("marked"), read("a"), read("b"), (F.count("*") > 5000).alias("exceeds"))


@query(f"""WITH {CASES_SQL}, f AS (SELECT * FROM c ORDER BY score DESC, id LIMIT 40)
SELECT 'ui' AS kind, ui AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'risk', risk, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'state', state, count(*) FROM f GROUP BY 2""")
def first_forty(spark: SparkSession, d: str) -> DataFrame:
    """Three histograms of the first forty cases, from one sort."""
    first = review_cases(spark, d).orderBy(F.col("score").desc(), "id").limit(40)
    each = first.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("ui", "risk", "state")])).alias("x"))
    return each.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT o_orderdate::DATE AS day, 'C-' || strftime(o_orderdate, '%Y%m%d') || '-' || lpad((o_orderkey % 40 + 1)::VARCHAR, 3, '0') AS public_id FROM orders)
SELECT day, 'C-' || strftime(day, '%Y%m%d') || '-' || lpad((max(regexp_extract(public_id, '-([0-9]+)$', 1)::INTEGER) + 1)::VARCHAR, 3, '0') AS next_id FROM i GROUP BY 1""")
def next_public_ids(spark: SparkSession, d: str) -> DataFrame:
    """The next id of each day: one more than the greatest number in use, padded."""
    day = F.to_date("o_orderdate")
    stem = F.concat(F.lit("C-"), F.date_format(day, "yyyyMMdd"), F.lit("-"))
    rows = table(spark, d, "orders").select(day.alias("day"), F.concat(stem, F.lpad((F.col("o_orderkey") % 40 + 1).cast("string"), 3, "0")).alias("public_id"))
    last = rows.groupBy("day").agg(F.max(F.regexp_extract("public_id", "-([0-9]+)$", 1).cast("int")).alias("last"))
    return last.select("day", F.concat(F.lit("C-"), F.date_format("day", "yyyyMMdd"), F.lit("-"), F.lpad((F.col("last") + 1).cast("string"), 3, "0")).alias("next_id"))


@query("""SELECT c_mktsegment AS segment, n_name, greatest(count(*), count(DISTINCT o_custkey)) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F' GROUP BY ALL HAVING count(*) > 0""")
def tools_by_organization(spark: SparkSession, d: str) -> DataFrame:
    """Counts and distinct counts by two labels, the greater of both, without empty groups."""
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    n, distinct = F.count("*"), F.count_distinct("o_custkey")
    return rows.groupBy(F.col("c_mktsegment").alias("segment"), "n_name").agg(F.greatest(n, distinct).alias("n"), distinct.alias("customers"))


@query("""WITH q AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS hold, count(*) FILTER (WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20') AS hold_today, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20') AS n_today FROM events GROUP BY 1)
SELECT user_id, CASE WHEN n_today > 0 THEN hold_today::DOUBLE / n_today END AS today, hold::DOUBLE / n AS total, CASE WHEN n_today > 0 THEN (floor(hold_today::DOUBLE / n_today * 1000 + 0.5) / 10)::VARCHAR || '%' ELSE '-' END AS shown FROM q""")
def hold_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Shares of today and in all, kept apart, and one as it is shown."""
    today, error = F.col("ts").cast("timestamp") >= moment("2024-01-20"), F.col("event_type") == "error"
    q = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(error).alias("hold"), F.count_if(error & today).alias("hold_today"), F.count_if(today).alias("n_today"))
    ratio = unit_ratio(F.col("hold_today"), F.col("n_today"))
    shown = F.coalesce(F.concat((half_up(ratio * 1000) / 10).cast("string"), F.lit("%")), F.lit("-"))
    return q.select("user_id", ratio.alias("today"), unit_ratio(F.col("hold"), F.col("n")).alias("total"), shown.alias("shown"))


# --- windows and orders --------------------------------------------------------------------------------------------


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND ts >= TIMESTAMP '2024-01-18 12:00:00') WHERE r = 1""")
def latest_within_ttl(spark: SparkSession, d: str) -> DataFrame:
    """The newest completed row of each key that is still within its time to live."""
    rows = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", "value", "ts")
    return queue.latest_within(rows, ["user_id"], "ts", "event_id", moment(NOW), 2 * 86_400).select("user_id", "event_id", "value")


@query("""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS queue, floor(value)::BIGINT + user_id AS score FROM events)
SELECT user_id, event_id, queue::INTEGER AS queue, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY queue, score DESC, event_id) AS r FROM s) WHERE r = 1""")
def best_triage(spark: SparkSession, d: str) -> DataFrame:
    """Of each link the source with the best queue, then the highest score, then the first."""
    rank = rank_in(F.col("event_type"), ("purchase", "click"))
    rows = table(spark, d, "events").select("user_id", "event_id", rank.alias("queue"), (F.floor("value") + F.col("user_id")).alias("score"))
    best = rows.groupBy("user_id").agg(F.min(F.struct("queue", (-F.col("score")).alias("s"), "event_id")).alias("b"))
    return best.select("user_id", "b.event_id", "b.queue", (-F.col("b.s")).alias("score"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, length(url) AS score, length(html) AS excerpt FROM pages)
SELECT host, page_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, excerpt DESC, page_id) AS r FROM p) WHERE r = 1""")
def best_source_page(spark: SparkSession, d: str) -> DataFrame:
    """Of each host the page with the highest score, then the longest excerpt, then the first."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")
    order = F.struct(F.length("url"), F.length("html"), -F.col("page_id"))
    return table(spark, d, "pages").groupBy(host).agg(F.max_by("page_id", order).alias("best"))


@query("""SELECT s.event_id, s.user_id FROM events s WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND ts > TIMESTAMP '2024-01-18 12:00:00'
AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'purchase' AND e.ts >= s.ts AND e.ts <= TIMESTAMP '2024-01-20 12:00:00')""")
def pending_starts(spark: SparkSession, d: str) -> DataFrame:
    """Starts of two days that have not come to an end."""
    rows = table(spark, d, "events").where(F.col("ts").cast("timestamp") <= moment(NOW)).withColumn("at", F.col("ts"))
    return queue.pending(rows.where("event_type = 'signup'").select("event_id", "user_id", "at"), rows.where("event_type = 'purchase'"), "user_id", moment(NOW), 2 * 86_400).select("event_id", "user_id")


@query("""WITH q AS (SELECT user_id AS query, count(*) FILTER (WHERE event_type = 'view') AS new, count(*) FILTER (WHERE event_type = 'click') AS valid, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 10)
SELECT * FROM (SELECT 'top' AS side, query FROM q ORDER BY new DESC, valid DESC, valid::DOUBLE / n DESC, query LIMIT 5) UNION ALL SELECT * FROM (SELECT 'bottom', query FROM q ORDER BY new, valid, valid::DOUBLE / n, query LIMIT 5)""")
def top_and_bottom(spark: SparkSession, d: str) -> DataFrame:
    """The five best and the five worst queries."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    q = table(spark, d, "events").groupBy(F.col("user_id").alias("query")).agg(kind("view").alias("new"), kind("click").alias("valid"), F.count("*").alias("n")).where("n >= 10").withColumn("rate", F.col("valid") / F.col("n"))
    keys = [F.col("new"), F.col("valid"), F.col("rate")]
    top = q.orderBy(*[k.desc() for k in keys], "query").limit(5).select(F.lit("top").alias("side"), "query")
    return top.unionByName(q.orderBy(*keys, "query").limit(5).select(F.lit("bottom").alias("side"), "query"))


@query("""SELECT c_mktsegment AS platform, floor(n * 1000.0 / total + 0.5) / 10 AS rate, n FROM (SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 5000) AS n, count(*) AS total FROM customer GROUP BY 1) ORDER BY rate DESC, n DESC, platform LIMIT 1""")
def leading_platform(spark: SparkSession, d: str) -> DataFrame:
    """The platform with the highest rate, then the most cases."""
    q = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("platform")).agg(F.count_if(F.col("c_acctbal") > 5000).alias("n"), F.count("*").alias("total"))
    rate = F.floor(F.col("n") * 1000.0 / F.col("total") + 0.5) / 10
    return q.select("platform", rate.alias("rate"), "n").orderBy(F.col("rate").desc(), F.col("n").desc(), "platform").limit(1)


_ORDER_SQL = f"""CASE priority WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END, CASE risk WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, CASE WHEN report THEN 0 ELSE 1 END,
  CASE evidence WHEN '{cases.TO_DO}' THEN 0 WHEN '{cases.FEW}' THEN 1 WHEN '{cases.SOME}' THEN 2 ELSE 3 END, CASE WHEN ui = 'done' THEN 1 ELSE 0 END, seen_at DESC NULLS LAST, id"""


@query(f"WITH {CASES_SQL} SELECT id, priority, risk FROM (SELECT * FROM c ORDER BY {_ORDER_SQL} LIMIT 100)")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred cases by the seven keys of the review."""
    c = F.col
    return review_cases(spark, d).orderBy(*cases.review_order(c("priority"), c("risk"), c("report"), c("evidence"), c("ui") == "done", c("at"), c("id"))).limit(100).select("id", "priority", "risk")


@query(f"WITH {CASES_SQL} SELECT id FROM (SELECT * FROM c WHERE {_VIEWS_SQL['priorityEvidence']} ORDER BY {_ORDER_SQL} LIMIT 5)")
def priority_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first five cases for which evidence is missing most."""
    c = F.col
    named = cases.views(c("ui"), c("evidence"), c("risk"), c("report"), c("public"), c("personal"), c("priority"), c("state"))
    order = cases.review_order(c("priority"), c("risk"), c("report"), c("evidence"), c("ui") == "done", c("at"), c("id"))
    return review_cases(spark, d).where(named["priorityEvidence"]).orderBy(*order).limit(5).select("id")


@query(f"WITH {CASES_SQL} SELECT id, row_number() OVER (ORDER BY CASE risk WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, published DESC NULLS LAST, id) AS place FROM (SELECT *, CASE WHEN state = 'published' THEN seen_at END AS published FROM c) ORDER BY place LIMIT 60")
def public_order(spark: SparkSession, d: str) -> DataFrame:
    """The first sixty public cases by risk, then by publication, the unpublished last."""
    order = [rank_in(F.col("risk"), cases.RISKS), F.col("published").desc_nulls_last(), F.col("id")]
    first = review_cases(spark, d).withColumn("published", F.when(F.col("state") == "published", F.col("at"))).orderBy(*order).limit(60)
    return first.select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("""WITH s AS (SELECT event_id, user_id, (CASE WHEN user_id % 5 = 0 THEN 40 ELSE 0 END + CASE event_type WHEN 'purchase' THEN 30 WHEN 'click' THEN 15 ELSE 0 END + CASE WHEN ts >= TIMESTAMP '2024-01-20' THEN 20 ELSE 0 END)::INTEGER AS score, ts FROM events)
SELECT event_id, score FROM (SELECT * FROM s ORDER BY score DESC, ts DESC, event_id LIMIT 50)""")
def dispatch_order(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty to be diagnosed, by points for organization, queue and recency, then the newest; one order over all pages."""
    points = F.when(F.col("user_id") % 5 == 0, 40).otherwise(0) + F.when(F.col("event_type") == "purchase", 30).when(F.col("event_type") == "click", 15).otherwise(0) + F.when(F.col("ts").cast("timestamp") >= moment("2024-01-20"), 20).otherwise(0)
    return table(spark, d, "events").withColumn("score", points.cast("int")).orderBy(F.col("score").desc(), F.col("ts").desc(), "event_id").limit(50).select("event_id", "score")


@query("""WITH s AS (SELECT s_suppkey AS id, (['A', 'B', 'C'])[1 + s_nationkey % 3] AS priority, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (s_suppkey * 7 % 900) AS next_crawl_at, s_suppkey % 7 = 0 AS running, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'ok' ELSE 'bad' END AS review FROM supplier)
SELECT id, priority, next_crawl_at FROM s WHERE next_crawl_at <= TIMESTAMP '2024-01-20 12:00:00' AND NOT running AND (review = 'ok' OR review IS NULL) ORDER BY priority, next_crawl_at, id LIMIT 8""")
def due_sites(spark: SparkSession, d: str) -> DataFrame:
    """The eight sites that are next in turn."""
    key = F.col("s_suppkey")
    hours = F.timestamp_add("HOUR", (key * 7 % 900).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = table(spark, d, "supplier").select(
        key.alias("id"), F.element_at(F.array(*[F.lit(x) for x in "ABC"]), (F.col("s_nationkey") % 3 + 1).cast("int")).alias("priority"), hours.alias("next_crawl_at"),
        F.when(key % 7 == 0, "running").otherwise("idle").alias("crawl_status"), F.when(key % 3 == 1, "ok").when(key % 3 == 2, "bad").alias("review"),
    )
    return collecting.due_sites(rows, F.lit(NOW).cast("timestamp_ntz"), 8, "id").select("id", "priority", "next_crawl_at")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 AND s_suppkey % 90 <= 60 THEN 'A' ELSE (['B', 'C'])[1 + s_suppkey % 2] END AS priority FROM supplier""")
def boosted_priorities(spark: SparkSession, d: str) -> DataFrame:
    """A higher priority for sites that had a form within sixty days."""
    key = F.col("s_suppkey")
    found = F.when(key % 4 == 0, F.date_sub(F.lit("2024-01-20").cast("date"), (key % 90).cast("int")).cast("timestamp"))
    base = F.element_at(F.array(F.lit("B"), F.lit("C")), (key % 2 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", collecting.boosted(base, found, moment("2024-01-20")).alias("priority"))


@query("""SELECT event_id FROM events WHERE event_type = 'click' AND value > 20 AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ORDER BY ts DESC, event_id LIMIT 20""")
def filtered_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of twenty rows after all filters, so that none comes up short."""
    ok = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").where("event_type = 'click' and value > 20").join(ok, "user_id", "left_semi").orderBy(F.col("ts").desc(), "event_id").limit(20).select("event_id")


@query("""WITH l AS (SELECT o_custkey AS source, o_orderkey % 1000 AS target, max(o_totalprice) AS score FROM orders GROUP BY ALL), s AS (SELECT c_custkey AS seed FROM customer WHERE c_custkey < 15),
a AS (SELECT seed, target AS node, max(score) AS score FROM s JOIN l ON source = seed WHERE target <> seed GROUP BY ALL), b AS (SELECT a.seed, target AS node, max(l.score) AS score FROM a JOIN l ON source = node WHERE target <> a.seed AND NOT EXISTS (SELECT 1 FROM a x WHERE x.seed = a.seed AND x.node = target) GROUP BY ALL),
u AS (SELECT seed, seed AS node, 0 AS depth, 'inf'::DOUBLE AS score FROM s UNION ALL SELECT seed, node, 1, score FROM a UNION ALL SELECT seed, node, 2, score FROM b)
SELECT seed, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, depth, node) AS r FROM u) WHERE r <= 24""")
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl two links deep visits from each of its seeds, the best twenty-four."""
    links = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 1000).alias("target")).agg(F.max("o_totalprice").alias("score"))
    return queue.frontier(links, table(spark, d, "customer").where("c_custkey < 15").select(F.col("c_custkey").alias("seed")), 2, 24)


# --- sets, queues and nested values --------------------------------------------------------------------------------


@query("""SELECT conv_id, array_to_string(list_distinct_ordered, ',') AS roles FROM (SELECT conv_id, list_filter(roles, lambda x, i: list_position(roles, x) = i) AS list_distinct_ordered FROM (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1))""")
def distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The distinct values of a group in the order in which they first appear, from a grouped minimum."""
    first = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    return first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r")).select("conv_id", F.array_join("r.role", ",").alias("roles"))


@query("""WITH l AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages), t AS (SELECT page_id, [url, 'https://other.example.com/x', url || '/more'] AS seeds, host FROM l)
SELECT page_id, len(list_filter(seeds, lambda u: regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) = host)) AS kept, len(list_filter(seeds, lambda u: regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) <> host)) AS rejected FROM t""")
def seeds_by_origin(spark: SparkSession, d: str) -> DataFrame:
    """Seeds of a site parted into those of its own host and others."""
    host = lambda u: F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1)
    rows = table(spark, d, "pages").select("page_id", host(F.col("url")).alias("host"), F.array("url", F.lit("https://other.example.com/x"), F.concat("url", F.lit("/more"))).alias("seeds"))
    return rows.select("page_id", F.size(F.filter("seeds", lambda u: host(u) == F.col("host"))).cast("long").alias("kept"), F.size(F.filter("seeds", lambda u: host(u) != F.col("host"))).cast("long").alias("rejected"))


@query("""WITH r AS (SELECT p_partkey AS query, CASE WHEN p_size > 40 THEN 'date' WHEN p_size > 25 THEN 'sim' ELSE 'rest' END AS pool, row_number() OVER (PARTITION BY CASE WHEN p_size > 40 THEN 'date' WHEN p_size > 25 THEN 'sim' ELSE 'rest' END ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
SELECT query, pool FROM (SELECT *, row_number() OVER (ORDER BY CASE pool WHEN 'date' THEN 0 WHEN 'sim' THEN 1 ELSE 2 END, r) AS place FROM r WHERE r <= CASE pool WHEN 'date' THEN 15 WHEN 'sim' THEN 10 ELSE 100 END) WHERE place <= 40""")
def catalog_selection(spark: SparkSession, d: str) -> DataFrame:
    """Queries from one pool, the next and the rest without overlap, each pool up to its quota, all up to a budget."""
    pool = F.when(F.col("p_size") > 40, "date").when(F.col("p_size") > 25, "sim").otherwise("rest")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("query"), pool.alias("pool"), "p_retailprice")
    place = F.row_number().over(Window.partitionBy("pool").orderBy(F.col("p_retailprice").desc(), "query"))
    quota = first_match([(F.col("pool") == "date", F.lit(15)), (F.col("pool") == "sim", F.lit(10))], F.lit(100))
    within = rows.withColumn("place", place).where(F.col("place") <= quota)
    return within.orderBy(rank_in(F.col("pool"), ("date", "sim", "rest")), "place").limit(40).select("query", "pool")


@query("""WITH j AS (SELECT event_id AS job_id, user_id AS external_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END AS status, 'w' || (event_id % 3)::VARCHAR AS locked_by, ts FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'),
k AS (SELECT *, CASE WHEN status = 'running' AND ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 43200 SECONDS THEN 'failed' ELSE status END AS s FROM j), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY ts DESC, job_id DESC) AS r FROM k) WHERE r = 1),
f AS (SELECT count(*) AS running FROM k WHERE s = 'running'), q AS (SELECT c_custkey AS external_id, 'w1' AS worker FROM customer UNION ALL SELECT c_custkey, 'w2' FROM customer WHERE c_nationkey < 5),
t AS (SELECT q.external_id, worker, job_id, running, CASE WHEN job_id IS NULL THEN 'not_found' WHEN s IN ('completed', 'failed', 'limited', 'cancelled') THEN 'returned' WHEN s = 'running' AND locked_by <> worker THEN 'held' WHEN s = 'running' THEN 'claimed'
  WHEN row_number() OVER (PARTITION BY q.external_id ORDER BY worker) > 1 THEN 'held' END AS o FROM q LEFT JOIN n USING (external_id), f)
SELECT external_id, worker, job_id, coalesce(o, CASE WHEN row_number() OVER (PARTITION BY o ORDER BY external_id, worker) <= 10 THEN 'claimed' ELSE 'no_slot' END) AS outcome FROM t""")
def claims_by_id(spark: SparkSession, d: str) -> DataFrame:
    """What each request for a job by its id comes to, with ten slots more than jobs that run."""
    status = first_match([(F.col("event_type") == k, F.lit(v)) for k, v in (("purchase", "completed"), ("error", "failed"), ("click", "running"))], "pending")
    at = F.col("ts").cast("timestamp")
    jobs = table(spark, d, "events").where(at <= moment(NOW)).select(F.col("event_id").alias("job_id"), F.col("user_id").alias("external_id"), status.alias("status"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("locked_by"), at.alias("locked_at"), at.alias("created_at"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("external_id"), F.explode(F.when(F.col("c_nationkey") < 5, F.array(F.lit("w1"), F.lit("w2"))).otherwise(F.array(F.lit("w1")))).alias("worker"))
    live = jobs.where((F.col("status") == "running") & ~dates.stale(F.col("locked_at"), moment(NOW), 43_200)).count()
    return queue.claim_by_id(jobs, asked, moment(NOW), 43_200, live + 10)


@query("""WITH r AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status, ts FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'), k AS (SELECT *, CASE WHEN status = 'running' AND ts < TIMESTAMP '2024-01-20 06:00:00' THEN 'failed' ELSE status END AS s FROM r)
SELECT s AS status, count(*) AS n, (SELECT CASE WHEN count(*) FILTER (WHERE s = 'running') > 0 THEN 'conflict' ELSE 'acquired' END FROM k) AS lock FROM k GROUP BY 1""")
def run_lock(spark: SparkSession, d: str) -> DataFrame:
    """Runs after the stale ones have failed, and whether a new one may start."""
    at = F.col("ts").cast("timestamp")
    runs = table(spark, d, "events").where(at <= moment(NOW)).select(F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), at.alias("started_at"))
    after = queue.recover_runs(runs, moment(NOW), 6 * 3600)
    return queue.with_lock(after.groupBy("status").agg(F.count("*").alias("n")), "lock")


@query("""SELECT event_id, json_object('k', (props::JSON -> 'k'), 'who', json_object('kind', event_type), 'list', json_array(event_id, 'token'))::VARCHAR AS cleaned FROM events""")
def sanitized_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON text without the fields that must not leave, at its top and in its objects."""
    written = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "Token": {"a": [1, "}"]}, "who": {"kind": "'), "event_type", F.lit('", "secret": "'), F.col("user_id").cast("string"), F.lit('"}, "list": ['), F.col("event_id").cast("string"), F.lit(', "token"], "secret": null}'))
    return table(spark, d, "events").select("event_id", text.without_keys(written, ("token", "secret")).alias("cleaned"))


@query("""SELECT conv_id, (count(*) FILTER (WHERE role = 'user'))::BIGINT AS user, (count(*) FILTER (WHERE role = 'assistant'))::BIGINT AS assistant, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations GROUP BY 1""")
def turns_as_map(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of turns by role as a map made from entries, and the summed lengths of a flattened array of texts."""
    counts = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    rows = counts.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"), F.sum("chars").alias("chars"))
    of = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(k)
    return rows.select("conv_id", of("user"), of("assistant"), "chars")


@query("""SELECT user_id, min_by(event_id, (ts, event_id)) AS first_event, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3 OR event_type = 'error' GROUP BY 1""")
def known_keys(spark: SparkSession, d: str) -> DataFrame:
    """First sights of keys and later errors of them."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, d, "events").withColumn("place", place).where("place <= 3 or event_type = 'error'")
    return rows.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.count("*").alias("n"))


@query("""SELECT DISTINCT page_id AS link FROM pages JOIN lineitem ON l_partkey = page_id WHERE l_returnflag = 'R' AND length(url) > 20 ORDER BY link LIMIT 25 OFFSET 10""")
def official_page(spark: SparkSession, d: str) -> DataFrame:
    """One page of the links that an official source names, each once."""
    named = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("page_id")).distinct()
    rows = table(spark, d, "pages").where(F.length("url") > 20).join(named, "page_id", "left_semi")
    return rows.orderBy("page_id").offset(10).limit(25).select(F.col("page_id").alias("link"))


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1 AND o_orderstatus <> 'P'""")
def terminal_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each key, where it is a final one."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return latest_per_key(rows, ["o_custkey"], "o_orderdate", "o_orderkey").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", "o_orderstatus")
