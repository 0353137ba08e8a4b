"""Row selection: keys, ranks, caps, joins by membership, set operations and keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import rank_in
from tidemark.operators import joins, select, sets, state, topk
from tidemark.plans.base import query, table

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000) GROUP BY 1""")
def eligible_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Findings of eligible orders alone."""
    eligible = table(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 250000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(eligible, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')""")
def blocked_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an open order."""
    blocked = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(blocked, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT c_custkey, o_orderkey, o_orderdate, o_totalprice FROM customer JOIN
  (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r = 1 WHERE c_acctbal > 0""")
def lateral_latest(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's latest order; customers without one go."""
    latest = select.latest_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], "o_orderdate", "o_orderkey")
    rows = table(spark, d, "customer").where("c_acctbal > 0").join(latest, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("c_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


@query("""SELECT user_id, event_type, event_id, ts, value FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user and kind."""
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return select.latest_per_key(rows, ["user_id", "event_type"], "ts", "event_id")


@query("""SELECT o_custkey, arg_min(o_orderpriority, o_orderpriority) AS best FROM orders GROUP BY 1""")
def best_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's most urgent priority."""
    return select.best_by_rank(table(spark, d, "orders"), ["o_custkey"], rank_in(F.col("o_orderpriority"), PRIORITIES), "o_orderpriority", "best")


@query("""SELECT l_orderkey, array_to_string(list_slice(list_sort(list(DISTINCT p_brand)), 1, 3), ',') AS labels FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def first_n_distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    """Up to three labels of each order."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    return select.first_distinct(rows, ["l_orderkey"], "p_brand", "labels", 3)


@query("""WITH g AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'return' WHEN l_discount > 0.09 THEN 'discount' ELSE 'other' END AS label, p_brand, count(*) AS findings, count(DISTINCT l_orderkey) AS affected
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
s AS (SELECT * FROM g WHERE label <> 'other' ORDER BY affected DESC, findings DESC, label, p_brand LIMIT 10),
o AS (SELECT * FROM g WHERE label = 'other' ORDER BY affected DESC, findings DESC, p_brand LIMIT 3)
SELECT * FROM s UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM s)""")
def issue_topk_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The ten issues that affect most; only where there is none, the three largest of the rest."""
    label = F.when(F.col("l_returnflag") == "R", "return").when(F.col("l_discount") > 0.09, "discount").otherwise("other")
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    g = rows.groupBy(label.alias("label"), "p_brand").agg(F.count("*").alias("findings"), F.count_distinct("l_orderkey").alias("affected"))
    order = [F.col("affected").desc(), F.col("findings").desc(), "label", "p_brand"]
    named = g.where("label <> 'other'").orderBy(*order).limit(10)
    rest = g.where("label = 'other'").orderBy(*order).limit(3)
    n = named.agg(F.count("*").alias("_n"))
    return named.unionByName(rest.join(F.broadcast(n)).where("_n = 0").drop("_n"))


@query("""WITH a AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderpriority = '1-URGENT'),
b AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderpriority = '2-HIGH'),
n AS (SELECT least(100, count(*)) AS na FROM a)
SELECT o_orderkey, o_orderpriority, r <= 100 AS taken FROM a UNION ALL
SELECT o_orderkey, o_orderpriority, r <= least(20, 110 - na) AS taken FROM b, n""")
def capped_topk_overflow(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders up to their cap, high ones up to theirs and what the total leaves; the rest overflows."""
    rows = table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    out = topk.capped_classes(rows, "o_orderpriority", {"1-URGENT": 100, "2-HIGH": 20}, 110, [F.col("o_totalprice").desc(), F.col("o_orderkey")], "o_orderkey")
    return out.select("o_orderkey", "o_orderpriority", "taken")


@query("""WITH r AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS p FROM supplier)
SELECT s_suppkey, s_nationkey, s_acctbal FROM r ORDER BY CASE WHEN p = 1 THEN 0 ELSE 1 END, s_acctbal DESC, s_suppkey LIMIT 30""")
def platform_diversity_pick(spark: SparkSession, d: str) -> DataFrame:
    """Thirty suppliers, one of every nation before any second."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return topk.diverse_pick(rows, "s_nationkey", [F.col("s_acctbal").desc(), F.col("s_suppkey")], 30)


@query("""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) <= 40 THEN 'admitted' ELSE 'no_slot' END AS outcome FROM orders WHERE o_orderstatus = 'O'""")
def slot_limited_admission(spark: SparkSession, d: str) -> DataFrame:
    """Open orders in turn while slots and the day's budget last."""
    rows = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return topk.admit(rows, [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], 40, 60, "o_orderkey").select("o_orderkey", "outcome")


@query("""SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice FROM orders
ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 50""")
def multi_key_rank_sort(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty by custom ranks of several keys."""
    order = [rank_in(F.col("o_orderpriority"), ("2-HIGH", "1-URGENT")), rank_in(F.col("o_orderstatus"), ("O", "P")), F.col("o_totalprice").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return table(spark, d, "orders").orderBy(*order).limit(50).select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("""WITH q AS (SELECT event_id, CASE WHEN value < 20 THEN NULL ELSE ts END AS queued_at, ts, event_type FROM events WHERE event_type <> 'error')
SELECT event_id FROM q ORDER BY event_type, queued_at ASC NULLS LAST, ts, event_id LIMIT 25""")
def nulls_last_claim_order(spark: SparkSession, d: str) -> DataFrame:
    """Whom a worker would claim next: by class, queue time with nulls last, then age."""
    q = table(spark, d, "events").where("event_type <> 'error'").withColumn("queued_at", F.when(F.col("value") >= 20, F.col("ts")))
    return q.orderBy("event_type", F.col("queued_at").asc_nulls_last(), "ts", "event_id").limit(25).select("event_id")


@query("""SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 80""")
def paged_scan(spark: SparkSession, d: str) -> DataFrame:
    """One page of an ordered listing."""
    return table(spark, d, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(80).limit(40).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query("""WITH f AS (SELECT o_orderkey AS id, 'finished' AS via FROM orders WHERE o_orderstatus = 'F'),
p AS (SELECT o_orderkey AS id, 'price' AS via FROM orders WHERE o_totalprice > 400000),
u AS (SELECT *, 1 AS k FROM f UNION ALL SELECT *, 2 AS k FROM p)
SELECT id, arg_min(via, k) AS via FROM u GROUP BY id""")
def union_dedupe_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Two searches together, each id as the first of them has it."""
    o = table(spark, d, "orders")
    one = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("finished").alias("via"))
    two = o.where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id"), F.lit("price").alias("via"))
    return sets.union_by_key([one, two], ["id"])


@query("""SELECT c_custkey, 'listed' AS origin FROM customer WHERE c_acctbal > 5000 UNION ALL
SELECT DISTINCT o_custkey, 'ordered' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def append_missing(spark: SparkSession, d: str) -> DataFrame:
    """A list and those that it lacks."""
    listed = table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey", F.lit("listed").alias("origin"))
    ordered = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit("ordered").alias("origin")).distinct()
    return sets.append_missing(listed, ordered, ["c_custkey"])


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08 AND l_linenumber = 7)""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Keys that neither of two sets holds."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_discount", "l_quantity", "l_linenumber")
    return sets.without(table(spark, d, "part").select("p_partkey"), [lines.where("l_returnflag = 'R' and l_quantity > 45"), lines.where("l_discount > 0.08 and l_linenumber = 7")], ["p_partkey"])


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS in_window,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) > 2 AS limited FROM events""")
def sliding_window_rate(spark: SparkSession, d: str) -> DataFrame:
    """Starts of each user in the six hours before each one, and whether that is too many."""
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return state.trailing_count(rows, "user_id", "at", 6 * 3600).select("event_id", "user_id", "in_window", (F.col("in_window") > 2).alias("limited"))


@query("""SELECT l_partkey, l_suppkey, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen, count(*) AS seen_count FROM lineitem GROUP BY ALL""")
def upsert_first_last_count(spark: SparkSession, d: str) -> DataFrame:
    """Sightings by key from two batches merged one after the other."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_linenumber")
    keys = ["l_partkey", "l_suppkey"]
    early, late = (state.sightings(rows.where(c), keys, "l_shipdate") for c in ("l_linenumber <= 3", "l_linenumber > 3"))
    return state.merge_sightings(early, late, keys)


def _status_sql() -> str:
    s = "CASE event_type WHEN 'view' THEN 'discovered' WHEN 'click' THEN 'active' WHEN 'error' THEN 'unreachable' WHEN 'purchase' THEN 'restricted' ELSE 'stale' END"
    return f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, {s} AS new FROM events),
f(user_id, r, status) AS (SELECT user_id, r, new FROM e WHERE r = 1 UNION ALL
  SELECT e.user_id, e.r, CASE
    WHEN new = 'active' AND status = 'closed' THEN status WHEN new = 'restricted' AND status IN ('active', 'closed') THEN status
    WHEN new = 'unreachable' AND status IN ('closed', 'restricted', 'ignored', 'stale') THEN status
    WHEN new = 'discovered' AND status IN ('invalid', 'ignored', 'stale', 'active', 'closed', 'restricted') THEN status
    WHEN new = 'stale' AND status IN ('closed', 'restricted') THEN status ELSE new END
  FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT user_id, arg_max(status, r) AS status FROM f GROUP BY user_id"""


@query(_status_sql())
def status_merge_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The state of each key after all its transitions in order."""
    names = F.create_map(*[F.lit(x) for kv in (("view", "discovered"), ("click", "active"), ("error", "unreachable"), ("purchase", "restricted")) for x in kv])
    rows = table(spark, d, "events").withColumn("status", F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("stale")))
    return state.fold_status(rows, ["user_id"], "ts", "event_id", "status", F.to_date("ts"))


@query("""WITH j AS (SELECT event_id AS job_id, CASE WHEN value > 60 THEN 'running' ELSE 'pending' END AS status, ts FROM events WHERE event_type = 'signup')
SELECT job_id, 'expire' AS action FROM j WHERE status = 'running' AND ts < TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 3600 SECONDS
UNION ALL SELECT * FROM (SELECT job_id, 'claim' FROM j WHERE status = 'pending' ORDER BY ts, job_id
  LIMIT greatest(0, 40 - (SELECT count(*) FROM j WHERE status = 'running' AND NOT ts < TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 3600 SECONDS)))""")
def claim_and_expire(spark: SparkSession, d: str) -> DataFrame:
    """Who would be claimed next, and which stale leases end."""
    jobs = table(spark, d, "events").where("event_type = 'signup'").select(
        F.col("event_id").alias("job_id"), F.when(F.col("value") > 60, "running").otherwise("pending").alias("status"), F.lit(0).alias("priority"),
        F.col("ts").cast("timestamp").alias("queued_at"), F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("locked_at"),
    )
    return state.claim_plan(jobs, F.lit("2024-01-29 00:00:00").cast("timestamp"), 3600, 40)


@query("""WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN o_custkey END AS c, o_orderkey FROM orders)
SELECT id, coalesce(c, l_suppkey, -1) AS c FROM l LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def fallback_key_join(spark: SparkSession, d: str) -> DataFrame:
    """A key, or where it is missing the one another table knows."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 200000, F.col("o_custkey")).alias("c"), F.col("o_orderkey").alias("k"))
    mapping = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_suppkey").alias("c"))
    return joins.with_fallback_key(rows, "c", "k", mapping, "id").select("id", F.coalesce("c", F.lit(-1)).alias("c"))


@query("""WITH e(k) AS (VALUES ('small ring'), ('ring'), ('widget'), ('red'), ('green gear'), ('blue')),
m AS (SELECT p_partkey, k, row_number() OVER (PARTITION BY p_partkey ORDER BY length(k) DESC, k) AS r FROM part JOIN e ON contains(p_name, k)),
b AS (SELECT p_partkey, p_name, p_type, p_brand FROM part)
SELECT b.p_partkey, coalesce(m.k, CASE WHEN p_type = 'ECONOMY' THEN 'economy' END, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'first brands' END) AS label,
  CASE WHEN m.k IS NOT NULL THEN 'name' WHEN p_type = 'ECONOMY' THEN 'type' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'brand' ELSE 'none' END AS tier
FROM b LEFT JOIN m ON m.p_partkey = b.p_partkey AND r = 1""")
def tiered_match(spark: SparkSession, d: str) -> DataFrame:
    """The longest entry that a name contains, else a label by type, else by brand."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    entries = spark.createDataFrame([(k,) for k in ("small ring", "ring", "widget", "red", "green gear", "blue")], "key string")
    by_name = joins.longest_contained(parts, "p_name", ["p_partkey"], entries).select("p_partkey", F.col("matched").alias("label"))
    by_type = parts.select("p_partkey", F.when(F.col("p_type") == "ECONOMY", "economy").alias("label"))
    by_brand = parts.select("p_partkey", F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "first brands").alias("label"))
    return joins.in_tiers(parts.select("p_partkey"), ["p_partkey"], [("name", by_name), ("type", by_type), ("brand", by_brand)], "label").select("p_partkey", "label", "tier")


@query("""WITH k(key) AS (SELECT DISTINCT lower(split_part(n_name, '_', 1)) || split_part(n_name, '_', 2) FROM nation)
SELECT a.s_suppkey, count(b.s_suppkey) AS peers, count(*) FILTER (WHERE b.s_acctbal > a.s_acctbal) AS ahead FROM supplier a LEFT JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1""")
def peer_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier against the others of its nation, by ranks instead of pairs."""
    group = Window.partitionBy("s_nationkey")
    ahead = F.rank().over(group.orderBy(F.col("s_acctbal").desc())) - 1
    return table(spark, d, "supplier").select("s_suppkey", (F.count("*").over(group) - 1).alias("peers"), ahead.cast("long").alias("ahead"))


@query("""WITH r AS (SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 0 WHEN s_acctbal > 0 THEN 1 ELSE 2 END AS stage, s_acctbal FROM supplier)
SELECT s_suppkey, stage::INTEGER AS stage FROM r ORDER BY stage, s_acctbal DESC, s_suppkey LIMIT 60""")
def budgeted_selection(spark: SparkSession, d: str) -> DataFrame:
    """A pool, then the next, then the rest, up to a budget."""
    stage = F.when(F.col("s_acctbal") > 5000, 0).when(F.col("s_acctbal") > 0, 1).otherwise(2)
    return table(spark, d, "supplier").withColumn("stage", stage).orderBy("stage", F.col("s_acctbal").desc(), "s_suppkey").limit(60).select("s_suppkey", "stage")


@query("""SELECT user_id, event_id, row_number() OVER w AS step, coalesce(floor((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0), -1)::BIGINT AS waited, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w::BIGINT AS errors
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def session_steps(spark: SparkSession, d: str) -> DataFrame:
    """A user's events in order, the whole seconds between them and the errors so far."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    waited = F.coalesce(F.floor((at - F.lag(at).over(w)) / 1e6), F.lit(-1))
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("step"), waited.alias("waited"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w).alias("errors"))
