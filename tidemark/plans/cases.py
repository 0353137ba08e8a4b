"""Rule chains over single rows: decisions, scores, grades, queues, priorities and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp, grade, half_up, lookup
from tidemark.functions.rules import additive, all_of, first_match, matched_names, rank_in, worst
from tidemark.operators import diagnosis
from tidemark.plans.base import query, table
from tidemark.plans.dashboards import SCORES_SQL, cents, item_scores

GRADES = ("safe", "caution", "risk", "high_risk")
TOOL_POINTS = {f"T{k}": points for k, points in enumerate(diagnosis.TOOL_POINTS.values())}


@query("""SELECT CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN 'limited' WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 'report'
  WHEN o_totalprice > 400000 THEN 'deny' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'check' WHEN o_orderstatus = 'O' THEN 'caution' ELSE 'safe' END AS decision, count(*) AS n FROM orders GROUP BY 1""")
def decision_case(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that holds decides."""
    s, p, x = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    rules = [((s == "P") & (x < 50000), "limited"), ((p == "1-URGENT") & (x > 300000), "report"), (x > 400000, "deny"), (p.isin("1-URGENT", "2-HIGH"), "check"), (s == "O", "caution")]
    return table(spark, d, "orders").groupBy(first_match(rules, "safe").alias("decision")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT o_orderkey, o_orderstatus, 'D' || (o_orderkey % 7)::VARCHAR AS data, 'T' || (o_custkey % 5)::VARCHAR AS tool, (o_orderkey % 4)::DOUBLE * 1.5 AS management, (o_custkey % 31)::BIGINT AS notice FROM orders),
p AS (SELECT *, CASE data WHEN 'D0' THEN 0 WHEN 'D1' THEN 3 WHEN 'D2' THEN 10 WHEN 'D3' THEN 20 WHEN 'D4' THEN 28 WHEN 'D5' THEN 35 ELSE 0 END AS a,
  greatest(0, CASE tool WHEN 'T0' THEN 0 WHEN 'T1' THEN 3 WHEN 'T2' THEN 8 WHEN 'T3' THEN 18 ELSE 12 END - CASE WHEN o_orderstatus = 'F' THEN 8 ELSE 0 END) AS b,
  least(CASE WHEN data IN ('D3', 'D4', 'D5') THEN 30 ELSE 18 END, notice) AS c, least(CASE WHEN data = 'D2' THEN 8 ELSE 15 END, management) AS m FROM l),
s AS (SELECT *, greatest(0.0, least(100.0, (100 - a - b - c)::DOUBLE - m::DOUBLE)) AS raw FROM p),
f AS (SELECT *, CASE WHEN data = 'D2' AND o_orderstatus = 'O' THEN greatest(70.0, least(80.0, raw)) WHEN data = 'D2' AND raw > 75 THEN 75.0 ELSE raw END AS score FROM s)
SELECT o_orderkey, score, CASE WHEN score >= 80 THEN 'safe' WHEN score >= 60 THEN 'caution' WHEN score >= 40 THEN 'risk' ELSE 'high_risk' END AS score_grade,
  CASE WHEN data = 'D5' THEN 'high_risk' WHEN data IN ('D3', 'D4') AND notice > 20 THEN CASE WHEN score < 40 THEN 'high_risk' ELSE 'risk' END
  ELSE CASE WHEN score >= 80 THEN 'safe' WHEN score >= 60 THEN 'caution' WHEN score >= 40 THEN 'risk' ELSE 'high_risk' END END AS final_grade FROM f""")
def score_clamp_grade(spark: SparkSession, d: str) -> DataFrame:
    """A score from deductions with caps by level, its grade, and the worst grade of that and the overrides."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("D"), (F.col("o_orderkey") % 7).cast("string")).alias("data"), F.concat(F.lit("T"), (F.col("o_custkey") % 5).cast("string")).alias("tool"), ((F.col("o_orderkey") % 4).cast("double") * 1.5).alias("management"), (F.col("o_custkey") % 31).alias("notice"))
    data, direct, quasi = F.col("data"), F.col("data").isin("D3", "D4", "D5"), F.col("data") == "D2"
    tool = F.greatest(F.lit(0), lookup(F.col("tool"), TOOL_POINTS, 0) - F.when(F.col("o_orderstatus") == "F", 8).otherwise(0))
    notice = F.least(F.when(direct, 30).otherwise(18), F.col("notice"))
    management = F.least(F.when(quasi, 8.0).otherwise(15.0), F.col("management"))
    raw = clamp((100 - lookup(data, diagnosis.DATA_POINTS, 0) - tool - notice).cast("double") - management, 0.0, 100.0)
    score = first_match([(quasi & (F.col("o_orderstatus") == "O"), clamp(raw, 70.0, 80.0)), (quasi & (raw > 75), F.lit(75.0))], raw)
    rows = rows.withColumn("score", score).withColumn("score_grade", grade(F.col("score")))
    overrides = [F.when(data == "D5", "high_risk"), F.when(data.isin("D3", "D4") & (F.col("notice") > 20), "risk")]
    return rows.select("o_orderkey", "score", "score_grade", worst([F.col("score_grade"), *overrides], GRADES).alias("final_grade"))


@query(f"""WITH {SCORES_SQL}
SELECT l_orderkey, (n_returned * 1.5 + (n_lines - n_returned) * 0.5 + CASE WHEN quantity > 20000 THEN 3 ELSE 0 END)::DOUBLE AS gap_score,
  floor((discount::DOUBLE / n_lines::DOUBLE) * 10 + 0.5) / 10 AS mean_discount FROM s""")
def weighted_gap_sum(spark: SparkSession, d: str) -> DataFrame:
    """Gaps weighted by class."""
    weighted = F.col("n_returned") * 1.5 + (F.col("n_lines") - F.col("n_returned")) * 0.5 + F.when(F.col("quantity") > 20000, 3.0).otherwise(0.0)
    return item_scores(spark, d).select("l_orderkey", weighted.cast("double").alias("gap_score"), half_up(F.col("discount") / F.col("n_lines"), 1).alias("mean_discount"))


@query("""WITH a AS (SELECT o_orderkey, floor(epoch_us(TIMESTAMP '2001-08-01' - o_orderdate) / 86400000000.0) AS age, o_orderpriority, o_orderstatus, o_totalprice FROM orders),
s AS (SELECT *, CASE WHEN age <= 60 THEN 40 WHEN age <= 180 THEN 15 WHEN age > 365 THEN -25 ELSE 0 END + CASE WHEN o_orderpriority = '1-URGENT' THEN 20 ELSE 0 END + CASE WHEN o_orderstatus = 'O' THEN 10 ELSE 0 END AS score FROM a)
SELECT o_orderkey, score::INTEGER AS score, CASE WHEN score >= 40 THEN 'recent_high' WHEN score >= 15 THEN 'recent_possible' WHEN score < 0 THEN 'likely_old' ELSE 'unknown' END AS recency,
  CASE WHEN o_totalprice > 400000 AND score >= 15 THEN 'A_PRIORITY' WHEN o_totalprice > 200000 OR score >= 40 THEN 'B_PRIORITY' ELSE 'C_ARCHIVE' END AS queue FROM s""")
def triage_queue(spark: SparkSession, d: str) -> DataFrame:
    """Points for age and signals, a recency class, and a queue by ordered thresholds."""
    age = F.floor((F.unix_micros(F.lit("2001-08-01").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86_400_000_000.0)
    rows = table(spark, d, "orders").withColumn("age", age)
    by_age = F.when(F.col("age") <= 60, 40).when(F.col("age") <= 180, 15).when(F.col("age") > 365, -25).otherwise(0)
    score = additive(0, [(F.col("o_orderpriority") == "1-URGENT", 20), (F.col("o_orderstatus") == "O", 10)]) + by_age
    rows = rows.withColumn("score", score.cast("int"))
    recency = first_match([(F.col("score") >= 40, "recent_high"), (F.col("score") >= 15, "recent_possible"), (F.col("score") < 0, "likely_old")], "unknown")
    queue = first_match([((F.col("o_totalprice") > 400000) & (F.col("score") >= 15), "A_PRIORITY"), ((F.col("o_totalprice") > 200000) | (F.col("score") >= 40), "B_PRIORITY")], "C_ARCHIVE")
    return rows.select("o_orderkey", "score", recency.alias("recency"), queue.alias("queue"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'O' THEN 'open' END, CASE WHEN o_totalprice > 300000 THEN 'high' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END,
  CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'recent' END, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN 'attention' END], lambda x: x IS NOT NULL), ',') AS views FROM orders""")
def dispatch_views(spark: SparkSession, d: str) -> DataFrame:
    """The named views that a row belongs to."""
    opened, high = F.col("o_orderstatus") == "O", F.col("o_totalprice") > 300000
    views = {"open": opened, "high": high, "urgent": F.col("o_orderpriority") == "1-URGENT", "recent": F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"), "attention": opened & high}
    return table(spark, d, "orders").select("o_orderkey", F.array_join(matched_names(views), ",").alias("views"))


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 AND contains(lower(c_name), '00001') AND c_nationkey <> 3""")
def admin_filter_chain(spark: SparkSession, d: str) -> DataFrame:
    """The conjunction of those predicates that are given."""
    search, minimum, maximum = "00001", 0.0, None
    given = [F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_acctbal") >= minimum, None if maximum is None else F.col("c_acctbal") <= maximum, F.contains(F.lower("c_name"), F.lit(search)), F.col("c_nationkey") != 3]
    return table(spark, d, "customer").where(all_of(given)).select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'retention' WHEN l_returnflag = 'R' THEN 'consent' WHEN l_linestatus = 'F' AND l_tax > 0.05 THEN 'transfer'
  WHEN l_discount = 0 THEN 'operator' ELSE 'other' END AS label,
  (CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'F' AND l_tax > 0.05 THEN 2 WHEN l_discount = 0 THEN 3 ELSE 4 END)::INTEGER AS place FROM lineitem WHERE l_quantity > 40""")
def issue_label(spark: SparkSession, d: str) -> DataFrame:
    """The label of a finding by ordered rules, and its place in the order of display."""
    r, o = F.col("l_returnflag") == "R", F.col("l_linestatus")
    label = first_match([(r & (o == "O"), "retention"), (r, "consent"), ((o == "F") & (F.col("l_tax") > 0.05), "transfer"), (F.col("l_discount") == 0, "operator")], "other")
    rows = table(spark, d, "lineitem").where("l_quantity > 40").withColumn("label", label)
    return rows.select("l_orderkey", "l_linenumber", "label", rank_in(F.col("label"), ("consent", "retention", "transfer", "operator")).alias("place"))


@query("""WITH f AS (SELECT l_orderkey AS id, floor(sum(floor(l_extendedprice * 100 + 0.5)::BIGINT)::DOUBLE / 10000 + 0.5)::BIGINT AS hundreds, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
SELECT id, 50 + CASE WHEN returned > 2 THEN 40 ELSE 0 END + CASE WHEN hundreds > 2000 THEN 25 ELSE 0 END + CASE WHEN returned = 0 THEN 5 ELSE 0 END AS priority FROM f
ORDER BY priority DESC, id LIMIT 80""")
def improvement_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first eighty by an additive priority."""
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(half_up(F.sum(cents("l_extendedprice")) / 10000).alias("hundreds"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    priority = additive(50, [(F.col("returned") > 2, 40), (F.col("hundreds") > 2000, 25), (F.col("returned") == 0, 5)])
    return f.select("id", priority.alias("priority")).orderBy(F.col("priority").desc(), "id").limit(80)


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class,
  'P-' || lpad((p_partkey % 1000 + 1)::VARCHAR, 4, '0') AS public_id, CASE p_type WHEN 'ECONOMY' THEN 'economy line' WHEN 'STANDARD' THEN 'standard line' ELSE 'other line' END AS label FROM part""")
def label_maps(spark: SparkSession, d: str) -> DataFrame:
    """Classes by bounds, padded numbers and labels by a small map."""
    size = first_match([(F.col("p_size") < 10, "small"), (F.col("p_size") < 30, "medium")], "large")
    public = F.concat(F.lit("P-"), F.lpad((F.col("p_partkey") % 1000 + 1).cast("string"), 4, "0"))
    label = lookup(F.col("p_type"), {"ECONOMY": "economy line", "STANDARD": "standard line"}, "other line")
    return table(spark, d, "part").select("p_partkey", size.alias("size_class"), public.alias("public_id"), label.alias("label"))
