import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, ranges, text
from tidemark.operators import questions, queue
from tidemark.plans.registry import QUERIES
from tidemark.sources import sinks

T0 = dt.datetime(2026, 1, 1)


def test_ranges_of_days():
    today = "2026-03-01"
    assert ranges.resolve_days(today) == ranges.Days("7d", "2026-02-23", today)
    assert ranges.resolve_days(today, "30D") == ranges.Days("30d", "2026-01-31", today)
    assert ranges.resolve_days(today, "today", "2026-02-02", "2026-01-01") == ranges.Days("custom", "2026-01-01", "2026-02-02")
    assert ranges.resolve_days(today, "7d", "2026-02-30", "2026-01-01").name == "7d"
    assert ranges.resolve_days_strictly(today, "all") == ranges.Days("all", None, None)
    for wrong in (("custom", None, None), (None, "2026-02-02", "2026-01-01")):
        with pytest.raises(ValueError):
            ranges.resolve_days_strictly(today, *wrong)
    assert [ranges.flag(x) for x in ("true", "0", None, "x")] == [True, False, None, None]


def test_fires_a_day():
    assert [ranges.fires_a_day(x) for x in ("*/15 * * * *", "0 6,18 * * *", "5 3 * * *", "* * * * *", "*/0 1 * * *", "bad")] == [96, 2, 1, 1440, 0, 0]


def test_categories_by_row_and_nulls(spark):
    rows = spark.createDataFrame([("메일링 리스트",), ("이메일",), ("전체 메일",), (None,), ("",)], "t string")
    assert [r.c for r in rows.where("t is not null").select(questions.detect_categories(F.col("t")).alias("c")).collect()] == [[], ["email"], ["email"], []]


def test_posted_days_and_periods_of_impossible_days(spark):
    rows = spark.createDataFrame([("posted 2026.02.30",), ("posted 2026.02.32",), ("2026.01.05 ~ 01.09 2026.02.01 ~ 02.03",), ("",)], "t string")
    got = rows.select(dates.posted_day(F.col("t")).alias("p"), dates.periods(F.col("t"), 2026).alias("r")).collect()
    assert [r.p for r in got] == ["2026-02-30", None, None, None]
    assert (got[2].r.first_day, got[2].r.last_day) == ("2026-01-05", "2026-02-03")


def test_latin_letters(spark):
    rows = spark.createDataFrame([("한글",), ("A 1!",), ("",), (None,)], "t string")
    assert [r.t for r in rows.select(text.romanized(F.col("t")).alias("t")).collect()] == ["hangeul", "a1", "", None]


def test_claims_holds_and_slots(spark):
    jobs = spark.createDataFrame(
        [(1, "a", "running", "w1", T0, T0), (2, "b", "running", "w2", T0, T0), (3, "c", "pending", None, None, T0), (4, "c", "completed", None, None, T0 - dt.timedelta(1)), (5, "d", "failed", None, None, T0), (6, "e", "running", "w2", T0 - dt.timedelta(1), T0)],
        "job_id long, external_id string, status string, locked_by string, locked_at timestamp, created_at timestamp",
    )
    asked = spark.createDataFrame([(x, "w1") for x in "abcdef"], "external_id string, worker string")
    now = F.lit(T0 + dt.timedelta(seconds=60))
    told = lambda most: {r.external_id: r.outcome for r in queue.claim_by_id(jobs, asked, now, 120, most).collect()}
    assert told(3) == {"a": "claimed", "b": "held", "c": "claimed", "d": "returned", "e": "returned", "f": "not_found"}
    assert told(2)["c"] == "no_slot" and told(2)["a"] == "claimed"


def test_time_to_live_and_pending(spark):
    rows = spark.createDataFrame([("a", 1, T0), ("a", 2, T0), ("b", 3, T0 - dt.timedelta(2)), (None, 4, T0)], "k string, id long, at timestamp")
    got = queue.latest_within(rows, ["k"], "at", "id", F.lit(T0), 86_400).collect()
    assert {(r.k, r.id) for r in got} == {("a", 2), (None, 4)}
    ends = spark.createDataFrame([("a", T0)], "k string, at timestamp")
    assert [r.k for r in queue.pending(rows.where("k is not null"), ends, "k", F.lit(T0), 3 * 86_400).collect()] == ["b"]


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, 'a"b')], "n long, t string").coalesce(1), str(tmp_path / "out"), bom=True)
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_bytes().decode() == '\ufeffn,t\n1,"a""b"\n'


def test_each_pattern_of_a_question_is_tried_once(spark, sf_dir):
    text = F.col("t")
    rows = spark.createDataFrame([("이름",), (None,)], "t string")
    tried = lambda *columns: rows.select(*columns)._jdf.queryExecution().optimizedPlan().toString().count("담당자명")
    assert tried(questions.detect_categories(text).alias("c")) == 1
    assert tried(questions.full_question_level(text, F.lit(None).cast("string"), F.lit("radio"), F.lit(True)).alias("l")) == 1
    assert QUERIES["question_categories"](spark, sf_dir).rdd.getNumPartitions() > 1
