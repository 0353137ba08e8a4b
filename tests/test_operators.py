import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate, automaton, joins, select, sets, state, topk

T0 = dt.datetime(2026, 1, 1)


def test_latest_per_key_with_ties_and_nulls(spark):
    rows = [("a", 1, T0), ("a", 2, T0), ("a", 3, None), ("b", 4, None), (None, 5, T0)]
    df = spark.createDataFrame(rows, "k string, id long, at timestamp")
    assert {(r.k, r.id) for r in select.latest_per_key(df, ["k"], "at", "id").collect()} == {("a", 1), ("b", 4), (None, 5)}
    assert select.latest_per_key(df.where("false"), ["k"], "at", "id").collect() == []


def test_status_fold_depends_on_order(spark):
    assert [r.s for r in spark.createDataFrame([("closed", "active"), ("active", "restricted"), (None, "stale"), ("stale", "discovered"), ("active", None)], "o string, n string").select(state.next_status(F.col("o"), F.col("n")).alias("s")).collect()] == ["closed", "active", "stale", "stale", "active"]
    rows = [("x", 1, "active"), ("x", 2, "unreachable"), ("y", 1, "unreachable"), ("y", 2, "active")]
    df = spark.createDataFrame(rows, "k string, at long, status string").withColumn("id", F.col("at"))
    assert {(r.k, r.status) for r in state.fold_status(df, ["k"], "at", "id", "status").collect()} == {("x", "unreachable"), ("y", "active")}


def test_merge_of_sightings_is_that_of_all_events(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.randrange(20), rng.randrange(1000)) for _ in range(500)], "k long, at long").cache()
    whole = state.sightings(df, ["k"], "at").collect()
    parts = state.merge_sightings(state.sightings(df.where("at < 300"), ["k"], "at"), state.sightings(df.where("at >= 300"), ["k"], "at"), ["k"])
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts.collect()))


def test_caps_slots_and_diversity(spark):
    df = spark.createDataFrame([(k, "ABC"[k % 3], 100 - k) for k in range(30)], "id long, c string, score long")
    order = [F.col("score").desc(), F.col("id")]
    taken = topk.capped_classes(df, "c", {"A": 4, "B": 5}, 7, order, "id").where("taken").collect()
    assert sorted(r.id for r in taken) == [0, 1, 3, 4, 6, 7, 9]
    assert sorted(r.id for r in topk.diverse_pick(df, "c", order, 4).collect()) == [0, 1, 2, 3]
    outcomes = {r.id: r.outcome for r in topk.admit(df, order, 3, 2, "id").collect()}
    assert sorted(k for k, v in outcomes.items() if v == "admitted") == [0, 1] and outcomes[2] == "daily_limit"
    assert topk.capped_classes(df.where("false"), "c", {"A": 4}, 7, order, "id").collect() == []


def test_sets_and_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    assert {tuple(r) for r in sets.union_by_key([a, b], ["k"]).collect()} == {(1, "x"), (2, "y"), (None, "n"), (3, "w")}
    assert {tuple(r) for r in sets.append_missing(a, b, ["k"]).collect()} == {(1, "x"), (2, "y"), (None, "n"), (3, "w")}
    assert {tuple(r) for r in sets.without(a, [b], ["k"]).collect()} == {(1, "x"), (None, "n")}
    texts = spark.createDataFrame([(1, "the City Hall of x"), (2, None), (3, "nothing")], "id long, t string")
    entries = spark.createDataFrame([("city",), ("city hall",), ("hall of fame",)], "key string")
    assert {r.id: r.matched for r in joins.longest_contained(texts, "t", ["id"], entries).collect()} == {1: "city hall", 2: None, 3: None}
    assert {r.k: r.n for r in aggregate.dense_counts(a, F.col("v"), ("x", "q"), "k", "rest").collect()} == {"x": 1, "q": 0, "rest": 2}


def test_claims_expire_stale_leases(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, "running", 0, None, at(0), at(0)), (2, "running", 0, None, at(0), at(990)), (3, "pending", 1, at(5), at(5), None), (4, "pending", 0, None, at(9), None), (5, "pending", 0, at(8), at(9), None)]
    jobs = spark.createDataFrame(rows, "job_id long, status string, priority int, queued_at timestamp, created_at timestamp, locked_at timestamp")
    plan = state.claim_plan(jobs, F.lit("2026-01-01 00:16:40").cast("timestamp"), 240, 2)
    assert {tuple(r) for r in plan.collect()} == {(1, "expire"), (5, "claim")}


def test_fold_of_spans_is_that_of_all_events_in_order(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(6), k, rng.choice([*state.STATUSES, None])) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, at long, status string").withColumn("id", F.col("at"))
    keep, want = state.KEEPS, {}
    for k, _, new in rows:
        old = want.get(k)
        want[k] = old if new is None else new if old is None or old not in keep[new] else old
    for span in (None, F.floor(F.col("at") / 37)):
        assert {r.k: r.status for r in state.fold_status(df, ["k"], "at", "id", "status", span).collect()} == want


@pytest.mark.parametrize("most", [automaton.MOST_BYTES, 0])
def test_contained_entries_are_substrings_in_any_script(spark, monkeypatch, most):
    monkeypatch.setattr(automaton, "MOST_BYTES", most)
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("서울시청a b") for _ in range(n))
    texts = [(k, draw(rng.randrange(40))) for k in range(60)] + [(60, None), (61, "")]
    entries = sorted({draw(rng.randrange(2, 5)) for _ in range(188)} - {""})
    df, known = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(e,) for e in entries], "key string")
    want = {k: min((e for e in entries if t and e in t), key=lambda e: (-len(e), e), default=None) for k, t in texts}
    assert {r.id: r.matched for r in joins.longest_contained(df, "t", ["id"], known).collect()} == want
    few = {k: min((e for e in entries[:20] if t and e in t), key=lambda e: (-len(e), e), default=None) for k, t in texts}
    assert {r.id: r.matched for r in joins.longest_contained(df, "t", ["id"], known.where(F.col("key").isin(entries[:20]))).collect()} == few


def test_nearest_rank_with_skew_ties_and_nulls(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(50)])) for _ in range(900)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    want = {}
    for k in {k for k, v in rows if v is not None}:
        own = sorted(v for key, v in rows if key == k and v is not None)
        want[k] = tuple(own[-(-len(own) * p // 100) - 1] for p in (50, 95, 99))
    assert {r.k: (r.p50, r.p95, r.p99) for r in aggregate.nearest_rank(df, ["k"], "v", (0.5, 0.95, 0.99), 7).collect()} == want
