import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import queue, sketches, temporal
from tidemark.sources import calls, hits, versions

T0 = dt.datetime(2026, 1, 1)


def now():
    return F.lit("2026-01-01 01:00:00").cast("timestamp")


JOBS = "job_id long, external_id string, status string, locked_by string, locked_at timestamp, created_at timestamp"


def test_as_many_claims_as_free_slots(spark):
    at = T0 + dt.timedelta(minutes=59)
    rows = [(k, f"r{k}", "running", "other", at, T0) for k in range(2)] + [(9, "gone", "running", "other", T0, T0)] + [(10 + k, f"x{k:02d}", "pending", None, None, T0) for k in range(20)]
    jobs = spark.createDataFrame(rows, JOBS)
    asked = spark.createDataFrame([(f"x{k:02d}", "w") for k in range(20)] + [("x00", "a"), ("r0", "other"), ("r1", "w"), ("gone", "w"), ("none", "w")], "external_id string, worker string")
    for most, n in ((3, 1), (2, 0), (7, 5), (100, 20)):
        got = {(r.external_id, r.worker): r.outcome for r in queue.claim_by_id(jobs, asked, now(), 240, most).collect()}
        new = sorted(k for k, v in got.items() if v == "claimed" and k[0].startswith("x"))
        assert len(new) == n and new == sorted([("x00", "a"), *[(f"x{k:02d}", "w") for k in range(1, 20)]])[:n]
        assert got["r0", "other"] == "claimed" and got["r1", "w"] == "held" and got["gone", "w"] == "returned" and got["none", "w"] == "not_found" and got["x00", "w"] == "held"
    assert queue.claim_by_id(jobs, asked.where("external_id = 'r0'"), now(), 240, 1).first().outcome == "no_slot"


def test_places_over_many_tasks(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(k, rng.randrange(50)) for k in range(1000)], "id long, v long").repartition(7)
    got = sorted((r.v, r.id, r.place) for r in queue.ordered_places(df, [F.col("v"), F.col("id")]).collect())
    assert [p for *_, p in got] == list(range(1, 1001))
    assert queue.ordered_places(df.where("false"), [F.col("v")]).collect() == []


NEXT = "job_id long, status string, priority int, queued_at timestamp, created_at timestamp, locked_by string, locked_at timestamp, attempts int"


def test_two_writers_cannot_both_win(spark, tmp_path):
    root = str(tmp_path)
    jobs = spark.createDataFrame([(k, "pending", k % 2, None if k < 3 else T0, T0, None, None, None) for k in range(6)], NEXT)
    assert versions.write_version(spark, root, {"jobs": jobs}, "first") == 1
    ask = lambda w: lambda held: {"jobs": queue.claim_next(held["jobs"], w, now(), 120, 2)}
    seen = versions.read_version(spark, root, 1)
    late = ask("late")(seen)
    assert versions.write_version(spark, root, ask("early")(seen), "early", 1) == 2
    assert versions.write_version(spark, root, late, "late", 1) is None  # planned on what is no longer the newest
    assert versions.update(spark, root, ask("late"), "late") == 3 and versions.update(spark, root, ask("third"), "third") == 4
    held = {r.locked_by: r.job_id for r in versions.read_version(spark, root)["jobs"].where("status = 'running'").collect()}
    assert held == {"early": 4, "late": 0} or held == {"early": 4, "late": 2} or len(held) == 2
    assert versions.update(spark, root, ask("late"), "late") == 3 and len(versions.versions(spark, root)) == 4


def test_one_creates_a_version(spark, tmp_path):
    made = [versions._create(spark, str(tmp_path), 1, {"write": w, "tables": {}}) for w in "ab"]
    assert made == [True, False] and versions.versions(spark, str(tmp_path))[1]["write"] == "a"


def test_a_failure_half_way_leaves_the_old_version(spark, tmp_path):
    root, one = str(tmp_path), spark.range(3)
    versions.write_version(spark, root, {"a": one, "b": one}, "first")
    bad = spark.range(1).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        versions.write_version(spark, root, {"a": spark.range(9), "b": bad}, "second")
    (tmp_path / "_versions" / "000000000002.json").write_text("")  # a writer that ended as it made the file
    assert {n: df.count() for n, df in versions.read_version(spark, root).items()} == {"a": 3, "b": 3}
    assert versions.write_version(spark, root, {"b": spark.range(5)}, "third") == 3
    assert {n: df.count() for n, df in versions.read_version(spark, root).items()} == {"a": 3, "b": 5}
    assert versions.write_version(spark, root, {"b": spark.range(7)}, "third") == 3 and versions.read_version(spark, root)["b"].count() == 5


def test_a_fallback_queue(spark):
    jobs = spark.createDataFrame([(1, "pending", 0, T0, T0, None, None, 2)], NEXT)
    name, after = queue.claim_with_fallback([("scan", jobs.where("false")), ("capture", jobs)], "w", now(), 240, 1)
    assert name == "capture" and after.first().attempts == 3
    assert queue.claim_with_fallback([("scan", after)], "w", now(), 240, 1) is None


def moments(rng, n, keys):
    return [(k, rng.choice([*keys, None]), None if rng.random() < 0.03 else T0 + dt.timedelta(seconds=rng.randrange(400_000))) for k in range(n)]


def test_as_of_and_intervals_are_brute_force(spark):
    rng = random.Random(4)
    points = moments(rng, 300, "aaab")
    states = [(k, key, at, at and at + dt.timedelta(seconds=rng.choice([-5, 0, 1, 3600, 90_000, 300_000]))) for k, key, at in moments(rng, 200, "aaabc")]
    states += [(1000 + k, "a", points[k][2], points[k][2]) for k in range(20)]  # at the very moment
    p = spark.createDataFrame(points, "id long, k string, at timestamp")
    s = spark.createDataFrame(states, "sid long, k string, since timestamp, until timestamp")
    want = {}
    for i, key, at in points:
        own = [(since, sid) for sid, k2, since, _ in states if key is not None and k2 == key and since is not None and at is not None and since <= at]
        want[i] = max(own)[1] if own else None
    for span in (3600, 86_400, 10**7):
        got = temporal.as_of(p, s, ["k"], "at", "since", "sid", span).collect()
        assert {r.id: r.state.sid if r.state else None for r in got if r.k is not None} == {i: w for i, w in want.items() if points[i][1] is not None} and len(got) == len(points)
    pairs = {(i, sid) for i, key, at in points for sid, k2, a, b in states if key is not None and key == k2 and at is not None and a is not None and a <= at < b}
    for unit in (60, 3600, 10**6):
        got = temporal.within_intervals(p, s, ["k"], "at", "since", "until", unit).collect()
        assert sorted((r.point.id, r.interval.sid) for r in got) == sorted(pairs)
    assert temporal.within_intervals(p, s.where("false"), ["k"], "at", "since", "until").collect() == []
    assert {r.state for r in temporal.as_of(p, s.where("false"), ["k"], "at", "since", "sid").collect()} == {None}


def test_cells_cover_an_interval_once(spark):
    rng = random.Random(6)
    rows = [(lo := rng.randrange(-5000, 5000), lo + rng.randrange(0, 3000)) for _ in range(200)]
    for r in spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", temporal.cells(F.col("lo"), F.col("hi"), 14).alias("c")).collect():
        covered = [x for c in r.c for x in range(c.cell << c.level, (c.cell + 1) << c.level)]
        assert sorted(covered) == list(range(r.lo, r.hi)) and len(r.c) <= 28


def test_sketches_add_up(spark):
    rows = spark.range(60_000).select((F.col("id") % 9).alias("d"), (F.col("id") * 7919 % 13_000).alias("u"), F.xxhash64("id").cast("double").alias("v"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"))
    daily = sketches.daily_sketches(rows.withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d").cast("int"))), F.col("d"), ["k"], "u", "v")
    assert daily.count() <= 18
    for a, b in ((0, 8), (2, 4)):
        day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
        got = {r.k: r for r in sketches.merged(daily, ["k"], day(a), day(b), (0.5, 0.9)).collect()}
        for k in "ab":
            own = rows.where((F.col("k") == k) & F.col("d").between(a, b))
            n, ids = own.count(), own.select("u").distinct().count()
            assert got[k].n == n and abs(got[k].distinct_ids - ids) <= 0.02 * ids
            for p, at in ((0.5, got[k].p50), (0.9, got[k].p90)):
                assert abs(own.where(F.col("v") <= at).count() / n - p) < 0.02


def test_hits_push_filters_to_files(spark, tmp_path):
    for source in ("web", "news"):
        (tmp_path / f"source={source}").mkdir()
        (tmp_path / f"source={source}" / "1.json").write_text("".join(f'{{"query": "q{k % 3}", "title": "t{k}", "url": "u", "published": "2024-01-0{k + 1}"}}\n' for k in range(6)) + '{"title": 1}\n[]\n')
    hits.register(spark)
    df = spark.read.format("hits").load(str(tmp_path))
    assert df.count() == 12
    few = df.where("source = 'web' and query in ('q1', 'q2') and title <> 't1'")
    assert sorted(r.title for r in few.collect()) == ["t2", "t4", "t5"]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "title" in plan.partition("Filter")[2] and "= web" not in plan and few.rdd.getNumPartitions() == 1  # what was pushed is no longer Spark's to filter
    assert spark.read.format("hits").load(str(tmp_path / "nothing")).collect() == []


def test_functions_called_by_name(spark):
    calls.register(spark)
    rows = spark.sql("SELECT * FROM retry_days(DATE '2024-01-01', 2, 3)").collect()
    assert [(r.attempt, r.day.isoformat()) for r in rows] == [(0, "2024-01-03"), (1, "2024-01-05"), (2, "2024-01-09"), (3, "2024-01-15")]
    jobs = [("a", k, "pending", k % 2, None) for k in range(5)] + [("a", 9, "running", 0, T0), ("b", 20, "pending", 0, None)]
    spark.createDataFrame(jobs, "queue string, job_id long, status string, priority int, locked_at timestamp_ntz").withColumn("running", F.expr("int(status = 'running')")).createOrReplaceTempView("jobs_by_name")
    call = "SELECT * FROM claim_next(TABLE(jobs_by_name) PARTITION BY queue ORDER BY (running DESC, priority, job_id), 'w', TIMESTAMP_NTZ '{}', 120, 3)"
    got = {(r.queue, r.job_id, r.action) for r in spark.sql(call.format("2026-01-01 00:01:00")).collect()}
    assert got == {("a", 0, "claim"), ("a", 2, "claim"), ("b", 20, "claim")}
    got = {(r.queue, r.job_id, r.action) for r in spark.sql(call.format("2026-01-01 01:00:00")).collect()}
    assert got == {("a", 9, "expire"), ("a", 0, "claim"), ("a", 2, "claim"), ("a", 4, "claim"), ("b", 20, "claim")}
