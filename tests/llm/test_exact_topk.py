import math
import random

from pyspark.sql import functions as F

from tidemark.llm import exact_topk


def brute(rows, queries, k):
    whole = lambda v: None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]
    sets = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for q, v in queries:
        if q is None or (own := whole(v)) is None:
            continue
        scored = sorted((-sum(a * b for a, b in zip(own, w, strict=True)), i) for i, w in sets if i != q and len(w) == len(own))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_matches_brute_force_with_ties_nulls_and_blocks(spark):
    rng = random.Random(11)
    rows = [(k, [rng.choice((-1.5, -0.25, 0.0, 0.3, rng.uniform(-2, 2))) for _ in range(7)]) for k in range(300)]
    rows += [(k, rows[3][1]) for k in range(300, 420)]  # one very common vector
    rows += [(500, None), (501, []), (525, []), (502, [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 7), (504, [float("inf")] * 7), (None, [1.0] * 7), (505, [1.0, 2.0]), (506, [0.5, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("score", F.lit("x")).withColumn("block", F.lit(1)).withColumn("q", F.lit(2)).withColumn("rank", F.lit(3))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    queries = [r for r in rows if r[0] is not None and r[0] % 25 == 0]
    want = brute(rows, queries, 5)
    for options in ({}, {"block_rows": 64, "block_queries": 3}):
        got = exact_topk.top_inner_products(df, df.where("vec_id % 25 = 0"), **options).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_components_of_any_size(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(k, [rng.choice((-1, 1)) * rng.uniform(0, 2.0 ** rng.randrange(0, 20)) for _ in range(5)]) for k in range(80)]
    rows += [(k, [rng.choice((-1, 1)) * 2.0 ** rng.randrange(0, 54) for _ in range(5)]) for k in range(80, 120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    long_ = lambda x: max(-(2**63), min(2**63 - 1, x))
    queries = [r for r in rows if r[0] % 10 == 0]
    want = [(q, r, i, long_(s)) for q, r, i, s in brute(rows, queries, 5)]
    for bound in (exact_topk.MOST_BROADCAST_BYTES, 0):  # beyond the bound the queries are shuffled
        monkeypatch.setattr(exact_topk, "MOST_BROADCAST_BYTES", bound)
        got = exact_topk.top_inner_products(df, df.where("vec_id % 10 = 0"), block_rows=32, block_queries=4).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (7, [-1.0])], "vec_id long, embedding array<float>")
    got = exact_topk.top_inner_products(one, one.where("vec_id = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 7, -65536), (0, 1, 7, -65536)]
    assert exact_topk.top_inner_products(one.where("false"), one).collect() == []
    assert exact_topk.top_inner_products(one, one.where("false")).collect() == []


def test_signed_digits():
    for x in [*range(-70, 71), 12345, -(2**20) + 3]:
        assert sum(sign << shift for shift, sign in exact_topk.signed_digits(x)) == x
