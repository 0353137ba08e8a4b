import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import with_tables
from tidemark.llm import neighbour_forest


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, asked, k):
    """(query_id, rank, vec_id) and the score of each place by comparing every pair."""
    kept = [(i, [float(x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out, scores = [], {}
    for q, own in [(q, [float(x) for x in v]) for q, v in asked if q is not None and usable(v)]:
        best = {}
        for i, v in kept:
            if i != q and len(v) == len(own):
                score = sum(a * b for a, b in zip(own, v, strict=True)) / (math.hypot(*own) * math.hypot(*v))
                best[i] = max(score, best.get(i, -9))
        for rank, (i, score) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]):
            out.append((q, rank + 1, i))
            scores[q, rank + 1] = score
    return sorted(out), scores


def awkward(rng):
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(400)]
    rows += [(k, rows[3][1]) for k in range(400, 700)]  # one very common vector
    rows += [(701, None), (702, []), (703, [0.0] * 6), (704, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (705, [float("nan")] * 6), (706, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(750, [3.0, 4.0]), (751, [-1.0, 2.0]), (800, [1.5] * 6), (801, [1e-30] * 6), (800, [1.5] * 6)]
    return rows


@pytest.mark.parametrize("options", [{}, {"share": 1.0, "shard_rows": 90, "leaf_rows": 7, "block_queries": 3}])
def test_whole_search_is_brute_force(spark, options, monkeypatch):
    rows = awkward(random.Random(4))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    df = df.withColumn("q", F.lit(1)).withColumn("vector", F.lit("x")).withColumn("score", F.lit(None)).withColumn("block", F.lit(2)).withColumn("ids", F.lit(3))
    monkeypatch.setattr(neighbour_forest, "LEAST_GATHERED", 2_048 if not options else 1)
    got = neighbour_forest.nearest_neighbours(df, df.where("vec_id % 50 = 0"), **options).collect()
    want, scores = brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 5)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want
    assert all(abs(r.score - scores[r.query_id, r["rank"]]) < 1e-12 for r in got)


def test_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [0.0, -1e300]), (3, [5e-324, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbour_forest.nearest_neighbours(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 1, 2] and np.allclose([r.score for r in got], [1, 0.5**0.5, -(0.5**0.5)], atol=1e-15)


def test_recall_of_the_query(spark, sf_dir, tmp_path):
    rng = np.random.default_rng(3)
    near = rng.standard_normal((60, 64))
    vectors = np.concatenate([rng.standard_normal((9_000, 64)), near[rng.integers(0, 60, 3_000)] + 0.3 * rng.standard_normal((3_000, 64))])
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    folder = with_tables(spark, tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = neighbour_forest.op11_nearest_neighbours(spark, folder).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found, hits = {}, 0
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(0, len(vectors), 50)
    for q in asked.tolist():
        scores = unit @ unit[q]
        scores[q] = -2
        hits += len(found[q] & set(np.argsort(-scores)[:5].tolist()))
    assert len(got) == 5 * len(asked) and hits / (5 * len(asked)) >= 0.9


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(50, [1.0, 2.0]), (51, [2.0, 1.0])], "vec_id long, embedding array<float>")
    (got,) = neighbour_forest.nearest_neighbours(one, one.where("vec_id = 50")).collect()
    assert tuple(got)[:3] == (50, 1, 51) and abs(got.score - 0.8) < 1e-15
    none = one.where("false")
    for candidates, queries in ((none, one), (one, none), (none, none)):
        assert neighbour_forest.nearest_neighbours(candidates, queries).collect() == []


def test_a_forest_of_equal_rows_ends():
    rows = np.ones((1000, 4)) / 2
    forest = neighbour_forest.Forest.plant(rows, 2, 10, 1)
    assert forest.search(rows[0], np.zeros(len(forest.offsets)), rows, 5, 1000).size == 1000
