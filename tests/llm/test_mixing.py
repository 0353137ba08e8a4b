import random
from collections import defaultdict

from tests.llm.cases import clashing, docs
from tidemark.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, stopped at ``most`` times a size, the excess shared again among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def test_targets_quotas_and_limits(spark):
    rows = [(k, "w " * (1 + k % 90), None, f"s{k % 5}" if k % 3 else "s0", 1) for k in range(3000)] + [(9000 + k, "w " * 10, None, None, 1) for k in range(20)]
    got = mixing.mix_sources(docs(spark, rows), docs_per_shard=300).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    want = targets(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - target[s]) <= 64 + 0.02 * target[s], s
    again = mixing.mix_sources(docs(spark, rows).repartition(5), docs_per_shard=300).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_sainte_lague_by_brute_force(spark):
    parties = {"a": 53, "b": 24, "c": 23, "d": 1, "e": 0}
    df = spark.createDataFrame([("g", k, v, 37) for k, v in parties.items()], "g string, k string, v long, seats long")
    quotients = sorted(((-v / (2 * s - 1), k) for k, v in parties.items() if v for s in range(1, 38)))[:37]
    want = {k: sum(q[1] == k for q in quotients) for k in parties}
    assert {r.k: r.quota for r in mixing.sainte_lague(df, ["g"], "k", "v", "seats").collect()} == want


def test_awkward_rows(spark):
    got = mixing.mix_sources(clashing(docs(spark))).collect()
    assert len(got) == 14 and all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix_sources(docs(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix_sources(docs(spark, [(1, None, None, None, None)])).collect()] == [0]


def test_many_sources_are_as_by_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 7)
    rng = random.Random(6)
    sizes = {f"s{k:04d}": rng.choice((0, 1, 1, 5, 5, rng.randrange(1, 4000))) for k in range(700)} | {"hot": 900_000, "": 3}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long").repartition(5)
    got = {r.source: (r.ordinal, r.target) for r in mixing.water_fill(df, (5, 2, 1), 3).collect()}
    want = targets(sizes)
    assert [s for s, _ in sorted(got.items(), key=lambda x: x[1][0])] == sorted(sizes)
    assert all(abs(got[s][1] - want[s]) <= 1e-9 * max(1, want[s]) for s in sizes)


def test_apportionment_of_one_group_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 5)
    rng = random.Random(7)
    for votes, seats in (([rng.randrange(100) for _ in range(60)], 500), ([7] * 40, 61), ([0, 0, 5], 9), ([1000, 1, 1, 1], 2), ([0, 0], 5), ([3.5, 2.25], 0)):
        df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(votes)], "k long, v double")
        quotients = sorted((-v / (2 * s - 1), k) for k, v in enumerate(votes) if v for s in range(1, seats + 1))[:seats]
        want = {k: sum(q[1] == k for q in quotients) for k in range(len(votes))}
        assert {r.k: r.quota for r in mixing.apportioned(df, "k", "v", seats).collect()} == want
