import random

import numpy as np
import pytest

from tests.llm.cases import clashing, docs
from tidemark.llm import near_dedup


def brute(rows):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().translate(near_dedup.LOWER).split()
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def groups(seed):
    """Texts of many lengths, their copies with a few words changed, and texts around one common passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice((3, 5, 6, 9, 20, 60, 200)))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    for _ in range(60):
        rows.append(f"{passage} {' '.join(word() for _ in range(rng.randint(5, 30)))}")
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = groups(seed)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_large_group_around_a_base_far_from_its_other_copies(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = [(500, " ".join(base))]
    for k in range(120):  # each copy is near the base, few are near each other
        own = list(base)
        for at in rng.sample(range(0, 150, 5), 4):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in brute(rows).items()}


def test_awkward_rows(spark):
    got = near_dedup.near_duplicates(clashing(docs(spark))).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 14
    assert [r.component_id for r in by[1]] == [1, 1] and by[2][0].component_id == 1 and not by[2][0].kept
    assert by[3][0].component_id == 1
    assert by[4][0].n_shingles == by[5][0].n_shingles == by[6][0].n_shingles == 0 and by[4][0].kept
    assert all(r.component_id is None and r.kept for r in by[None])
    assert by[11][0].component_id == 10 and by[10][0].n_shingles == 1


def test_empty_table(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(30):
        pool = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))
        a, b = pool[:340], pool[60:]
        both = near_dedup.registers([np.sort(a), np.sort(b)], near_dedup.probes())
        errors.append((both[0] == both[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
