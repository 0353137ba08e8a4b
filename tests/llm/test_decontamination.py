import random
import re

from tests.llm.cases import clashing, docs
from tidemark.llm import decontamination
from tidemark.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "delta", "épsilon", "zeta9"])
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice((1, 3, 13, 14, 30))))) for k in range(12)] + [("empty", " ., "), ("i3", "beta beta beta")]
    rows = []
    for k in range(80):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        if k % 3 == 0:
            text += ", " + rng.choice(items)[1].upper() + ". " + " ".join(word() for _ in range(5))
        rows.append((k, text))
    return rows, items


def test_matches_brute_force_in_one_block_and_in_several(spark):
    rows, items = made(5)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string")
    want = brute(rows, items)
    for options in ({}, {"shard_words": 50}, {"block_items": 4}, {"block_bytes": 300}):
        got = decontamination.decontaminate(d, b, keep=["doc_id"], **options).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got) == want
        for r in got:
            assert sum(s.end - s.start for s in r.spans) == r.n_hit


def test_items_longer_than_a_block_and_repeated_rows(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(300)}" for _ in range(600))
    items = [("long", long), ("short", "w1 w2 w3"), ("other", " ".join(f"w{k}" for k in range(40)))]
    rows = [(k, " ".join(long.split()[k * 9 : k * 9 + 30]) + " end w1 w2 w3") for k in range(50)] + [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (8, None)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.decontaminate(d, b, keep=["doc_id"], block_bytes=700).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got) == sorted(brute(rows, items))


def test_awkward_rows(spark):
    b = spark.createDataFrame([("p", "It was a bright cold day in April and the clocks were striking. Nobody"), (None, "one two three four"), ("q", None)], "item_id string, text string")
    got = decontamination.decontaminate(clashing(docs(spark)), b, keep=["doc_id", "kept", "spans"]).collect()
    assert len(got) == 14 and sum(r.contaminated for r in got) == 3 and all(r.n_words == 0 for r in got if r.doc_id in (4, 5, 6))
    none = b.where("false")
    assert [r.n_hit for r in decontamination.decontaminate(docs(spark), none, keep=["doc_id"]).collect()] == [0] * 14
    assert decontamination.decontaminate(docs(spark, []), b).count() == 0


def test_index_finds_every_occurrence():
    import numpy as np

    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in rng.integers(1, 40, 30)])
    index = FMIndex(text, 3)
    for length in (1, 2, 5):
        phrases = np.array([p for p in np.unique(np.lib.stride_tricks.sliding_window_view(text, length), axis=0) if (p > 0).all()])
        low, high = index.search(phrases)
        for k, p in enumerate(phrases):
            found = sorted(index.locate(np.arange(low[k], high[k])).tolist())
            assert found == [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]
