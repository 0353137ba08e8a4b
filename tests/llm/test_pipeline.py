import random

import duckdb
import pytest

import corpus_pipeline
from tests.llm import test_decontamination, test_language_id, test_line_dedup, test_near_dedup
from tests.llm.cases import DOCS, clashing, docs
from tidemark.llm import language_id, mixing
from tidemark.llm.common import materialise


def test_stages_keep_columns_and_handle_awkward_rows(spark, tmp_path):
    benchmark = spark.createDataFrame([("p", "one two three four")], "item_id string, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (clashing(docs(spark)), docs(spark, [])):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            if name != "mixing":
                assert out.columns == table.columns, name
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}-{len(table.columns)}")
            rows = spark.read.parquet(f"{tmp_path}/{name}-{len(table.columns)}")
    assert rows.count() == 0


def test_each_stage_matches_brute_force(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.lang, r.source) for r in rows.collect()]
        out = stage(spark, rows, sf_dir)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if name == "language_id":
            told = test_language_id.brute([(t, lang, source) for _, t, lang, source in before], language_id.fit(rows))
            want = sorted(doc for (doc, *_), (language, _) in zip(before, told, strict=True) if language != language_id.UNDETERMINED)
            assert sorted(r.doc_id for r in after.collect()) == want
        elif name == "line_dedup":
            cuts = test_line_dedup.brute([(doc, t) for doc, t, *_ in before])
            want = []
            for doc, text, *_ in before:
                parts, cut = cuts.get((doc, text), ([], set()))
                kept = "".join(x for i, x in enumerate(parts) if i not in cut) if cut else text
                want += [(doc, kept)] if not cut or kept.strip() else []
            assert sorted((r.doc_id, r.text) for r in after.collect()) == sorted(want)
        elif name == "near_dedup":
            groups = test_near_dedup.brute([(doc, t) for doc, t, *_ in before])
            assert sorted(r.doc_id for r in after.collect()) == sorted(doc for doc, *_ in before if groups[doc][1] == doc)
        elif name == "decontamination":
            judged = test_decontamination.brute([(doc, t) for doc, t, *_ in before], items)
            assert sorted(r.doc_id for r in after.collect()) == sorted(doc for doc, *_, contaminated in judged if not contaminated)
        else:
            con = duckdb.connect()
            con.execute(f"create view documents as select * from '{tmp_path}/decontamination/*.parquet'")
            want = sorted(con.execute(f"select doc_id, size, source_size, taken from ({mixing.ORACLE_SQL})").fetchall())
            assert sorted((r.doc_id, r["size"], r.source_size, r.taken) for r in after.collect()) == want
        rows = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.select(again.columns).collect()))


def near_copies(rng, local, groups=25):
    """Documents in prose with sentences of many lengths, and copies of them in which a twelfth of the words in one stretch, or a word in thirty anywhere, is another."""
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    rows = []
    for g in range(groups):
        base = [" ".join(word() for _ in range(rng.randint(6, 24))).capitalize() + rng.choice(". .. ,".split() + [".", "."]) for _ in range(rng.randint(8, 30))]
        rows.append((g * 10, " ".join(base)))
        for k in range(1, rng.randint(2, 5)):
            words = " ".join(base).split(" ")
            n = len(words) // 12
            at = rng.randrange(len(words) - n)
            for i in range(at, at + n) if local else [rng.randrange(len(words)) for _ in range(max(1, len(words) // 30))]:
                words[i] = word()
            rows.append((g * 10 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize(("local", "least"), [(True, 0.9), (False, 0.45)])
def test_what_near_copies_share_is_gone_after_lines_and_copies(spark, local, least):
    """The order of stages cuts shared passages before near copies are sought; both together must take what copies repeat."""
    rows = near_copies(random.Random(77), local)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], DOCS)
    stages = dict(corpus_pipeline.STAGES)
    after = stages["near_dedup"](spark, materialise(stages["line_dedup"](spark, docs, ""), "cut"), "").collect()
    pieces = lambda text: {tuple(w[i : i + 5]) for w in [text.lower().split()] for i in range(len(w) - 4)}
    first = {k: pieces(t) for k, t in rows if k % 10 == 0}
    kept = {r.doc_id: pieces(r.text) for r in after}
    repeated = sum(len(pieces(t) & first[k - k % 10]) for k, t in rows if k % 10)
    left = sum(len(kept.get(k, set()) & first[k - k % 10]) for k, _ in rows if k % 10)
    assert all(kept[k] == first[k] for k in first)  # the first of each group is untouched
    print("share of what copies repeat that is gone:", 1 - left / repeated, "copies gone whole:", sum(k % 10 > 0 and k not in kept for k, _ in rows), "of", sum(k % 10 > 0 for k, _ in rows))
    assert 1 - left / repeated >= least
