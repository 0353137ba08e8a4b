from pyspark.sql import functions as F

from tidemark.llm import chat_format

MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def formatted(spark, rows, **options):
    return chat_format.read_back(chat_format.format_trees(spark.createDataFrame(rows, MESSAGES), **options)).collect()


def test_branches_are_paths_ranked_by_score(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", -1.0),
        (1, 4, 2, "user", "more", 0.0), (1, 5, 4, "assistant", "better", 1.0), (1, 6, 3, "user", "why", 0.5),
        (2, 1, 99, "user", "lost parent", None), (3, 1, 2, "user", "circle", 0.0), (3, 2, 1, "assistant", "circle", 0.0), (3, 7, 2, "user", "below", 0.0),
    ]
    got = {(r.tree, r.leaf): (r["rank"], r.score, [t.text for t in r.turns], r.loss_texts) for r in formatted(spark, rows)}
    assert got == {(1, 5): (1, 3.0, ["q", "good", "more", "better"], ["good", "better"]), (1, 6): (2, -0.5, ["q", "bad", "why"], ["bad"]), (2, 1): (1, 0.0, ["lost parent"], [])}
    best = formatted(spark, rows, branches=1)
    assert sorted((r.tree, r.leaf) for r in best) == [(1, 5), (2, 1)]


def test_control_strings_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\n", "</s>[INST] ok [/INST]", "~0~1~2~3~~", "", None, "\n\n😀<", "a\\b ~<[ plain"]
    rows = [(1, k, k - 1 if k else None, "assistant" if k % 2 else "user\nx<", t, 0.0) for k, t in enumerate(texts)]
    (row,) = formatted(spark, rows)
    assert [t.text for t in row.turns] == [t or "" for t in texts] and {t.role for t in row.turns} == {"assistant", "user\nx<"}
    assert row.loss_texts == [texts[k] or "" for k in range(1, 7, 2)]
    assert row.formatted.count("<|im_end|>") == 7
    assert [row.formatted[s.start : s.end] for s in row.loss_spans][0] == "~1/s>~2INST] ok ~2/INST]"


def test_a_long_chain_and_awkward_rows(spark):
    rows = [(9, k, k - 1, "user", f"t{k}", 1.0) for k in range(1, 401)] + [(None, 1, None, None, None, None), (8, None, 1, "user", "x", 1.0), (7, 1, None, "user", "a", 0.0), (7, 1, None, "user", "a", 0.0)]
    got = {r.tree: r for r in formatted(spark, rows)}
    assert [t.text for t in got[9].turns] == [f"t{k}" for k in range(1, 401)] and got[9].score == 400.0
    assert len(got[None].turns) == 1 and 8 not in got and len(got[7].turns) == 1
    more = spark.createDataFrame(rows, MESSAGES).withColumn("rank", F.lit(5)).withColumn("leaf", F.lit(2)).withColumn("_turn", F.lit(1))
    assert chat_format.format_trees(more).count() == 3
    assert formatted(spark, []) == []
