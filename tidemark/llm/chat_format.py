"""Chat formatting of reply trees (DataFrame functions only): root-to-leaf paths, ranked branches, one text for each path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_scratch, materialise, table

START, AFTER_ROLE, END, LOSS_ROLE = "<|im_start|>", "\n", "<|im_end|>\n", "assistant"
#: What stands for the characters that control strings begin with; the first is the escape character itself.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
MOST_ROUNDS = 40


def escaped(text: Column) -> Column:
    """``text`` without any character that begins a control string; `unescaped` gives it back."""
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def role_escaped(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("~3"))


def role_unescaped(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("~3"), F.lit("\n")))


def paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, node, up for each node of each path from a leaf to its root; up counts from the leaf.

    ``messages`` has tree, node and parent.  Each round joins the table of jumps with itself,
    which doubles their length, and adds to every path the nodes one jump above those it has,
    so a chain of n messages takes log2(n) rounds.  A parent that is null or absent makes a
    root; messages below a circle of replies have no root and are on no path.
    """
    nodes = messages.select("tree", "node", "parent")
    present = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    jumps = nodes.join(present, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n"))).select("tree", "node", F.col("parent").alias("above"))
    jumps = materialise(jumps, "reply-jumps")
    replied = jumps.select(F.col("tree").alias("_t"), F.col("above").alias("_n")).distinct()
    leaves = nodes.join(replied, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
    roots = nodes.join(jumps.select(F.col("tree").alias("_t"), F.col("node").alias("_n")), F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
    roots = materialise(roots.select(F.col("tree").alias("_t"), F.col("node").alias("_root")), "reply-roots")
    found = materialise(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "reply-paths")
    step = 1
    n_nodes = None
    for _ in range(MOST_ROUNDS):
        if jumps.isEmpty():
            break
        if n_nodes is None:
            n_nodes = nodes.count()
        if step > n_nodes:
            break  # only circles are left
        hop = jumps.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "above")
        further = found.join(hop, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
        found = materialise(found.unionByName(further.select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))), "reply-paths")
        jumps = materialise(jumps.select("tree", "node", F.col("above").alias("_a")).join(hop, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("_a") == F.col("_n"))).select("tree", "node", "above"), "reply-jumps")
        step *= 2
    rooted = found.join(roots, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_root"))).select(F.col("tree").alias("_t"), F.col("leaf").alias("_leaf"))
    return found.join(rooted, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("leaf") == F.col("_leaf")), "left_semi")


def format_trees(messages: DataFrame, branches: int | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """tree, leaf, rank, score, formatted, loss_spans: a conversation for each of the best ``branches`` paths (None: all) of a tree.

    ``messages`` has tree, node, parent, role, text and score.  A branch scores the sum of its
    messages' scores (null: 0); ties go to the smaller leaf.  ``loss_spans`` are the [start,
    end) places, in code points of ``formatted``, of the texts of ``loss_role``.  Control
    strings inside roles and texts are escaped, see `escaped`, so ``formatted`` reads back.

    Null texts and roles are empty; of rows that repeat tree and node, which should not be, the
    least by role and text counts; a null tree is a tree of its own and rows with a null node are left out; an empty table gives
    no rows; other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = messages.where("node is not null").select("tree", "node", "parent", text("role").alias("role"), text("text").alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "node", "m.*")
    rows = materialise(rows, "messages")
    branch = paths(rows)
    own = rows.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text", "score")
    full = branch.join(own, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))).drop("_t", "_n")
    if branches is not None:
        ranked = full.groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"))
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), "leaf"))).where(F.col("rank") <= branches)
        ranked = materialise(ranked.select(F.col("tree").alias("_t"), F.col("leaf").alias("_leaf"), "branch_score", "rank"), "ranked")
        full = full.join(ranked, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("leaf") == F.col("_leaf"))).drop("_t", "_leaf")
    opening = F.concat(F.lit(START), role_escaped(F.col("role")), F.lit(AFTER_ROLE))
    full = full.withColumn("_open", opening).withColumn("_text", escaped(F.col("text")))
    turn = F.concat("_open", "_text", F.lit(END))
    line = Window.partitionBy("tree", "leaf").orderBy(F.col("up").desc())
    full = full.withColumn("_turn", turn).withColumn("_until", F.sum(F.length("_turn")).over(line))
    start = F.col("_until") - F.length("_turn") + F.length("_open")
    span = F.when(F.col("role") == loss_role, F.struct(start.cast("long").alias("start"), (start + F.length("_text")).cast("long").alias("end")))
    best = [F.first("branch_score").alias("score"), F.first("rank").alias("rank")] if branches is not None else [F.sum("score").alias("score")]
    out = full.withColumn("_span", span).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), F.col("_turn").alias("turn"), F.col("_span").alias("span")))).alias("_all"), *best)
    if branches is None:
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")))
    spans = F.filter(F.transform("_all", lambda x: x["span"]), lambda x: x.isNotNull())
    return out.select("tree", "leaf", F.col("rank").cast("int").alias("rank"), "score", F.array_join(F.transform("_all", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (role, text), read from the formatted text, and loss_texts, read under the loss mask."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    bare = F.transform(pieces, lambda x: F.substr(x, F.lit(len(START) + 1)))
    role = lambda x: F.substring_index(x, AFTER_ROLE, 1)
    turns = F.transform(bare, lambda x: F.struct(role_unescaped(role(x)).alias("role"), unescaped(F.substr(x, F.length(role(x)) + 2)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_texts", loss)


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format the whole ``conversations`` table, each a chain of replies in the order of turns, and one about control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    chain = rows.unionByName(more).withColumn("node", place)
    messages = chain.select(F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    read = read_back(format_trees(messages, branches=1))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _grown(column: str) -> str:
    return f"(length({column}) + " + " + ".join(f"length({column}) - length(replace({column}, '{plain}', ''))" for plain, _ in ESCAPES) + ")"


ORACLE_SQL = f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
g AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum({len(START) + len(AFTER_ROLE) + len(END)} + {_grown("role")} + length(role) - length(replace(role, chr(10), '')) + {_grown("text")})::BIGINT AS formatted_chars
  FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
