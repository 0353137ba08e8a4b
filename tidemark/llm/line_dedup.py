"""Repeated passages by winnowing over line hashes (DataFrame functions only): window minima, joined positions, matches extended both ways."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match
from tidemark.llm.common import NULL_ID, drop_scratch, materialise, table
from tidemark.llm.plain_windows import bare_lines, windows_of  # noqa: F401  for tests alone

#: Runs of fewer words stay.  Compiled expressions follow a run over so many lines, and over one more; what goes on longer, of short lines, is rare.
MIN_RUN_WORDS, FEW_LINES = 25, 8
#: A line's key: so many bits of its hash below up to MOST_WORDS less its words, so that the least key of a window is a long line's.
KEY_BITS, MOST_WORDS = 56, 127
#: Bytes of keys of documents, and of cut intervals, that may be broadcast; more are joined by shuffling the other side.
MOST_BROADCAST_BYTES, KEY_BYTES, RUN_BYTES, SELECTED_BYTES = 48 << 20, 80, 32, 24
#: A fingerprint with more places than LEAST_HOT, and than one in MOST_HOT of all places, meets its first place where
#: it stands, by a broadcast; there are never more than MOST_HOT of them.
LEAST_HOT, MOST_HOT = 200, 20_000
#: A line ends after line feeds, or after one of these marks and the space behind it; commas, colons and semicolons
#: are among them, so that a passage that follows words without a full stop falls in step again within a sentence.
MARKS = ".!?,;:"
LINE_ENDS = rf"(?<=\n)(?!\n)|(?<=[{MARKS}]\x20)(?![\x20\n])"
#: The same ends with what stands before them, and what stands between the same lines without what ends them but for the
#: mark: line feeds, or the space behind a mark.  Both begin with a class of characters, which a search passes over fast.
ENDS = rf"[{MARKS}\n](?:(?<=\n)(?!\n)|\x20(?![\x20\n]))"
GAPS = rf"[\n\x20](?:(?<=\n)\n*|(?<=[{MARKS}]\x20)(?![\x20\n]))"
BREAK, BLANKS = "\0", "\t\r\x0b\f"
DOC = ["_id", "_mark"]


def spaced(text: Column) -> Column:
    """A text with spaces for other ASCII white space than line feeds."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def lines_of(text: Column) -> Column:
    """The lines of a text, with what ends them, so that they join to the text again.

    A mark behind each end and a split by it take a small part of the time of LINE_ENDS; that
    one serves the texts that hold the mark themselves.
    """
    text = F.coalesce(text, F.lit(""))
    marked = F.regexp_replace(text, ENDS, f"$0{BREAK}")
    return F.array_remove(F.when(F.contains(text, F.lit(BREAK)), F.split(text, LINE_ENDS)).otherwise(F.split(marked, BREAK)), "")


def number_of_lines(text: Column) -> Column:
    """How many lines ``lines_of`` gives, without splitting: the ends, and one more where words follow the last."""
    text = F.coalesce(text, F.lit(""))
    ended = reduce(lambda s, end: s | F.endswith(text, F.lit(end)), ["\n", *[f"{mark} " for mark in MARKS]], text == "")
    return (F.regexp_count(text, F.lit(ENDS)) + F.when(ended, 0).otherwise(1)).cast("long")


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with the order of its documents: the id, a null one first, then a hash that tells texts of one id apart."""
    text = F.col("text").cast("string")
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("_mark", F.xxhash64(text))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """_id, _mark and, of each line with words: hashes, without regard to case, outer white space and the kind of inner, and words (by single white space).

    ``places`` holds the lines' numbers where lines without words stand between them; else it is
    null, and their places are their numbers.
    """
    full = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''")
    parts = F.split(F.lower("text"), GAPS)
    odd = reduce(lambda s, c: s | F.contains("text", F.lit(c)), BLANKS[1:], F.contains("text", F.lit(BLANKS[0])))
    bare = F.when(odd, F.transform(parts, lambda x: F.trim(spaced(x)))).otherwise(F.transform(parts, lambda x: F.trim(x)))
    rows = with_key(full).select(*DOC, bare.alias("_bare")).withColumn("_gap", F.array_position("_bare", F.lit("")))
    places = F.filter(F.transform("_bare", lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    rows = rows.select(
        *DOC, F.when(F.col("_gap") > 0, F.array_remove("_bare", "")).otherwise(F.col("_bare")).alias("_lines"),
        F.when((F.col("_gap") > 0) & (F.col("_gap") < F.size("_bare")), places).alias("places"),
    )
    spaces = lambda x: F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    return rows.select(*DOC, F.transform("_lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("_lines", lambda x: spaces(x) + 1).alias("words"), "places")


def line_key(line_hash: Column, words: Column) -> Column:
    """What windows take the minimum of: the line with most words comes first, then the one with the least hash."""
    return F.shiftleft(MOST_WORDS - F.least(words, F.lit(MOST_WORDS)).cast("long"), KEY_BITS) + line_hash.bitwiseAND(F.lit((1 << KEY_BITS) - 1))


def shortest_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """_id, _mark, pos, places, key, off, n, hashed, at, several: for each line the window from it on, the shortest run that has enough words, of n lines.

    ``key`` is the least key of the window's lines, and ``off`` its place in it.  From ``at`` on,
    ``hashed`` holds the fingerprints of the window and of each run that is longer by one line more
    and has too few words without its first: a window and what it is extended to, line by line;
    ``several`` is their number.  Lines without a window have a key of -1 and nulls.

    Lines are exploded with the arrays, which compiled expressions read where they are; runs
    that go on beyond FEW_LINES and one are left to slices, taken behind a filter.  There is no
    other filter, since it would be pushed below the sums and add them up again for itself.
    """
    most, few = max(1, min_words), FEW_LINES + 1
    rows = lines.select(*DOC, "hashes", "words", "places", F.size("words").alias("_size"), F.posexplode("words").alias("pos", "_w1"))
    line = lambda c, k: F.get(c, F.col("pos") + (k - 1))
    rows = rows.withColumn("_s1", F.col("_w1"))
    for k in range(2, few + 1):  # null past the text's end
        rows = rows.withColumn(f"_s{k}", F.col(f"_s{k - 1}") + line("words", k))
    goes_on = F.coalesce(F.col(f"_s{few}") - F.col("_w1") < most, F.lit(False)) & (F.col("_size") > F.col("pos") + few)
    short = rows.select(
        *DOC, "hashes", "words", "places", "pos", F.when(~goes_on, first_match([(F.col(f"_s{k}") >= most, F.lit(k)) for k in range(1, few + 1)])).alias("n"),
        F.coalesce(first_match([(F.col(f"_s{k + 1}") - F.col("_w1") >= most, F.lit(k)) for k in range(1, few)]), F.least(F.col("_size") - F.col("pos"), F.lit(few))).alias("_last"),
    )
    short = short.select("*", *[line("hashes", k).alias(f"_x{k}") for k in range(1, few + 1)])
    short = short.select("*", *[line_key(F.col(f"_x{k}"), line("words", k)).alias(f"_k{k}") for k in range(1, few + 1)], F.col("_x1").alias("_h1"))
    for k in range(2, few + 1):
        short = short.withColumn(f"_h{k}", F.xxhash64(f"_h{k - 1}", f"_x{k}"))
    inside = [F.when(F.col("n") >= k, F.col(f"_k{k}")) for k in range(1, few + 1)]
    short = short.withColumn("key", F.coalesce(F.least(*inside), F.lit(-1).cast("long")))
    off = first_match([(F.col(f"_k{k}") == F.col("key"), F.lit(k - 1)) for k in range(1, few + 1)])
    several = F.greatest(F.col("_last") - F.col("n"), F.lit(0)) + 1
    short = short.select(*DOC, "pos", "places", "key", off.alias("off"), "n", F.array(*[f"_h{k}" for k in range(1, few + 1)]).alias("hashed"), F.col("n").alias("at"), several.alias("several"))
    # Runs of many short lines, of ``most`` lines and one at most, from slices; what a run of so many lines is told by hangs on its lines alone.
    part = lambda c: F.slice(c, F.col("pos") + 1, most + 1).alias(c)
    long = rows.where(goes_on).select(*DOC, "pos", "places", part("hashes"), part("words"))
    step = most + 2  # a sum holds the words above and the number of lines below it
    added = lambda s, w: F.when(s >= most * step, s).otherwise(s + w.cast("long") * step + 1)
    summed = lambda words: F.aggregate(words, F.lit(0).cast("long"), added, lambda s: F.when(s >= most * step, (s % step).cast("int")))
    reached = lambda words: F.when(F.array_max(words) == 1, F.when(F.size(words) >= most, most)).otherwise(summed(words))
    long = long.select("*", reached(F.col("words")).alias("n"), F.coalesce(reached(F.slice("words", 2, most)), F.size("words")).alias("_last"))
    keys = F.when(F.col("n") > few, F.slice("hashes", 1, F.col("n"))).otherwise(F.zip_with(F.slice("hashes", 1, F.col("n")), F.slice("words", 1, F.col("n")), line_key))
    long = long.withColumn("_keys", keys).withColumn("key", F.coalesce(F.array_min("_keys"), F.lit(-1).cast("long")))
    chain = lambda k: F.aggregate(F.slice("hashes", 2, k - 1), F.get("hashes", F.lit(0)), lambda s, x: F.xxhash64(s, x))
    run = lambda k: F.when(k > few, F.xxhash64(F.slice("hashes", 1, k))).otherwise(chain(k))
    long = long.select(
        *DOC, "pos", "places", "key", (F.array_position("_keys", F.col("key")) - 1).cast("int").alias("off"), "n",
        F.transform(F.sequence("n", F.greatest("n", "_last")), run).alias("hashed"), F.when(F.col("n").isNotNull(), 1).alias("at"), several.alias("several"),
    )
    return short.unionByName(long)


def with_partners(windows: DataFrame) -> DataFrame:
    """fingerprint, _id, _mark, from, to of windows, and of what they extend to, whose selected line, their minimum, is selected in another place as well.

    Equal windows select lines at equal places in them, so no repeated one is lost.  Each key is
    reduced to its least and greatest place where it stands before anything is shuffled.
    """
    place = F.when(F.col("n").isNotNull(), F.xxhash64(*DOC, F.col("pos") + F.col("off")))
    several = windows.groupBy("key").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a <> _b").select("key")
    several = materialise(several, "line-selected")
    few = several.count() * SELECTED_BYTES <= MOST_BROADCAST_BYTES
    met = windows.join(F.broadcast(several) if few else several, "key")
    each = met.select(*DOC, "places", "pos", "n", F.posexplode(F.slice("hashed", F.col("at"), F.col("several"))).alias("_more", "fingerprint"))
    placed = lambda i: F.coalesce(F.get("places", i), i)
    end = F.col("pos") + F.col("n") + F.col("_more") - 1
    return each.select("fingerprint", *DOC, placed(F.col("pos")).alias("from"), (placed(end) + 1).alias("to"))


def later(rows: DataFrame) -> DataFrame:
    """_id, _mark, from, to of the rows (fingerprint, _id, _mark, from, to) whose fingerprint has an earlier place.

    First places are found by a grouped minimum.  Very frequent fingerprints, of which there
    can be few, are then broadcast, so that none gathers its places in one task.
    """
    rows = materialise(rows, "line-marks")
    groups = rows.groupBy("fingerprint").agg(F.count("*").alias("_n"), F.min(F.struct(*DOC, "from")).alias("_first"))
    first = materialise(groups.where("_n > 1"), "line-first")
    bound = max(LEAST_HOT, (first.agg(F.sum("_n")).first()[0] or 0) // MOST_HOT)
    hot, cold = first.where(F.col("_n") > bound).drop("_n"), first.where(F.col("_n") <= bound).drop("_n")
    told = lambda met: met.where(F.struct(*DOC, "from") > F.col("_first")).select(*DOC, "from", "to")
    others = rows.join(F.broadcast(hot.select("fingerprint")), "fingerprint", "left_anti")
    return told(rows.join(F.broadcast(hot), "fingerprint")).unionByName(told(others.join(cold, "fingerprint")))


def united(found: DataFrame) -> DataFrame:
    """_id, _mark and runs: the disjoint intervals of lines [from, to) that ``found`` covers.

    A run with enough words is the union of the windows in it that lose enough by their
    first or by their last line.  Of such windows of a document the one that begins later
    does not end before, so an interval ends where the next window begins behind the end.
    """
    packed = F.shiftleft(F.col("from").cast("long"), 32) + F.col("to")
    rows = found.groupBy(*DOC).agg(F.sort_array(F.collect_set(packed)).alias("_all"))
    start, stop = lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))
    apart = lambda a, b: F.coalesce(start(b) > stop(a), F.lit(True))
    firsts = F.filter("_all", lambda x, i: apart(F.get("_all", i - 1), x))
    lasts = F.filter("_all", lambda x, i: apart(x, F.get("_all", i + 1)))
    return rows.select(*DOC, F.zip_with(firsts, lasts, lambda a, b: F.struct(start(a).cast("int").alias("from"), stop(b).cast("int").alias("to"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_RUN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text and others) with later repeated runs cut from text, plus n_lines, n_cut and runs.

    A run is a sequence of lines that also stands earlier: in a document before in the order
    of ids, or further up.  All runs of ``min_words`` words or more go, however many documents
    hold parts of them; shorter ones stay.  Lines without words do not part a run.
    ``runs`` holds the cut intervals of line numbers, the end exclusive.

    A null or empty text stays as it is and has no lines; ids that are null come
    first in order; rows that repeat both id and text are one document and get one result
    each; an empty table gives no rows; columns named like a new one are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_cut", "runs", *DOC)])
    lines = materialise(hashed_lines(docs), "line-hashes")
    # Winnowing brings windows together by their selected lines; such a match is then extended back
    # to the window's first line and on to its last, and beyond, by the hash of all of it.
    runs = materialise(united(later(with_partners(shortest_windows(lines, min_words)))), "line-runs")
    drop_scratch(lines)
    few = (runs.agg(F.sum(F.size("runs") * RUN_BYTES + KEY_BYTES)).first()[0] or 0) <= MOST_BROADCAST_BYTES
    rows = with_key(docs).join(F.broadcast(runs) if few else runs, DOC, "left").drop(*DOC)
    kept = F.filter(lines_of(F.col("text").cast("string")), lambda _, i: ~F.exists("runs", lambda r: (i >= r["from"]) & (i < r["to"])))
    cut = F.aggregate("runs", F.lit(0), lambda s, r: s + r["to"] - r["from"])
    return rows.select(
        *[F.when(F.col("runs").isNotNull(), F.array_join(kept, "")).otherwise(F.col("text").cast("string")).alias("text") if c == "text" else c for c in docs.columns],
        number_of_lines(F.col("text").cast("string")).alias("n_lines"), F.coalesce(cut, F.lit(0)).cast("long").alias("n_cut"), "runs",
    )


def keep_first_passages(docs: DataFrame) -> DataFrame:
    """``docs`` (columns of documents) without later repeats; n_chars follows, and rows that consist of nothing else go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")] if others else []
    out = dedup_lines(docs.select("doc_id", "text", *carried))
    empty = (F.col("n_cut") > 0) & (F.regexp_replace("text", r"[\x20\x09-\x0D]+", "") == "")
    out = out.where(~F.coalesce(empty, F.lit(False)))
    n_chars = lambda: F.when(F.col("n_cut") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars").cast("long")).alias("n_chars")
    return out.select(*[c if c in ("doc_id", "text") else n_chars() if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut repeated passages from the whole ``documents`` table."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_cut", F.to_json("runs").alias("runs"), "text")
