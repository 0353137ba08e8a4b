"""Joins beyond equality of one key: tiers, containment and fallback keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.automaton import with_hits

#: Entries beyond the automaton's bound meet the texts by a piece of so many characters at most.
LONGEST_PIECE = 6


def with_fallback_key(rows: DataFrame, key: str, other: str, mapping: DataFrame, unique: str) -> DataFrame:
    """``rows`` with a null ``key`` filled from ``mapping`` (other, key), each ``unique`` once."""
    filled = rows.join(mapping.select(other, F.col(key).alias("_key")), other, "left")
    return filled.withColumn(key, F.coalesce(F.col(key), F.col("_key"))).drop("_key").dropDuplicates([unique])


def pieces(text: Column, width: int) -> Column:
    """The distinct runs of ``width`` characters of a text."""
    letters = lambda t: F.split(t, "")
    runs = lambda c: F.when(F.size(c) >= width, F.transform(F.sequence(F.lit(1), F.size(c) - width + 1), lambda i: F.array_join(F.slice(c, i, width), "")))
    return F.array_distinct(F.flatten(F.transform(F.array(text), lambda t: F.coalesce(runs(letters(t)), F.array().cast("array<string>")))))


def entries_by_pieces(texts: DataFrame, text: str, unique: Sequence[str], entries: DataFrame, key: str) -> DataFrame:
    """(unique, entry), the entry in lower case, for the entries that each text contains, found by equality of one piece of each entry and then confirmed.

    Pieces are as long as the shortest entry, ``LONGEST_PIECE`` at most; of an entry's pieces
    the one that fewest entries share stands for it.  Only ids and pieces are exploded: a text
    travels once, to confirm what was found for it.
    """
    words = entries.select(F.lower(key).alias("_entry")).where(F.length("_entry") > 0).distinct()
    width = min(LONGEST_PIECE, words.agg(F.min(F.length("_entry"))).first()[0] or 1)
    each = words.select("_entry", F.explode(pieces(F.col("_entry"), width)).alias("_piece"))
    shared = each.groupBy("_piece").agg(F.count("*").alias("n"))
    anchors = each.join(shared, "_piece").groupBy("_entry").agg(F.min(F.struct("n", "_piece"))["_piece"].alias("_piece"))
    met = texts.select(*unique, F.explode(pieces(F.lower(text), width)).alias("_piece")).join(anchors, "_piece").drop("_piece")
    return texts.select(*unique, F.lower(text).alias("_text")).join(met, list(unique)).where(F.contains("_text", "_entry")).select(*unique, "_entry")


def contained_entries(texts: DataFrame, text: str, unique: Sequence[str], entries: DataFrame, key: str) -> DataFrame:
    """(unique, entry), the entry in lower case, for the entries that each text contains as substrings, without regard to case.

    One pass of an automaton over each text where the dictionary fits into a task, else by
    pieces; both compare what Spark's ``lower`` gives, so results are equal.
    """
    found = with_hits(texts.select(*unique, text), text, entries, key, "_hits")
    if found is None:
        return entries_by_pieces(texts, text, unique, entries, key)
    return found.select(*unique, F.explode("_hits").alias("_entry"))


def longest_contained(texts: DataFrame, text: str, unique: Sequence[str], entries: DataFrame, key: str = "key") -> DataFrame:
    """For each text the longest entry it contains as a substring, in lower case, the first by name among equals; else null."""
    found = with_hits(texts, text, entries, key, "_hits")
    if found is not None:
        best = F.array_min(F.transform("_hits", lambda e: F.struct((-F.length(e)).alias("n"), e.alias("e"))))["e"]
        return found.withColumn("matched", best).drop("_hits")
    pairs = entries_by_pieces(texts, text, unique, entries, key)
    best = pairs.groupBy(*unique).agg(F.min(F.struct((-F.length("_entry")).alias("n"), F.col("_entry").alias("e")))["e"].alias("matched"))
    return texts.join(best, list(unique), "left")


def in_tiers(base: DataFrame, unique: Sequence[str], tiers: Sequence[tuple[str, DataFrame]], value: str) -> DataFrame:
    """``base`` with the value of the first tier that has one, and that tier's name."""
    out = base
    for name, tier in tiers:
        out = out.join(tier.select(*unique, F.col(value).alias(f"_{name}")), list(unique), "left")
    found = [F.col(f"_{name}") for name, _ in tiers]
    source = F.coalesce(*[F.when(F.col(f"_{name}").isNotNull(), F.lit(name)) for name, _ in tiers], F.lit("none"))
    return out.withColumn(value, F.coalesce(*found)).withColumn("tier", source).drop(*[f"_{name}" for name, _ in tiers])
