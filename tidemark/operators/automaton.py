"""All entries of a dictionary that a text holds, in one pass over it: an automaton of many patterns."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many bytes of entries, some fifty times as many as an automaton, go to the tasks; larger dictionaries meet texts by a shuffle.
MOST_BYTES = 8 << 20


def fitting(entries: DataFrame, key: str) -> list[str] | None:
    """The distinct entries in lower case, without empty ones, or None where they are more than ``MOST_BYTES``."""
    words = entries.select(F.lower(key).alias("_w")).where(F.length("_w") > 0).distinct()
    if (words.agg(F.sum(F.octet_length("_w") + 16)).first()[0] or 0) > MOST_BYTES:
        return None
    return sorted(r[0] for r in words.collect())


def hits(text: Column, words: list[str], frame: DataFrame) -> Column:
    """The words that ``text``, a column of ``frame``, holds as substrings without regard to case: each once, in order of letters.

    The words go to each executor once and a worker builds its automaton once; a pass takes time
    in proportion to the text and to what it finds, however many words there are.
    """
    sent = frame.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for word in sent.value:
            automaton.add_word(word, word)
        automaton.make_automaton()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else sorted({w for _, w in automaton.iter(t)}) if len(automaton) else [])

    return found(F.lower(text))


def with_hits(texts: DataFrame, text: str, entries: DataFrame, key: str, name: str = "hits") -> DataFrame | None:
    """``texts`` with the entries that each holds, or None where the dictionary is too large for a task."""
    words = fitting(entries, key)
    return None if words is None else texts.withColumn(name, hits(F.col(text), words, texts))
