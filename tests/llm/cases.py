"""Small tables of awkward rows that every training-data operator must handle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASHING = ("_id", "_mark", "_row", "_text", "_hash", "kept", "digest", "bands", "spans", "items", "n_words", "size", "taken", "target", "shard", "place", "language", "base", "runs", "n_cut", "rep", "text_a", "features", "vector", "path", "notices")
LONG = " ".join(f"word{k % 977} Und die Zeile {k}." for k in range(30_000))
PROSE = "The quick brown fox jumps over the lazy dog near the old river bank. It was a bright cold day in April and the clocks were striking. Nobody in the village remembered when the bridge had been built there."
ROWS = [
    (1, PROSE, "en", "a", len(PROSE)), (1, PROSE, "en", "a", len(PROSE)), (2, PROSE, "en", "b", len(PROSE)), (3, PROSE.replace("April", "March"), "en", "a", len(PROSE)),
    (4, "", "en", "a", 0), (5, None, None, None, None), (None, "A row without an id.", "en", None, 20), (None, None, None, None, None), (6, " \n\t ", "de", "b", 4),
    (7, LONG, "de", "c", len(LONG)), (8, "x", "fr", "c", 1), (9, "Ünïcödé 😀 text, 12 345.", None, "c", 24), (10, "one two three four", "en", "b", 18), (11, "one two three four", "en", "b", 18),
]


def docs(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(ROWS if rows is None else rows, DOCS)


def clashing(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING) if c not in df.columns])


def with_tables(spark: SparkSession, folder, **tables: DataFrame) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
