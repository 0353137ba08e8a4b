"""Where plans register their queries, and how they read tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Rows that a task gets where rows are dealt by number, so that its memory stays the same however many there are.
ROWS_A_TASK = 1 << 18
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL it is checked against."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt anew to all cores: a small file in one piece would keep what is heavy for each row in one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def deal(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows dealt by keys to a task for each ROWS_A_TASK of ``n``; few are left to adaptive execution.

    That one joins tasks up to 64 MB as written, which are many times that as sorted or grouped rows in memory.
    """
    tasks = -(-n // ROWS_A_TASK)
    return rows.repartition(tasks, *keys) if tasks > rows.sparkSession.sparkContext.defaultParallelism else rows
