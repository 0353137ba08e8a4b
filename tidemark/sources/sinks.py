"""Batch writes: exports, appends that can be repeated, seeds, upserts and checks of what leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """Quoted where needed, quotes doubled, with a header; nested columns become JSON.  ``bom`` puts a byte order mark before the header of each file, which spreadsheets look for."""
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in df.schema])
    if bom:
        flat = flat.withColumnRenamed(flat.columns[0], f"\ufeff{flat.columns[0]}")
    flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose keys the table at ``path`` lacks, each key once; a repeat of the same write adds nothing."""
    once = df.dropDuplicates(list(keys))
    if exists(df.sparkSession, path):
        known = df.sparkSession.read.parquet(path).select(*keys).distinct()
        once = once.join(known, list(keys), "left_anti")
    once.write.mode("append").parquet(path)


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of, or besides, its own."""
    return base.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def field_names(schema: T.DataType) -> set[str]:
    """All names in a schema, however deep."""
    if isinstance(schema, T.StructType):
        return {f.name for f in schema} | {n for f in schema for n in field_names(f.dataType)}
    if isinstance(schema, T.ArrayType):
        return field_names(schema.elementType)
    if isinstance(schema, T.MapType):
        return field_names(schema.valueType)
    return set()


def assert_without(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """``df``, or an error if one of its fields has a forbidden name."""
    found = {n for n in field_names(df.schema) if n.lower() in {x.lower() for x in forbidden}}
    if found:
        raise ValueError(f"fields that may not be published: {', '.join(sorted(found))}")
    return df
