"""Helpers shared by the training-data operators: scratch tables, tables by path, linked components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class for Java, Python and RE2 alike.
SPACE = r"[\x20\x09-\x0D]+"
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, one in the warehouse, if one machine does everything."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and its size is known to the planner."""
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(*frames: DataFrame) -> None:
    """Delete scratch tables that no live frame reads any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; a null text has none."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE))).cast("long")


def binary_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def whole_batches(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most_bytes`` each, so that a batch of very long texts stays small."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); component is the smallest node reachable.

    Alternates large-star and small-star steps; each is a grouped minimum and a join
    over the links, so a hub with very many links is pre-aggregated and never gathered.  Rounds
    go on until nothing changes; their number grows with the logarithm of the longest path.
    Null ends and self links are ignored; no links give an empty result.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialise(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct(b.alias("a"), F.col("m").alias("b")), F.struct(a, F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where(a != b)
            .distinct()
        )
        after = materialise(small, "links")
        drop_scratch(edges)
        edges = after
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(a <= b)).first()
        if state == seen:
            break
        state = seen
    stars = edges.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(a.alias("node"), b.alias("component")).unionByName(
        stars.select(b.alias("node"), b.alias("component")).distinct()
    )
