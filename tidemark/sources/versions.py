"""Several tables under one version: a small file names what belongs to it, and whoever creates that file first has made it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _read(spark: SparkSession, path: str) -> dict | None:
    """A version's file, or None where its writer ended before it was whole."""
    fs, target = _path(spark, path)
    stream = fs.open(target)
    try:
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, target = _path(spark, f"{root.rstrip('/')}/_versions")
    if not fs.exists(target):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(target))
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def versions(spark: SparkSession, root: str) -> dict[int, dict]:
    """All whole versions by number: their tables' folders and the name of the write that made them."""
    held = {n: _read(spark, f"{root.rstrip('/')}/_versions/{n:012d}.json") for n in _numbers(spark, root)}
    return {n: v for n, v in held.items() if v is not None}


def read_version(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of one version, the newest whole one if none is named; none are there before the first."""
    known = versions(spark, root)
    if not known:
        return {}
    return {name: spark.read.parquet(path) for name, path in known[max(known) if number is None else number]["tables"].items()}


def _create(spark: SparkSession, root: str, number: int, content: dict) -> bool:
    """Create a version's file unless it is there: of several writers, one does.  HDFS and stores with conditional writes decide it as one step."""
    fs, target = _path(spark, f"{root.rstrip('/')}/_versions/{number:012d}.json")
    fs.mkdirs(target.getParent())
    try:
        stream = fs.create(target, False)
    except Exception as error:  # Py4J gives the file system's own exception
        if "AlreadyExists" in str(error) or fs.exists(target):
            return False
        raise
    stream.write(json.dumps(content).encode())
    stream.close()
    return True


def write_version(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], write: str, base: int | None = None) -> int | None:
    """Write ``tables`` and make them visible at once as the version after ``base``; its number, or None if another writer was first.

    All tables are written under a folder of their own before the version's file is created, so a
    reader sees either all of them or the version before, and a failure half-way leaves nothing
    that is read.  A repeat of the same ``write`` gives the number it had, and writes nothing.
    Tables of the version before that are not among ``tables`` stay part of the new one.
    """
    known = versions(spark, root)
    for number, content in known.items():
        if content["write"] == write:
            return number
    numbers = _numbers(spark, root)
    base = max(known, default=0) if base is None else base
    if base < max(known, default=0):
        return None
    data = f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    paths = dict(known[base]["tables"]) if base in known else {}
    for name, df in tables.items():
        df.write.parquet(f"{data}/{name}")
        paths[name] = f"{data}/{name}"
    number = max([base, *[n for n in numbers if n not in known]]) + 1  # files that never became whole are passed over
    return number if _create(spark, root, number, {"write": write, "tables": paths}) else None


def update(spark: SparkSession, root: str, change: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]], write: str, tries: int = 10) -> int:
    """Apply ``change`` to the newest version and make the result the next one; where another writer was first, again on what that one left."""
    for _ in range(tries):
        base = max(versions(spark, root), default=0)
        number = write_version(spark, root, change(read_version(spark, root, base) if base else {}), write, base)
        if number is not None:
            return number
    raise RuntimeError(f"{tries} other writers were first")
