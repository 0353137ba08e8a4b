"""Landed search hits as a data source of their own: files of JSON lines by kind of source, with filters pushed to files and a stream of new files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import datetime

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "source string, query string, title string, url string, published timestamp"
#: Hits without these are no hits; the reader drops them.
NEEDED = ("title", "url")


def _files(root: str) -> list[tuple[str, str]]:
    """(source, path) of all files below ``root``, which has a folder source=... for each kind, in order of names."""
    system, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    names = sorted((f.base_name, f.path) for f in found if f.is_file and f.extension == "json")
    return [(path.rpartition("source=")[2].partition("/")[0], path) for _, path in names if "source=" in path]


class HitsPartition(InputPartition):
    def __init__(self, source: str, path: str) -> None:
        super().__init__(path)
        self.source, self.path = source, path


def _rows(root: str, part: HitsPartition, queries: frozenset[str] | None) -> Iterator[tuple]:
    """Hits of one file in the order of ``SCHEMA``; lines that are no JSON, and hits without what is needed, are passed over."""
    system, _ = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    with system.open_input_stream(part.path) as stream:
        held = b""
        while chunk := stream.read(1 << 20):
            *lines, held = (held + chunk).split(b"\n")
            yield from _hits(part.source, lines, queries)
        yield from _hits(part.source, [held], queries)


def _hits(source: str, lines: Iterable[bytes], queries: frozenset[str] | None) -> Iterator[tuple]:
    for line in lines:
        try:
            hit = json.loads(line)
        except ValueError:
            continue
        if not isinstance(hit, dict) or not all(hit.get(k) for k in NEEDED) or (queries is not None and hit.get("query") not in queries):
            continue
        try:
            at = datetime.fromisoformat(hit["published"]) if hit.get("published") else None
        except (TypeError, ValueError):
            at = None
        yield source, hit.get("query"), hit["title"], hit["url"], at


class HitsReader(DataSourceReader):
    """A task for each file; equality and IN on ``source`` leave out files, on ``query`` lines, before Spark sees them."""

    def __init__(self, root: str) -> None:
        self.root = root
        self.wanted: dict[str, frozenset[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = frozenset([f.value]) if isinstance(f, EqualTo) else frozenset(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("source",), ("query",)):
                yield f
                continue
            name = f.attribute[0]
            self.wanted[name] = values & self.wanted.get(name, values)

    def partitions(self) -> list[HitsPartition]:
        sources = self.wanted.get("source")
        found = [HitsPartition(source, path) for source, path in _files(self.root) if sources is None or source in sources]
        return found or [HitsPartition("", "")]

    def read(self, partition: HitsPartition) -> Iterator[tuple]:
        return _rows(self.root, partition, self.wanted.get("query")) if partition.path else iter(())


class HitsStream(DataSourceStreamReader):
    """Files in order of their names: each batch has those that came since, so names must rise as files land."""

    def __init__(self, root: str) -> None:
        self.root = root

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((path.rpartition("/")[2] for _, path in _files(self.root)), default="")}

    def partitions(self, start: dict, end: dict) -> list[HitsPartition]:
        return [HitsPartition(s, p) for s, p in _files(self.root) if start["after"] < p.rpartition("/")[2] <= end["after"]]

    def read(self, partition: HitsPartition) -> Iterator[tuple]:
        return _rows(self.root, partition, None)


class HitsSource(DataSource):
    """``spark.read.format("hits").load(root)``, or ``readStream``: source, query, title, url and published of landed hits."""

    @classmethod
    def name(cls) -> str:
        return "hits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> HitsReader:
        return HitsReader(self.options["path"])

    def streamReader(self, schema: StructType) -> HitsStream:
        return HitsStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HitsSource)
