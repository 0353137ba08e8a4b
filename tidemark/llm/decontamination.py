"""Benchmark decontamination: an FM-index for each shard of the training texts, searched for all test phrases."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import binary_texts, materialise, table
from tidemark.llm.fm_index import FMIndex

PHRASE_WORDS, SHARD_WORDS, BLOCK_ITEMS, BLOCK_BYTES = 13, 200_000, 20_000, 8 << 20
#: So many bytes of what the blocks found may be broadcast to the rows of the texts; more are joined by a shuffle.
MOST_BROADCAST_BYTES = 32 << 20
#: Bytes of words are 0-9, a-z and everything that is not ASCII; A-Z are lower-cased first.
WORD_BYTES = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Phrases:
    """The windows of a block of benchmark items, over the words that occur in them; a window may belong to several items."""

    def __init__(self, items: list[tuple[str, str | None]], n_words: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number, windows = {item: k for k, item in enumerate(self.items)}, {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of((text or "").encode())]
            size = min(n_words, len(ids))
            for at in range(len(ids) - size + 1 if size else 0):
                windows.setdefault(tuple(ids[at : at + size]), set()).add(number[item])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({len(w) for w in windows}):
            own = sorted(w for w in windows if len(w) == size)
            of = [sorted(windows[w]) for w in own]
            first = np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int64)
            self.by_length[size] = np.array(own, np.int64), first, np.array([x for xs in of for x in xs], np.int64)
        self.shortest = min(self.by_length, default=0)


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the intervals [low, high), each with the interval it is of."""
    size = high - low
    of = np.repeat(np.arange(len(low)), size)
    return low[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size), of


def search_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[tuple[int, int]]]]:
    """For each text: number of words, words inside an occurrence, items found, merged spans of hit words."""
    get, streams, sizes = phrases.vocabulary.get, [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = words_of(text)
        sizes[k] = len(words)
        streams.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        streams.append(np.zeros(1, np.int32))
    stream = np.concatenate(streams) if streams else np.zeros(0, np.int32)
    starts = np.cumsum(sizes + 1) - sizes - 1
    hit, found = np.zeros(len(stream) + 1, np.int32), [[] for _ in texts]
    # Only runs of benchmark words at least as long as the shortest phrase can hold one; the index covers those.
    known = np.diff(np.concatenate([[False], stream > 0, [False]]).astype(np.int8))
    low, high = np.flatnonzero(known == 1), np.flatnonzero(known == -1)
    long = high - low >= max(1, phrases.shortest)
    if phrases.by_length and long.any():
        places, _ = ranges(low[long], high[long] + 1)  # the place after a run is foreign or a text's end: the separator
        index = FMIndex(np.where(stream[places] > 0, stream[places], 0), len(phrases.vocabulary))
        pairs = []
        for size, (windows, first, items) in phrases.by_length.items():
            rows, window = ranges(*index.search(windows))
            at = places[index.locate(rows)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + size, -1)
            doc = np.searchsorted(starts, at, "right") - 1
            pick, of = ranges(first[window], first[window + 1])
            pairs.append(np.unique(doc[of] * len(phrases.items) + items[pick]))
        for pair in np.unique(np.concatenate(pairs)).tolist():
            found[pair // len(phrases.items)].append(phrases.items[pair % len(phrases.items)])
    inside = np.cumsum(hit[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(inside)])
    n_hit = total[starts + sizes] - total[starts]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        doc = int(np.searchsorted(starts, a, "right")) - 1
        spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
    return sizes, n_hit, found, spans


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def search(docs: DataFrame, phrases, shard_words: int) -> DataFrame:
    """``docs`` with column ``_text`` searched for a broadcast block of phrases: its other columns and those of FOUND."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = phrases.value

        def searched(kept: list[pa.RecordBatch], texts: list[bytes | None]) -> pa.RecordBatch:
            sizes, n_hit, found, spans = search_shard(texts, block)
            rows = pa.Table.from_batches(kept).drop_columns(["_text"])
            spans = [[{"start": a, "end": b} for a, b in own] for own in spans]
            new = [pa.array(sizes), pa.array(n_hit), pa.array(found, pa.list_(pa.string())), pa.array(spans, ARROW_SPANS)]
            for name, column in zip(FOUND.names, new, strict=True):
                rows = rows.append_column(name, column)
            return rows.combine_chunks().to_batches()[0]

        kept, texts, weight = [], [], 0
        for batch in batches:
            own, first = binary_texts(batch.column("_text")), 0
            for k, text in enumerate(own):
                weight += len(text or b"") // 5 + 1
                if weight >= shard_words:
                    yield searched([*kept, batch.slice(first, k + 1 - first)], texts + own[first : k + 1])
                    kept, texts, weight, first = [], [], 0, k + 1
            if first < len(own):
                kept.append(batch.slice(first))
                texts += own[first:]
        if texts:
            yield searched(kept, texts)

    schema = T.StructType([f for f in docs.schema if f.name != "_text"] + FOUND.fields)
    return docs.mapInArrow(shards, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    phrase_words: int = PHRASE_WORDS,
    shard_words: int = SHARD_WORDS,
    block_items: int = BLOCK_ITEMS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, by default) plus n_words, n_hit, items, spans and contaminated, a row for each row.

    A shard is whole texts of about ``shard_words`` words read by one task.  The phrases of
    ``benchmark`` (item_id, text) are a stated query set, broadcast in blocks of about
    ``block_items`` items and ``block_bytes`` bytes; an item that is longer than a block is
    searched in parts that overlap by a phrase less one word, so that none of its phrases is
    lost.  With more than one block the texts are searched once a block, and what later blocks
    find is merged into the rows of the first.

    A null or empty text has no words and is not contaminated; items with a null id or without
    words match nothing; items that share an id are one item; repeated rows give repeated rows;
    empty tables give empty or unhit rows; columns of ``docs`` named like a new one are dropped.
    """
    spark, new = docs.sparkSession, [*FOUND.names, "contaminated"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new and c not in ("_text", "_place")]
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("most")).first()
    n_blocks = max(1, -(-total.n // block_items), -(-total.bytes // block_bytes))
    if n_blocks == 1:
        rows = [(r.item, r.text) for r in items.collect()]
        source = docs.select(*keep, F.col("text").alias("_text"))
        out = search(source, spark.sparkContext.broadcast(Phrases(rows, phrase_words)), shard_words)
    else:
        out = search_blocks(docs, keep, items if total.most <= block_bytes else in_parts(items, phrase_words, block_bytes // 4), n_blocks, phrase_words, shard_words)
    flag = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.withColumn("contaminated", flag)


def in_parts(items: DataFrame, phrase_words: int, part_bytes: int) -> DataFrame:
    """``items`` (item, text) with long texts cut to parts of about ``part_bytes``, which hold the phrases of the text between them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), binary_texts(batch.column("text")), strict=True):
                words = words_of(text)
                step = max(1, len(words) * part_bytes // max(1, len(text or b"")))
                for at in range(0, max(1, len(words) - phrase_words + 1), step):
                    part = b" ".join(words[at : at + step + phrase_words - 1]).decode("utf-8", "replace")
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([part], pa.string())], names=["item", "text"])

    return items.mapInArrow(cut, "item string, text string")


def search_blocks(docs: DataFrame, keep: list[str], items: DataFrame, n_blocks: int, phrase_words: int, shard_words: int) -> DataFrame:
    """As `search` for a single block: the rows of the first block, with the spans and items that the others found for them."""
    spark = docs.sparkSession
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks))
    source = materialise(docs.select(*keep, F.col("text").alias("_text")).withColumn("_place", F.monotonically_increasing_id()), "searched")
    base, parts = None, []
    for k in range(n_blocks):
        rows = [(r.item, r.text) for r in items.where(block == k).collect()]
        phrases = spark.sparkContext.broadcast(Phrases(rows, phrase_words))
        if base is None:
            base = search(source, phrases, shard_words)
        else:
            parts.append(search(source.select("_place", "_text"), phrases, shard_words).where("n_hit > 0").select("_place", "items", "spans"))
    hits = materialise(reduce(DataFrame.unionByName, parts), "block-hits")
    merged = hits.groupBy("_place").agg(F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))
    size = hits.agg(F.sum(F.size("spans") * 16 + F.size("items") * 32 + 64)).first()[0] or 0
    both = base.join(F.broadcast(merged) if size <= MOST_BROADCAST_BYTES else merged, "_place", "left")
    items_ = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))))
    spans = F.when(F.col("_spans").isNull(), F.col("spans")).otherwise(union_of(F.array_sort(F.concat("spans", F.coalesce("_spans", F.array().cast(FOUND["spans"].dataType))))))
    out = both.select(*keep, "n_words", items_.alias("items"), spans.alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(*keep, "n_words", n_hit.alias("n_hit"), "items", "spans")


def union_of(spans: Column) -> Column:
    """Sorted spans merged where they meet."""
    last = lambda done: F.try_element_at(done, F.lit(-1))
    longer = lambda done, x: F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], x["end"]).alias("end"))))
    meets = lambda done, x: (F.size(done) > 0) & (x["start"] <= last(done)["end"])
    return F.aggregate(spans, F.array().cast(FOUND["spans"].dataType), lambda done, x: F.when(meets(done, x), longer(done, x)).otherwise(F.concat(done, F.array(x))))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search the whole ``documents`` table for the phrases of ``benchmark``."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least(len(w), {PHRASE_WORDS}) AS n, unnest(range(1, len(w) - least(len(w), {PHRASE_WORDS}) + 2)) AS pos, w FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS phrase FROM bw),
ns AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS pos, w FROM d, ns WHERE len(w) >= n),
h AS (SELECT r, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS phrase FROM g),
m AS (SELECT h.r, h.pos, h.n, p.item_id FROM h JOIN p USING (n, phrase)),
x AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS k FROM m) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN x USING (r) LEFT JOIN i USING (r)
"""
