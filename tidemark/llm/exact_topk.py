"""Exact top-k inner products over a bit-sliced index of quantised vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_scratch, materialise, table

SCALE, TOP, BLOCK_ROWS, BLOCK_QUERIES = 256, 5, 16_384, 2_048
#: Scores leave a task as two longs, so that sums of any size keep their order: score = high * 2 ** LIMB + low.
LIMB = 62
#: So many bytes of query vectors may be broadcast to the blocks of the index; more meet them by a shuffle.
MOST_BROADCAST_BYTES = 64 << 20


def usable(vector: Column) -> Column:
    """Not null, and without null, infinite or NaN components."""
    number = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, number), F.lit(False))


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id and the whole numbers floor(scale * x), x as double, of usable vectors; one that a long can't hold becomes the nearest long."""
    vector = F.col("embedding").cast("array<double>")
    whole = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))))
    kept = rows.where(F.col("vec_id").isNotNull() & usable(vector))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each block of rows of one length: ids in order, least components, and the bitmaps of all bits.

    Bitmap (d, b) has bit b of component d less its least value in the block; the bits of a
    row stand at its place in the order of ids, so that of equal rows the first has the smallest id.
    """

    def pack(ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order].astype(np.int64)
        least = matrix.min(axis=0)
        above = (matrix.view(np.uint64) - least.view(np.uint64)).T  # modulo 2 ** 64, which any difference of two longs fits
        bits = max(1, int(above.max(initial=0)).bit_length())
        words = -(-len(ids) // 64)
        flat = np.zeros((above.shape[0], bits, words * 64), np.uint8)
        for b in range(bits):
            flat[:, b, : len(ids)] = (above >> np.uint64(b)) & np.uint64(1)
        maps = np.packbits(flat, axis=2, bitorder="little")
        row = [len(ids), above.shape[0], bits, ids.tobytes(), least.tobytes(), maps.tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["n", "width", "bits", "ids", "least", "maps"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for width in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == width)
                matrix = flat[starts[own][:, None] + np.arange(width)]
                held.setdefault(width, []).append((ids[own], matrix))
                counts[width] = counts.get(width, 0) + len(own)
                if counts[width] >= block_rows:
                    all_ids, all_rows = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
                    for at in range(0, len(all_ids), block_rows):
                        yield pack(all_ids[at : at + block_rows], all_rows[at : at + block_rows])
                    counts[width] = 0
        for parts in held.values():
            all_ids, all_rows = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pack(all_ids, all_rows)

    return vectors.mapInArrow(blocks, "n long, width long, bits long, ids binary, least binary, maps binary")


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(shift, sign) of the non-adjacent form of ``value``: at most every other power of two."""
    digits, shift = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            digits.append((shift, digit))
            value -= digit
        value >>= 1
        shift += 1
    return digits


class Query:
    """A query vector as the bitmaps to add: for each power of two, which bit of which component, plain or inverted."""

    def __init__(self, query_id: int, vector: list[int]) -> None:
        self.query_id, self.vector = query_id, vector
        self.terms = [(d, shift, sign) for d, x in enumerate(vector) for shift, sign in signed_digits(int(x))]
        self.plans: dict[int, tuple[list[np.ndarray], int]] = {}

    def plan(self, bits: int) -> tuple[list[np.ndarray], int]:
        """Rows of the table of bitmaps (plain ones first) under each power, and what the inverted ones add too much."""
        if bits not in self.plans:
            width, columns, excess = len(self.vector), {}, 0
            for d, shift, sign in self.terms:
                inverted = 0 if sign > 0 else width * bits
                excess += 0 if sign > 0 else ((1 << bits) - 1) << shift
                for b in range(bits):
                    columns.setdefault(shift + b, []).append(inverted + d * bits + b)
            self.plans[bits] = ([np.array(columns.get(w, []), np.int32) for w in range(max(columns, default=-1) + 1)], excess)
        return self.plans[bits]


def add_slices(maps: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Bitmaps of the sum, least significant first: full adders take three bitmaps of a power to one, and one of the next."""
    out, carried, power = [], [], 0
    while power < len(columns) or carried:
        own = [maps[columns[power]]] if power < len(columns) and len(columns[power]) else []
        rows = np.concatenate(own + carried) if own or carried else np.zeros((1, maps.shape[1]), np.uint64)
        carried = []
        while len(rows) > 1:
            third = len(rows) // 3
            if third:
                x, y, z, rest = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third], rows[3 * third :]
                either = x ^ y
                carried.append((x & y) | (z & either))
                rows = np.concatenate([either ^ z, rest])
            else:
                carried.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
        out.append(rows[0])
        power += 1
    return out


def select_top(slices: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest sums among ``allowed``, from the most significant slice down; of equal ones the first places."""
    sure, open_ = np.zeros_like(allowed), allowed
    n_sure = 0
    for one in reversed(slices):
        higher = open_ & one
        n = n_sure + int(np.bitwise_count(higher).sum())
        if n > k:
            open_ = higher
        else:
            sure, open_, n_sure = sure | higher, open_ & ~one, n
            if n == k:
                break
    places = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    return np.concatenate([places(sure), places(open_)[: k - n_sure]])


def query_blocks(queries: DataFrame, block_queries: int) -> tuple[DataFrame, int]:
    """block and queries, an array of about ``block_queries`` of (q, vec_id, vector) with q unique, and the number of blocks."""
    asked = materialise(queries.withColumn("q", F.monotonically_increasing_id()), "queries")
    n_blocks = max(1, -(-asked.count() // block_queries))
    block = F.pmod(F.xxhash64("q"), F.lit(n_blocks)).alias("block")
    blocks = materialise(asked.groupBy(block).agg(F.collect_list(F.struct("q", "vec_id", "vector")).alias("queries")), "query-blocks")
    drop_scratch(asked)
    return blocks, n_blocks


def paired(index: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Each block of the index beside each block of queries, which are a stated set; neither side passes through the driver unless its bytes are few."""
    width = blocks.select(F.sum(F.aggregate("queries", F.lit(0).cast("long"), lambda s, x: s + 8 * F.size(x["vector"]) + 64))).first()[0] or 0
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")).alias("block")
    if width <= MOST_BROADCAST_BYTES:
        return index.select("*", every).join(F.broadcast(blocks), "block")
    numbered = materialise(index.withColumn("place", F.monotonically_increasing_id()), "bit-slices")
    places = numbered.select("place", every)  # numbers alone; bitmaps and vectors then travel once a pair
    return places.join(blocks, "block").join(numbered, "place").drop("place")


def search(pairs: DataFrame, k: int) -> DataFrame:
    """(q, query_id, vec_id, high, low): for each query, the best k rows of each block, other than rows with its id."""
    names = ["q", "query_id", "vec_id", "high", "low"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, list[Query]] = (None, [])
        for batch in batches:
            for at_row in range(batch.num_rows):
                row = {c: batch.column(c)[at_row].as_py() for c in ("block", "n", "width", "bits", "ids", "least", "maps")}
                if held[0] != row["block"]:
                    held = (row["block"], [(x["q"], Query(x["vec_id"], x["vector"])) for x in batch.column("queries")[at_row].as_py()])
                ids, least = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["least"], np.int64)
                plain = np.frombuffer(row["maps"], np.uint64).reshape(row["width"] * row["bits"], -(-row["n"] // 64))
                maps = np.concatenate([plain, ~plain])
                room = plain.shape[1] * 64
                valid = np.packbits(np.arange(room) < row["n"], bitorder="little").view(np.uint64)
                out: list[list[int]] = [[] for _ in names]
                for q, query in held[1]:
                    if len(query.vector) != row["width"]:
                        continue
                    columns, excess = query.plan(row["bits"])
                    slices = add_slices(maps, columns)
                    allowed = valid
                    low, high = np.searchsorted(ids, query.query_id), np.searchsorted(ids, query.query_id, "right")
                    if low < high:
                        mine = np.zeros(room, bool)
                        mine[low:high] = True
                        allowed = valid & ~np.packbits(mine, bitorder="little").view(np.uint64)
                    at = select_top(slices, allowed, k)
                    bits = [((one[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).tolist() for one in slices]
                    base = sum(x * y for x, y in zip(query.vector, least.tolist(), strict=True)) - excess
                    for j, vec_id in enumerate(ids[at].tolist()):
                        score = base + sum(own[j] << power for power, own in enumerate(bits))  # whole numbers of any size
                        score_high = max(-(2**63), min(2**63 - 1, score >> LIMB))
                        for column, x in zip(out, (q, query.query_id, vec_id, score_high, score & ((1 << LIMB) - 1)), strict=True):
                            column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    return pairs.mapInArrow(best, ", ".join(f"{n} long" for n in names))


def top_inner_products(
    candidates: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k best rows of ``candidates`` (vec_id, embedding).

    The score is the inner product of the vectors floor(scale * x); ties go to the smaller
    vec_id.  The index is written once; queries are a stated set, which meets its blocks
    ``block_queries`` at a time on the executors, and a block gives back at most k rows for each.

    Rows with a null id, a null vector, or null or non-finite components take no part; finite
    components of any size do.  A score beyond a long is given as the nearest long, its rank
    is by the exact one.  Empty vectors score 0 among each other; vectors of another length,
    and rows with the query's own id, are no candidates of a query; repeated queries are
    answered each; with fewer than k candidates all are given; empty tables give no rows;
    other columns are not read.
    """
    index = materialise(build_index(quantised(candidates, scale), block_rows), "bit-slices")
    blocks, n_blocks = query_blocks(quantised(queries, scale), block_queries)
    found = search(paired(index, blocks, n_blocks), k)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("high").desc(), F.col("low").desc(), "vec_id"))
    within = F.col("high").between(-2, 1)
    score = F.when(within, F.shiftleft("high", LIMB) + F.col("low")).when(F.col("high") > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every vector whose id is divisible by 50, among all of ``embeddings``."""
    rows = table(spark, sf_dir, "embeddings")
    return top_inner_products(rows, rows.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= {TOP}
"""
