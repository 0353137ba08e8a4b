"""Approximate nearest neighbours by cosine: forests of random-projection trees, one shared priority queue, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_scratch, materialise, table
from tidemark.llm.exact_topk import paired, usable

TOP, TREES, LEAF_ROWS, SHARD_ROWS, BLOCK_QUERIES = 5, 8, 128, 8_192, 2_048
#: A search ends when it has gathered this share of a shard's rows, and at least so many, or earlier if no leaf left can hold a nearer row.
SEARCH_SHARE, LEAST_GATHERED = 0.6, 2_048


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which leaves cosines as they are, so that no square runs over or vanishes."""
    exponents = np.frexp(np.abs(matrix).max(axis=1, initial=0))[1]
    return np.ldexp(matrix, -exponents[:, None])


def unit(matrix: np.ndarray) -> np.ndarray:
    rows = scaled(matrix)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of one vector and rows, in double precision, summed alike whatever stands beside a row."""
    one, many = scaled(query[None])[0], scaled(rows)
    return (many * one).sum(axis=1) / (np.sqrt((one * one).sum()) * np.sqrt((many * many).sum(axis=1)))


class Forest:
    """Trees over unit vectors: each node parts its rows at the median of their projection on the line through two of them.

    ``children`` holds nodes as numbers from 0, leaves as -1 - leaf; leaf k has the rows
    ``members[starts[k]:starts[k + 1]]``.  Rows that no projection can part stay in one leaf.
    """

    KINDS = (("normals", np.float64), ("offsets", np.float64), ("children", np.int32), ("roots", np.int32), ("starts", np.int32), ("members", np.int32))

    def __init__(self, width: int, parts: list[np.ndarray]) -> None:
        self.normals, self.offsets, self.children, self.roots, self.starts, self.members = parts
        self.normals, self.children = self.normals.reshape(-1, width), self.children.reshape(-1, 2)

    @classmethod
    def plant(cls, rows: np.ndarray, trees: int, leaf_rows: int, seed: int) -> Forest:
        rng, width = np.random.default_rng(seed), rows.shape[1]
        normals: list[np.ndarray] = []
        offsets: list[float] = []
        children: list[list[int]] = []
        leaves: list[np.ndarray] = []
        roots = []

        def leaf(own: np.ndarray) -> int:
            leaves.append(own)
            return -len(leaves)

        for _ in range(trees):
            roots.append(len(children) if len(rows) > leaf_rows else -1 - len(leaves))
            todo: list[tuple[np.ndarray, tuple[int, int] | None]] = [(np.arange(len(rows), dtype=np.int32), None)]
            while todo:
                own, above = todo.pop()
                split = None
                if len(own) > leaf_rows:
                    a, b = rows[rng.choice(own, 2, replace=False)]
                    line = a - b if np.abs(a - b).max() > 1e-9 else rng.standard_normal(width)
                    line = line / np.sqrt((line * line).sum())
                    along = rows[own] @ line
                    at = np.median(along)
                    low = along <= at
                    if low.all():  # more than half share the greatest value
                        low = along < at
                    if low.any():
                        split = line, at, low
                if split is None:
                    number = leaf(own)
                else:
                    number = len(children)
                    normals.append(split[0])
                    offsets.append(split[1])
                    children.append([0, 0])
                    todo += [(own[split[2]], (number, 0)), (own[~split[2]], (number, 1))]
                if above is None:
                    roots[-1] = number
                else:
                    children[above[0]][above[1]] = number
        starts = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        parts = [np.array(normals, float).reshape(-1), np.array(offsets, float), np.array(children, np.int32).reshape(-1), np.array(roots, np.int32), starts.astype(np.int32), np.concatenate(leaves)]
        return cls(width, parts)

    def search(self, query: np.ndarray, margins: np.ndarray, rows: np.ndarray, k: int, need: int) -> np.ndarray:
        """Places of the rows gathered for a unit vector, leaf by leaf from one queue over all trees.

        A leaf's priority is the least margin on its way, on the leaf's side of each plane; a
        margin below zero is a distance that every row of the leaf has at least, so the queue
        is done when it exceeds that of the k nearest rows found.
        """
        seen = np.zeros(len(rows), bool)
        queue = [(-np.inf, int(root)) for root in self.roots]
        heapq.heapify(queue)
        gathered, popped, reach, fresh = 0, 0, np.inf, []
        best = np.empty(0)
        while queue and gathered < need:
            against, at = heapq.heappop(queue)
            if against > reach:
                break
            if at >= 0:
                margin, (low, high) = float(margins[at]), self.children[at].tolist()
                heapq.heappush(queue, (max(against, margin), low))
                heapq.heappush(queue, (max(against, -margin), high))
                continue
            own = self.members[self.starts[-1 - at] : self.starts[-at]]
            own = own[~seen[own]]
            seen[own] = True
            gathered += len(own)
            fresh.append(own)
            popped += 1
            if popped & (popped - 1) == 0:  # after 1, 2, 4, ... leaves
                best = np.concatenate([best, rows[np.concatenate(fresh)] @ query])
                fresh = []
                if len(best) >= k:
                    best = np.partition(best, len(best) - k)[-k:]
                    reach = float(np.sqrt(max(0.0, 2 - 2 * best.min()))) + 1e-9
        return np.flatnonzero(seen)


INDEX = ["n", "width", "firsts", "ids", "vectors", *[name for name, _ in Forest.KINDS]]


def distinct_vectors(rows: DataFrame, most_ids: int) -> DataFrame:
    """vector and ids: every different vector with the least ``most_ids`` of its ids, in order.

    Spark keeps the least ids of each vector before it shuffles, so copies by the million don't meet.
    """
    least = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("_r") <= most_ids)
    return least.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def build_index(vectors: DataFrame, trees: int, leaf_rows: int, shard_rows: int) -> DataFrame:
    """One row for each shard of about ``shard_rows`` different vectors (vector, ids) of one length, with its forest."""
    vectors = materialise(vectors, "vectors")
    n_shards = max(1, -(-vectors.count() // shard_rows))

    def shard(key: tuple, rows: pa.Table) -> pa.Table:
        lists = rows.column("vector").combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        matrix = flat.reshape(len(lists), -1)
        ids = rows.column("ids").combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy())
        own = ids.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort(matrix.T[::-1])  # whatever order the shuffle left
        starts = np.cumsum(sizes) - sizes
        listed = np.concatenate([own[starts[k] : starts[k] + sizes[k]] for k in order])
        matrix, firsts = matrix[order], np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64)
        forest = Forest.plant(unit(matrix), trees, leaf_rows, key[0].as_py())
        parts = [firsts.tobytes(), listed.astype(np.int64).tobytes(), matrix.tobytes()]
        parts += [np.ascontiguousarray(getattr(forest, name), kind).tobytes() for name, kind in Forest.KINDS]
        return pa.table([pa.array([len(matrix)], pa.int64()), pa.array([matrix.shape[1]], pa.int64()), *[pa.array([x], pa.binary()) for x in parts]], names=INDEX)

    schema = ", ".join(f"{name} {'long' if k < 2 else 'binary'}" for k, name in enumerate(INDEX))
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(n_shards))).withColumn("width", F.size("vector"))
    return materialise(placed.groupBy("shard", "width").applyInArrow(shard, schema), "forests")


def search(pairs: DataFrame, k: int, share: float) -> DataFrame:
    """(q, vec_id, score): for each query vector the ``k`` nearest ids of each shard, among the rows its forest gives."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, dict[int, tuple[list[int], np.ndarray]]] = (None, {})
        for batch in batches:
            for at_row in range(batch.num_rows):
                block = batch.column("block")[at_row].as_py()
                if held[0] != block:
                    asked = batch.column("queries")[at_row].values
                    numbers, lists = asked.field("q").to_numpy(), asked.field("vector")
                    sizes = np.diff(lists.offsets.to_numpy())
                    flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
                    widths = {w: np.flatnonzero(sizes == w) for w in np.unique(sizes).tolist()}
                    held = (block, {w: (numbers[own].tolist(), flat[starts[own][:, None] + np.arange(w)]) for w, own in widths.items()})
                row = {c: batch.column(c)[at_row].as_py() for c in INDEX}
                if row["width"] not in held[1]:
                    continue
                numbers, wanted = held[1][row["width"]]
                matrix = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["width"])
                firsts, ids = np.frombuffer(row["firsts"], np.int64), np.frombuffer(row["ids"], np.int64)
                forest = Forest(row["width"], [np.frombuffer(row[name], kind) for name, kind in Forest.KINDS])
                rows, directions = unit(matrix), unit(wanted)
                margins = directions @ forest.normals.T - forest.offsets
                need = max(LEAST_GATHERED, int(np.ceil(share * row["n"])))
                out: list[list] = [[], [], []]
                for j, q in enumerate(numbers):
                    near = forest.search(directions[j], margins[j], rows, k, need)
                    rough = rows[near] @ directions[j]
                    if len(near) > 2 * k:  # more than k, as the last places may change with exact scores
                        near = near[rough >= np.partition(rough, len(rough) - k)[-k] - 1e-9]
                    found: dict[int, float] = {}
                    for at, score in zip(near.tolist(), cosines(wanted[j], matrix[near]).tolist(), strict=True):
                        for vec_id in ids[firsts[at] : firsts[at + 1]].tolist():
                            found[vec_id] = max(score, found.get(vec_id, -np.inf))
                    for vec_id, score in heapq.nsmallest(k, found.items(), key=lambda x: (-x[1], x[0])):
                        for column, x in zip(out, (q, vec_id, score), strict=True):
                            column.append(x)
                if out[0]:
                    kinds = (pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["q", "vec_id", "score"])

    return pairs.mapInArrow(best, "q long, vec_id long, score double")


def nearest_neighbours(
    candidates: DataFrame, queries: DataFrame, k: int = TOP, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
    shard_rows: int = SHARD_ROWS, share: float = SEARCH_SHARE, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` the ``k`` rows of ``candidates`` (vec_id, embedding) of greatest cosine that the forests give.

    All rows are indexed, in shards by a hash of the vector, each with a forest grown on all its
    rows; no sample is taken.  Equal vectors are one entry, with as many of their least ids as a
    result can show, and equal queries are searched once.  A query's queue gathers leaves until it
    has ``share`` of a shard's rows, and LEAST_GATHERED of them; with a share of 1 the result is exact.
    Tests measure recall.

    Rows with a null id, and vectors that are null, empty, zero or have null or non-finite
    components take no part; finite ones of any size do.  Vectors of another length, and rows with
    the query's own id, are no candidates of a query.  Ties go to the smaller vec_id.  An id that
    is repeated counts once, by its nearest vector; repeated query rows are answered each.  With
    fewer than ``k`` candidates all are given; empty tables give no rows; other columns are not read.
    """
    def vectors(rows: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<double>")
        kept = rows.where(F.col("vec_id").isNotNull() & usable(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False)))
        return kept.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))

    index = build_index(distinct_vectors(vectors(candidates), k + 1), trees, leaf_rows, shard_rows)
    asked = vectors(queries)
    named = materialise(asked.select("vector").distinct().withColumn("q", F.monotonically_increasing_id()), "asked")
    n_blocks = max(1, -(-named.count() // block_queries))
    block = F.pmod(F.xxhash64("q"), F.lit(n_blocks)).alias("block")
    blocks = materialise(named.groupBy(block).agg(F.collect_list(F.struct("q", "vector")).alias("queries")), "asked-blocks")
    pairs = paired(index, blocks, n_blocks)
    found = materialise(search(pairs, k + 1, share), "found")
    once = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    top = once.withColumn("_r", place).where(F.col("_r") <= k + 1)
    lists = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("near"))
    members = asked.withColumnRenamed("vec_id", "query_id").join(named, "vector").select("q", "query_id")
    others = members.join(lists, "q").select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
    out = others.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("at", "x"))
    out = out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    drop_scratch(blocks)
    return out


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest partners of every vector whose id is divisible by 50, among all of ``embeddings``."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % 50 == 0))
