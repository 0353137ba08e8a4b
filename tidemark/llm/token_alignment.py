"""Alignment of two tokenizers: components of overlapping tokens by union-find, and counts of linked ids over the corpus."""

from __future__ import annotations

import hashlib
import importlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table, whole_batches

#: Where the vocabulary files are; every executor has them there.
TOKENIZERS = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BATCH_BYTES = 2 << 20
#: A pair is one long: the id of A times this, plus the id of B.
BASE = 1 << 32
#: Pairs counted together, 24 bytes each, may be broadcast to the documents; others are joined by shuffling them.
MOST_BROADCAST_PAIRS = 2_000_000
#: How a byte-level vocabulary writes bytes (fixed values): printable ones as themselves, the others from 256 on in order.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: How a byte-level tokenizer parts a text before it merges (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def written_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, and back."""
    others = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokens:
    """Ids of a byte-level vocabulary file, and the bytes of each id.

    Where ids are in order of merges, as in files of this kind, tiktoken encodes with them,
    which gives the same ids in a quarter of the time; otherwise the file's own library does.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        special = {t["id"]: t["content"] for t in held.get("added_tokens", [])}
        to_byte = written_bytes()
        vocabulary = {i: w for w, i in held["model"]["vocab"].items()} | special
        self.bytes = [b""] * (max(vocabulary) + 1)
        for i, w in vocabulary.items():
            self.bytes[i] = w.encode() if i in special else bytes(to_byte[c] for c in w)
        ranks = {self.bytes[i]: i for i in vocabulary if i not in special}
        merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
        order = [held["model"]["vocab"]["".join(m)] for m in merged]
        before, plain = held.get("pre_tokenizer") or {}, not held.get("normalizer")
        ordered = order == list(range(256, 256 + len(order))) and len(ranks) == 256 + len(order)
        if plain and ordered and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True):
            tiktoken = importlib.import_module("tiktoken")
            self.encode = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            own = importlib.import_module("tokenizers").Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids of a sentencepiece model, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        model = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [bytes([int(w[3:5], 16)]) if model.is_byte(i) else w.replace("▁", " ").encode() for i, w in enumerate(pieces)]
        self.encode = lambda text: model.encode(text, num_threads=1)


def roots_of(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The component, named by its least member, of each of ``n`` nodes under the edges (x, y): a union-find over arrays.

    In a round every root that an edge ties to a smaller one is hung below it (union), then
    paths are halved until each node points at its root (find); edges within a tree go.
    """
    parent = np.arange(n)
    while len(x):
        a, b = parent[x], parent[y]
        open_ = a != b
        x, y, low, high = x[open_], y[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        np.minimum.at(parent, high, low)
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return parent


class Alignment:
    """Groups and links of one text's tokens, given the ends of A's and of B's tokens in bytes."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        n_a, n_b = len(ends_a), len(ends_b)
        cuts = np.union1d(ends_a, ends_b)  # between two of them one token of each side overlaps the other
        self.of = roots_of(n_a + n_b, np.searchsorted(ends_a, cuts), n_a + np.searchsorted(ends_b, cuts))
        # Members of a component stand together on either side, so its number is that of its first A token in order.
        order = np.cumsum(np.diff(self.of[:n_a], prepend=-1) != 0) - 1
        number = np.zeros(n_a + n_b, np.int64)
        number[self.of[:n_a]] = order
        self.group_a, self.group_b = order, number[self.of[n_a:]]
        self.n_groups = int(order[-1]) + 1 if n_a else 0
        at = np.minimum(np.searchsorted(ends_b, ends_a), max(n_b - 1, 0))
        self.link_a = np.flatnonzero((ends_b[at] == ends_a) & (self.group_a == self.group_b[at]))  # members that end together
        self.link_b = at[self.link_a]

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each A and B token stands when groups are written one after the other, A's before B's, and whether it is the last of its side."""
        per_a, per_b = np.bincount(self.group_a, minlength=self.n_groups), np.bincount(self.group_b, minlength=self.n_groups)
        before_b = np.cumsum(per_b) - per_b
        place_a = np.arange(len(self.group_a)) + before_b[self.group_a]
        place_b = np.arange(len(self.group_b)) + np.cumsum(per_a)[self.group_b]
        last = lambda group: np.append(group[1:] != group[:-1], True)
        return place_a, place_b, last(self.group_a), last(self.group_b)


class Aligner:
    """Both tokenizers, and the decimal form of every id with what can follow it."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        self.length_a, self.length_b = (np.array([len(x) for x in side.bytes]) for side in (self.a, self.b))
        self.most = max(len(self.a.bytes), len(self.b.bytes))
        self.written = [f"{i}{mark}".encode() for mark in (",", "|", ";") for i in range(self.most)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None where a text is null, empty or not given back by both."""
        if not text:
            return None
        want = b" " + text.encode()
        own = []
        for side, given in ((self.a, " " + text), (self.b, text)):
            ids = side.encode(given)
            if b"".join(map(side.bytes.__getitem__, ids)) != want:
                return None
            own.append(np.array(ids, np.int64))
        return own[0], own[1]

    def align(self, a: np.ndarray, b: np.ndarray) -> Alignment:
        return Alignment(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))

    def written_groups(self, a: np.ndarray, b: np.ndarray, found: Alignment) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        place_a, place_b, last_a, last_b = found.places()
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a] = a + self.most * last_a
        codes[place_b] = b + 2 * self.most * last_b
        return b"".join(map(self.written.__getitem__, codes.tolist()))[:-1]


ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """For each row its counts, the digest of its groups, and the different linked pairs with how often each stands in it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_path, piece_path)
        for batch in whole_batches(batches, BATCH_BYTES):
            counts, digests, pairs, times = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = aligner.encode(text)
                if ids is None:
                    counts.append((0, 0, 0, 0))
                    digests.append("")
                    own = of = np.empty(0, np.int64)
                else:
                    found = aligner.align(*ids)
                    counts.append((len(ids[0]), len(ids[1]), found.n_groups, len(found.link_a)))
                    digests.append(hashlib.sha256(aligner.written_groups(*ids, found)).hexdigest())
                    own, of = np.unique(ids[0][found.link_a] * BASE + ids[1][found.link_b], return_counts=True)
                pairs.append(own)
                times.append(of)
            starts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in pairs])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x), t)) for x, t in ((pairs, pa.int64()), (times, pa.int32()))]
            numbers = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *numbers, pa.array(digests), *lists], names=names)

    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(rows, ROW)


def pair_counts(each: DataFrame) -> DataFrame:
    """pair, count and best: how many links of the corpus have each pair of ids, and whether no pair of its B id has more."""
    counts = each.groupBy("pair").agg(F.sum("times").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.pmod("pair", F.lit(BASE))))
    return counts.withColumn("best", (F.col("count") == most).cast("int"))


def align_tokenizers(docs: DataFrame, folder: str = TOKENIZERS, byte_file: str = BYTE_FILE, piece_file: str = PIECE_FILE) -> tuple[DataFrame, DataFrame]:
    """Every document's alignment, and the pairs of ids with their counts.

    A document's tokens overlap where their bytes do; the components of that graph are the
    least groups of tokens that cover the same bytes, and members of a component that end
    together are links.  Texts are encoded once; links are counted in each document, then over
    the corpus, where Spark adds up before it shuffles, so frequent pairs don't gather.

    Returns (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for
    each row of ``docs`` (doc_id, text), and (a, b, count, best): ids, links, whether no other A
    id is linked with that B id more often.

    Null and empty texts, and those that either tokenizer doesn't give back byte by byte, have
    no tokens: zeros and an empty digest.  Texts are encoded whole, strings of special tokens as
    plain text.  Null and repeated ids are rows of their own, repeated rows count each; ties for
    the best are all best; an empty table gives no rows; other columns are not read.
    """
    rows = materialise(aligned(docs, f"{folder}/{byte_file}", f"{folder}/{piece_file}"), "aligned")
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = materialise(pair_counts(each), "pairs")
    few = counts.limit(MOST_BROADCAST_PAIRS + 1).count() <= MOST_BROADCAST_PAIRS
    joined = each.join(F.broadcast(counts) if few else counts, "pair")
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    sums = materialise(sums, "pair-sums")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = rows.drop("pairs", "times").join(sums, "row", "left")
    out = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    ids = counts.select(F.floor(F.col("pair") / BASE).alias("a"), F.pmod("pair", F.lit(BASE)).alias("b"), "count", (F.col("best") == 1).alias("best"))
    return out, ids


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align both tokenizers over the whole ``documents`` table."""
    return align_tokenizers(table(spark, sf_dir, "documents"))[0]
