"""Near-duplicate documents by HyperMinHash: compressed registers, banded, estimated, then confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import binary_texts, components, drop_scratch, materialise, table, whole_batches

SHINGLE_WORDS, PERCENT = 5, 75
#: A band holds four 16-bit registers, which are one long; at a similarity of 0.75 a link misses all bands once in 190,000.
REGISTERS, BAND_REGISTERS, MANTISSA_BITS, BUCKET_BITS, VALUE_BITS = 128, 4, 10, 7, 57
#: Estimates have a standard deviation of 0.04; pairs further below the threshold than this aren't confirmed.
SLACK = 0.25
#: Buckets up to this size give all their open pairs at once; the last way gives this many centres a round.
SMALL_BUCKET, CENTRES = 4, 256
#: So many ids, 8 bytes each, may be broadcast to find their texts; more are joined by shuffling the texts.
MOST_BROADCAST_IDS = 1_000_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BATCH_BYTES = 4 << 20


class WordHashes(dict):
    """64-bit hashes of words, remembered while they are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word runs of ``width``, or of the whole sequence where it is shorter."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    of = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    runs = len(of) - width + 1
    acc = np.full(runs, width, np.uint64)
    for j in range(width):
        acc = mixed(acc + of[j : j + runs])
    return np.unique(acc)


def probes() -> np.ndarray:
    """For each empty bucket the buckets it borrows from, in order of trial."""
    return np.random.default_rng(20240229).integers(0, REGISTERS, (400, REGISTERS))


def registers(sets: list[np.ndarray], trials: np.ndarray) -> np.ndarray:
    """Rows of HyperMinHash registers: leading zeros of a bucket's least hash, then its mantissa bits.

    The first bits of a hash choose its bucket.  An empty bucket borrows the register of the
    first non-empty one among its trials, which sets of one size do alike, so small sets
    agree in as many buckets as large ones.
    """
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(VALUE_BITS)
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    full = np.zeros((len(sets), REGISTERS), bool)
    for k, own in enumerate(sets):
        at = np.searchsorted(own, edges)
        full[k] = np.append(at[1:], len(own)) > at
        least[k] = own[np.minimum(at, len(own) - 1)]
    value = (least & np.uint64((1 << VALUE_BITS) - 1)).astype(np.float64)
    mantissa, exponent = np.frexp(value)
    low = np.clip((mantissa - 0.5) * (2 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1).astype(np.int64)
    out = (np.clip(VALUE_BITS - exponent, 0, 63).astype(np.int64) << MANTISSA_BITS) | low
    row, bucket = np.nonzero(~full)
    for trial in trials:
        if not len(row):
            break
        source = trial[bucket]
        good = full[row, source]
        out[row[good], bucket[good]] = out[row[good], source[good]]
        row, bucket = row[~good], bucket[~good]
    for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
        there = np.flatnonzero(full[r])
        out[r, b] = out[r, there[np.searchsorted(there, b) % len(there)]]
    return out


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, and for texts with words the digest of the set and its registers, a band in each long."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, trials = WordHashes(), probes()
        shift = np.arange(0, 16 * BAND_REGISTERS, 16).astype(np.int64)
        for batch in whole_batches(source, BATCH_BYTES):
            sets = [shingle_set(t, width, hashes) for t in binary_texts(batch.column("text"))]
            sizes = np.array([len(s) for s in sets], np.int64)
            bands = (registers([s for s in sets if len(s)], trials).reshape(-1, REGISTERS // BAND_REGISTERS, BAND_REGISTERS) << shift).sum(axis=2)
            at, packed = iter(bands), []
            for s in sets:
                packed.append(next(at).tolist() if len(s) else None)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(packed, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, n_shingles long, digest binary, bands array<long>")


def accidental(size_a: Column, size_b: Column) -> Column:
    """Chance that the registers of two different least hashes agree: both in one octave and alike in the mantissa."""

    def octave(size: Column, j: int) -> Column:
        mean = F.greatest(size / REGISTERS, F.lit(1.0))
        return F.pow(F.lit(1 - 2.0 ** -(j + 1)), mean) - F.pow(F.lit(1 - 2.0**-j), mean)

    return sum((octave(size_a, j) * octave(size_b, j) for j in range(24)), F.lit(0.0)) / (1 << MANTISSA_BITS)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose collision-corrected estimate isn't far below it."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"))
    both = pairs.join(side("a"), "a").where(F.col("n_a") > 0).join(side("b"), "b")
    lane = lambda z, k: F.when(F.shiftrightunsigned(z, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0)
    agree = F.aggregate(
        F.zip_with("bands_a", "bands_b", lambda x, y: x.bitwiseXOR(y)),
        F.lit(0),
        lambda s, z: s + lane(z, 0) + lane(z, 1) + lane(z, 2) + lane(z, 3),
    )
    by_chance = accidental(F.col("n_a"), F.col("n_b"))
    similarity = (agree / F.lit(float(REGISTERS)) - by_chance) / (1 - by_chance)
    return both.where(similarity >= percent / 100 - SLACK).select("a", "b")


def texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, text) of the documents ``reps``; their ids go to where the texts are, unless they are too many to broadcast."""
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    few = reps.limit(MOST_BROADCAST_IDS + 1).count() <= MOST_BROADCAST_IDS
    return rows.join(F.broadcast(reps) if few else reps, "rep", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in whole_batches(source, BATCH_BYTES):
            keep = []
            for b, x, y in zip(batch.column("b").to_pylist(), binary_texts(batch.column("text_a")), binary_texts(batch.column("text_b")), strict=True):
                if last[0] != b:
                    last = (b, shingle_set(y, width, hashes))
                one, two = shingle_set(x, width, hashes), last[1]
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    text = lambda x: texts_of(docs, pairs.select(F.col(x).alias("rep")).distinct()).select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(batches, "a long, b long")


class Links:
    """Verified links so far and the components they make."""

    def __init__(self, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> None:
        self.classes, self.docs, self.width, self.percent = classes, docs, width, percent
        self.component: DataFrame | None = None

    def labelled(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with the component of their column ``key``."""
        if self.component is None:
            return rows.withColumn(name, F.col(key))
        of = self.component.select(F.col("node").alias(key), F.col("component").alias("_c"))
        return rows.join(of, key, "left").withColumn(name, F.coalesce("_c", key)).drop("_c")

    def test(self, pairs: DataFrame) -> None:
        """Confirm ``pairs`` whose ends aren't connected yet, and join what they connect."""
        open_ = self.labelled(self.labelled(pairs, "a", "_ca"), "b", "_cb").where("_ca <> _cb").select("a", "b") if self.component is not None else pairs
        likely = materialise(estimated(open_, self.classes, self.percent), "likely")
        edges = materialise(confirmed(likely, self.docs, self.width, self.percent), "edges")
        drop_scratch(likely)
        if edges.isEmpty():
            return
        if self.component is None:
            self.component = materialise(components(edges), "component")
            return
        # What is settled is one node by now: only the new links between components are followed.
        between = self.labelled(self.labelled(edges, "a", "_ca"), "b", "_cb").select(F.col("_ca").alias("a"), F.col("_cb").alias("b"))
        step = materialise(components(between), "steps")
        joined = self.component.join(step.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
        joined = joined.select("node", F.coalesce("_to", "component").alias("component"))
        fresh = step.join(self.component, "node", "left_anti").select("node", "component")
        after = materialise(joined.unionByName(fresh), "component")
        drop_scratch(self.component, step, edges)
        self.component = after


def may_reach(percent: int, size_a: str, pos_a: str, size_b: str, pos_b: str) -> Column:
    """Whether two sets whose first common element has these places (from 1) in a common order can overlap enough."""
    most = F.least(F.col(size_a) - F.col(pos_a), F.col(size_b) - F.col(pos_b)) + 1
    return (100 + percent) * most >= percent * (F.col(size_a) + F.col(size_b))


SLOT = ["rep", "size", "pos"]


def meetings(slots: DataFrame, key: list[str]) -> DataFrame:
    """``slots`` (key, rep, size, pos) that others share, with n, their number, and company, the sum of n over a rep's slots."""
    shared = materialise(slots.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = materialise(slots.join(shared, key), "met")
    members = materialise(met.join(met.groupBy("rep").agg(F.sum("n").alias("company")), "rep"), "members")
    drop_scratch(shared, met)
    return members


def star_rounds(members: DataFrame, key: list[str], links: Links) -> DataFrame:
    """Test each bucket's members against its centre, the one with most company; first each member's best centre alone.

    A large group of near copies settles here with one pair for each member and centre.
    Returns the pairs (a > b) that need no more test.
    """
    centre = F.max(F.struct("company", (-F.col("rep")).alias("rep"), "size")).alias("c")
    centres = members.groupBy(key).agg(centre).select(*key, (-F.col("c.rep")).alias("centre"), F.col("c.company").alias("rank"), F.col("c.size").alias("_size"))
    centres = materialise(centres, "centres")
    near = members.join(centres, key).where("rep <> centre").where(may_reach(links.percent, "size", "pos", "_size", "pos"))
    star = near.groupBy(F.col("rep").alias("a"), F.col("centre").alias("b")).agg(F.count("*").alias("shared"), F.max("rank").alias("rank"))
    star = materialise(star, "star")
    drop_scratch(centres)
    if not star.isEmpty():
        best = star.groupBy("a").agg(F.max(F.struct("shared", "rank", (-F.col("b")).alias("b"))).alias("m"))
        links.test(best.select("a", (-F.col("m.b")).alias("b")))
        links.test(star.select("a", "b"))
    return star


def small_buckets(members: DataFrame, key: list[str], links: Links, tested: DataFrame) -> DataFrame:
    """Test all pairs across components in open buckets of few members; returns the members of the larger open ones."""
    inside = links.labelled(members, "rep", "component")
    several = inside.groupBy(key).agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x <> _y").select(*key)
    open_ = materialise(inside.join(several, key), "open")
    few = open_.where(F.col("n") <= SMALL_BUCKET)
    other = few.select(*key, F.col("rep").alias("b"), F.col("component").alias("_other"), F.col("size").alias("_size"))
    pairs = few.withColumnRenamed("rep", "a").join(other, key).where("a > b and component <> _other")
    pairs = pairs.where(may_reach(links.percent, "size", "pos", "_size", "pos")).select("a", "b").distinct()
    known = tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialise(pairs.join(known, ["a", "b"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        links.test(pairs)
    return open_.where(F.col("n") > SMALL_BUCKET)


def rare_shingles(reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(shingle, rep, size, pos): of each document the shingles that any partner of the similarity must share one of.

    Ordered from rare to frequent among ``reps``, a set of n shingles that overlaps another
    enough has one of its first n - ceil(percent n / 100) + 1 in common with it.  Passages
    that very many documents share come last and bring no documents together; ``pos``, the
    place in that order, bounds what two documents can still have in common.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in whole_batches(source, BATCH_BYTES):
            sets = [shingle_set(t, width, hashes).view(np.int64) for t in binary_texts(batch.column("text"))]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            values = pa.array(np.concatenate([*sets, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(offsets, values)], names=["rep", "shingles"])

    sets = materialise(texts_of(docs, reps).mapInArrow(batches, "rep long, shingles array<long>"), "sets")
    each = sets.select("rep", F.size("shingles").cast("long").alias("size"), F.explode("shingles").alias("shingle"))
    counts = materialise(each.groupBy("shingle").agg(F.count("*").alias("frequency")).where("frequency > 1"), "frequencies")
    whole = Window.partitionBy("rep")
    shared = each.join(counts, "shingle").withColumn("place", F.row_number().over(whole.orderBy("frequency", "shingle")))
    pos = (F.col("size") - F.count("*").over(whole) + F.col("place")).cast("long")
    out = shared.withColumn("pos", pos).where(F.col("pos") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1)
    out = materialise(out.select("shingle", *SLOT), "rare")
    drop_scratch(sets, counts)
    return out


def centre_rounds(left: DataFrame, key: list[str], links: Links) -> None:
    """Members outside the largest component of their bucket become centres in turn, until no bucket is open."""
    while True:
        inside = links.labelled(left, "rep", "component")
        sizes = inside.groupBy(*key, "component").agg(F.count("*").alias("members"))
        largest = sizes.groupBy(key).agg(F.max(F.struct("members", "component")).alias("m"), F.count("*").alias("parts"))
        largest = materialise(largest.where("parts > 1").select(*key, F.col("m.component").alias("main")), "largest")
        if largest.isEmpty():
            return
        inside = materialise(inside.join(largest, key), "inside")
        place = F.row_number().over(Window.partitionBy(*key).orderBy("pos", "rep"))  # Spark keeps the first CENTRES of each task before it shuffles
        chosen = inside.where("component <> main").withColumn("place", place).where(F.col("place") <= CENTRES)
        chosen = chosen.select(*key, F.col("rep").alias("b"), F.col("component").alias("_other"), F.col("size").alias("_size"), F.col("pos").alias("_pos"))
        chosen = materialise(chosen, "chosen")
        pairs = inside.join(chosen, key).where("rep <> b and component <> _other").where(may_reach(links.percent, "size", "pos", "_size", "_pos"))
        links.test(pairs.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct())
        rest = inside.drop("component", "main").join(chosen.select(*key, F.col("b").alias("rep")), [*key, "rep"], "left_anti")
        left = materialise(rest, "large")
        drop_scratch(inside, chosen, largest)


def candidate_rounds(classes: DataFrame, links: Links) -> None:
    """Test pairs that share a band, until no bucket holds an untested pair across two components.

    Larger buckets that stay open, as those of texts with a common passage do, are taken apart
    by the rare shingles of their members, which lose no pair.
    """
    key = ["band", "value"]
    slots = classes.select("rep", F.col("n_shingles").alias("size"), F.lit(1).cast("long").alias("pos"), F.posexplode("bands").alias("band", "value"))
    members = meetings(slots, key)
    reps = materialise(small_buckets(members, key, links, star_rounds(members, key, links)).select("rep").distinct(), "open")
    drop_scratch(members)
    if not reps.isEmpty():
        centre_rounds(rare_shingles(reps, links.docs, links.width, links.percent), ["shingle"], links)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Documents are linked where 100 * intersection >= ``percent`` * union of their shingle sets;
    component_id is the smallest doc_id that can be reached and kept marks the document that
    has it.  Texts with equal sets are one class, which only its smallest id stands for.

    Null or empty texts have no shingles, link with nothing and are kept.  A row with a null id
    takes no part: its component is null and it is kept.  Repeated rows are copies of one
    another and are all kept if one is; different texts under one id count as one document.
    An empty table gives no rows; other columns are not read.
    """
    sketches = materialise(sketch(docs, width), "sketches")
    sets = sketches.where("digest is not null and doc_id is not null")
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    classes = materialise(classes, "classes")
    links = Links(classes, docs, width, percent)
    candidate_rounds(classes, links)
    least = materialise(links.labelled(classes.select("digest", "rep"), "rep", "component_id").drop("rep"), "least")
    drop_scratch(classes)
    rows = sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = rows.join(least, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group the near-duplicates of the whole ``documents`` table."""
    return near_duplicates(table(spark, sf_dir, "documents"))


WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE_WORDS} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(w[i : i + {SHINGLE_WORDS - 1}], ' '))) END AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM x p JOIN x q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM common JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= {PERCENT} * (len(p.s) + len(q.s) - n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
