"""Language of a text by Bayesian fusion: text likelihoods, declared language, address suffix and smoothed host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import binary_texts, materialise, table, whole_batches

#: About so many labelled texts fit the text model, shared out evenly among the languages, each with LEAST_ROWS if it has
#: them: those with the least hashes.  Languages after the MOST_LANGUAGES most frequent ones share a column named POOLED.
SAMPLE_ROWS, LEAST_ROWS, MOST_LANGUAGES, POOLED = 4_000, 200, 64, "other"
CELLS, MICRO, CHUNK_BYTES = 1 << 13, 1_000_000, 1 << 20
#: Neighbouring character triples depend on each other, so that each counts as so much of an observation.
TEMPER = 0.35
#: Weight of the level above in the counts of a host and of a domain; weight of agreement in evidence tables.
HOST_WEIGHT, DOMAIN_WEIGHT, TABLE_WEIGHT = 4.0, 8.0, 2.0
UNDETERMINED, UNDETERMINED_PRIOR = "und", 1e-3
#: A-Z become a-z; other ASCII characters that are not letters become spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MARKUP = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def visible(text: bytes | None, markup: bool) -> bytes:
    """Lower-case letters and single spaces of a text, without its markup."""
    if not text:
        return b""
    if markup:
        text = MARKUP.sub(b" ", text)
    return b" ".join(text.translate(LETTERS).split())


def triples(letters: bytes) -> np.ndarray:
    """Cells of the byte triples of `` letters ``, one for each byte."""
    if not letters:
        return np.empty(0, np.int64)
    b = np.frombuffer(b" " + letters + b" ", np.uint8).astype(np.uint32)
    mixed = b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64)


def chunks(letters: bytes) -> Iterator[bytes]:
    return (letters[at : at + CHUNK_BYTES] for at in range(0, len(letters), CHUNK_BYTES))


class TextModel:
    """Log-likelihoods, in millionths, of triple cells: a column for each language and a last one that is even over all cells."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + 0.05
        logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(languages) else np.zeros((0, CELLS))
        # The even model stands for writing unlike any known language: it beats a language where most triples are unseen.
        self.table = np.concatenate([logs, np.full((1, CELLS), -np.log(CELLS))]).T
        self.table = np.ascontiguousarray(np.rint(self.table * TEMPER * MICRO).astype(np.int64))

    def score(self, letters: bytes) -> list[int]:
        total = np.zeros(self.table.shape[1], np.int64)
        for part in chunks(letters):
            cells = triples(part)
            total += self.table[cells].sum(axis=0) if len(cells) < CELLS else np.bincount(cells, minlength=CELLS) @ self.table
        return total.tolist()


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """The text model of ``labelled`` (doc_id, text, lang): a column for every language, from about ``sample_rows`` rows; the cells' counts are a grouped sum.

    Rows are drawn by the hash of their id, or of their text where that is null, so repeated rows are
    drawn together and count each; of languages equally frequent the first by name comes first
    among the MOST_LANGUAGES.  Null texts and languages take no part; an empty table gives a
    model without languages.
    """
    known = labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.select("lang", "text", F.pmod(F.xxhash64(F.lit("language:"), F.coalesce("id", "text")), F.lit(1 << 40)).alias("_draw"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("_draw").alias("low"))
    named = [r.lang for r in sizes.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(named) > MOST_LANGUAGES:
        column = F.when(F.col("lang").isin(named[:MOST_LANGUAGES]), F.col("lang")).otherwise(POOLED)
        known, sizes = known.withColumn("lang", column), sizes.withColumn("lang", column)
    found = sizes.groupBy("lang").agg(F.sum("n").alias("n"), F.min("low").alias("low")).orderBy("lang").collect() if named else []
    languages = [r.lang for r in found]
    rows_each = max(LEAST_ROWS, sample_rows // max(1, len(languages)))
    # The least hash is always in, so that no language is without a row.
    bounds = [x for r in found for x in (F.lit(r.lang), F.lit(max(r.low, (rows_each << 40) // r.n)).cast("long"))]
    sample = known.where(F.col("_draw") <= F.try_element_at(F.create_map(*bounds), F.col("lang"))) if bounds else known

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), binary_texts(batch.column("text")), strict=True):
                own = sums.setdefault(lang, np.zeros(CELLS, np.int64))
                for part in chunks(visible(text, False)):
                    own += np.bincount(triples(part), minlength=CELLS)
        for lang, own in sums.items():
            cells = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells), pa.array(own[cells])], names=["lang", "cell", "n"])

    rows = sample.select("lang", "text").mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), CELLS), np.int64)
    for r in rows.collect():
        counts[languages.index(r.lang), r.cell] = r.n
    return TextModel(languages, counts)


def text_scores(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """``rows`` with ``text`` replaced by ``scores``, a log-likelihood for each language and the even model, and ``letters``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in whole_batches(batches, 8 << 20):
            shown = [visible(t, markup) for t in binary_texts(batch.column("text"))]
            new = [pa.array([own.score(t) for t in shown], pa.list_(pa.int64())), pa.array([len(t) for t in shown], pa.int64())]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + new, names=[*kept, "scores", "letters"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"] + ["scores array<long>", "letters long"])
    return rows.mapInArrow(score, schema)


def array_of(size: int, value) -> Column:
    return F.array(*[value(k) for k in range(size)])


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def mixture(counts: Column, prior: Column, weight: float) -> Column:
    """Shares of ``counts`` (millionths), drawn to ``prior`` as by ``weight`` more observations."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(F.zip_with(counts, prior, lambda c, p: c / F.lit(float(MICRO)) + F.lit(weight) * p), lambda x: x / (total / F.lit(float(MICRO)) + weight))


def summed(size: int, name: str = "soft") -> Column:
    return array_of(size, lambda k: F.coalesce(F.sum(F.get(name, F.lit(k))), F.lit(0).cast("long"))).alias(name)


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
DECLARED = r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b"


def host_of(url: Column) -> Column:
    """Lower-case host of an address without a leading ``www.``; empty where there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))), r"^www\.", "")


def identify(rows: DataFrame, model: TextModel, markup: bool = False) -> DataFrame:
    """``rows`` (text, declared, host and any keys) with ``text`` replaced by language, confidence, text_language and letters.

    log posterior = tempered text likelihood + log P(declared | language)
    + log P(address suffix | language) + log prior of the host.  The tables and priors come
    from grouped sums of the text posteriors of all rows: a host is smoothed by its
    domain (last two labels), a domain by all rows, and a row's own share is left out of its
    host's counts.  Sums are whole millionths, so reruns agree.

    A null or empty text, or one without letters, has no text evidence and is ``und``; nulls
    among the other columns are evidence of their own kind (none); repeated rows are rows of
    their own; an empty table gives no rows; ties go to the language first by name.
    """
    taken = {"scores", "letters", "soft", "language", "confidence", "text_language", "_host", "_declared"}
    rows = rows.select(*[c for c in rows.columns if c not in taken])
    languages, size = [*model.languages, UNDETERMINED], len(model.languages) + 1
    keys = [c for c in rows.columns if c not in ("text", "declared", "host")]
    rows = rows.withColumn("_host", F.coalesce(F.col("host").cast("string"), F.lit(""))).withColumn("_declared", F.lower(F.coalesce(F.col("declared").cast("string"), F.lit("")))).drop("host", "declared")
    flat = array_of(size, lambda k: F.log(F.lit(UNDETERMINED_PRIOR if k == size - 1 else (1 - UNDETERMINED_PRIOR) / max(1, size - 1))))
    logs = F.zip_with("scores", flat, lambda x, p: x / F.lit(float(MICRO)) + p)
    soft = F.transform(softmax(logs), lambda p: F.round(p * MICRO).cast("long"))
    soft = F.when(F.col("letters") > 0, soft).otherwise(array_of(size, lambda k: F.lit(0).cast("long")))
    scored = materialise(text_scores(rows, model, markup).withColumn("soft", soft), "language-scores")

    by_host = scored.groupBy("_host").agg(summed(size))
    domain = F.array_join(F.slice(F.split("_host", r"\."), -2, 2), ".")
    domain = F.when(F.size(F.split("_host", r"\.")) >= 2, domain).otherwise(F.col("_host"))
    by_host = materialise(by_host.withColumn("_domain", domain).withColumn("_suffix", F.element_at(F.split("_host", r"\."), -1)), "language-hosts")
    overall = by_host.agg(summed(size)).first().soft
    even = array_of(size, lambda k: F.lit(UNDETERMINED_PRIOR if k == size - 1 else (1 - UNDETERMINED_PRIOR) / max(1, size - 1)))
    all_rows = F.array(*[F.lit(int(x)) for x in overall]).cast("array<long>")
    base = mixture(all_rows, even, 10.0)
    by_domain = by_host.groupBy("_domain").agg(summed(size)).select("_domain", mixture(F.col("soft"), base, DOMAIN_WEIGHT).alias("domain_prior"))

    def table_of(counted: DataFrame, name: str) -> DataFrame:
        """log P(value | language) for each value of column ``name``: its share of the language's rows, drawn to its share of all rows."""
        everything = float(sum(overall)) or 1.0
        total = F.aggregate("soft", F.lit(0.0), lambda s, x: s + x)
        share = (total + 1.0) / F.lit(everything + 1.0)
        value = F.zip_with("soft", all_rows, lambda c, n: F.log((c + F.lit(TABLE_WEIGHT * MICRO) * share) / (n + F.lit(TABLE_WEIGHT * MICRO))))
        none = array_of(size, lambda k: F.lit(0.0))
        return counted.select(name, F.when(F.col(name) == "", none).otherwise(value).alias(f"{name}_log"))

    suffixes = table_of(by_host.groupBy("_suffix").agg(summed(size)), "_suffix")
    declared = materialise(table_of(scored.groupBy("_declared").agg(summed(size)), "_declared"), "language-declared")
    hosts = by_host.join(by_domain, "_domain").join(suffixes, "_suffix")
    hosts = materialise(hosts.select("_host", F.col("soft").alias("host_soft"), "domain_prior", "_suffix_log"), "language-priors")

    joined = scored.join(hosts, "_host").join(declared, "_declared")
    others = F.zip_with("host_soft", "soft", lambda h, s: h - s)
    prior = mixture(others, F.col("domain_prior"), HOST_WEIGHT)
    fused = F.zip_with(F.zip_with("scores", prior, lambda x, p: x / F.lit(float(MICRO)) + F.log(p)), F.zip_with("_declared_log", "_suffix_log", lambda x, y: x + y), lambda x, y: x + y)
    names = F.array(*[F.lit(x) for x in languages])
    first = lambda values: F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))
    joined = joined.withColumn("_post", softmax(fused)).withColumn("_text", first(F.col("soft")))
    silent = F.col("letters") == 0
    return joined.select(
        *keys,
        F.when(silent, F.lit(UNDETERMINED)).otherwise(first(F.col("_post"))).alias("language"),
        F.when(silent, F.lit(0.0)).otherwise(F.floor(F.array_max("_post") * 1e6 + 0.5) / 1e6).alias("confidence"),
        F.when(silent, F.lit(UNDETERMINED)).otherwise(F.col("_text")).alias("text_language"),
        "letters",
    )


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, language, confidence, text_language and letters of ``pages`` (page_id, url, html)."""
    html, url = F.col("html").cast("string"), F.col("url").cast("string")
    rows = pages.select("page_id", html.alias("text"), F.regexp_extract(html, DECLARED, 1).alias("declared"), host_of(url).alias("host"))
    return identify(rows, model, markup=True)


def keep_identified(docs: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang, source) in a language of the model, or in one of ``languages``.

    ``lang`` is the declared language and ``source`` the host.  Rows that are ``und`` go: those
    without letters and those whose writing is unlike every language of the labelled rows.
    With no labelled row nothing can be told and all rows stay.  Rows keep their columns.
    """
    model = fit(docs)
    if not model.languages:
        return docs
    mark = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").alias("_id"), mark.alias("_mark"), F.col("text").cast("string").alias("text"), F.col("lang").alias("declared"), F.col("source").alias("host"))
    told = identify(rows, model)
    refused = F.col("language") == UNDETERMINED
    if languages is not None:
        refused |= ~F.col("language").isin(*languages)
    gone = materialise(told.where(refused).select("_id", "_mark").distinct(), "language-refused")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (mark == gone["_mark"]), "left_anti")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every row of ``pages``, with a text model of the labelled ``documents``."""
    return identify_pages(table(spark, sf_dir, "pages"), fit(table(spark, sf_dir, "documents")))
