"""Secret scan: candidate strings by pattern, false ones removed by a random forest trained on labelled findings."""

from __future__ import annotations

import base64
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table, whole_batches

TREES, DEPTH, SEED, THRESHOLD = 20, 7, 17, 0.5
#: At most so many labelled findings, those with the least hashes, fit the forest.
MOST_FINDINGS, MADE_FINDINGS = 20_000, 4_000
#: Words of the learned dictionary: the most frequent ones of all documents, of at least so many letters.
MOST_WORDS, LEAST_LETTERS = 20_000, 4
NEIGHBOURS = 3
# Words that name a secret before it, and words of placeholders and of other long strings.
NAMING = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "credentials", "private_key", "client_secret", "bearer")
ORDINARY = ("example", "sample", "test", "dummy", "your", "here", "change", "changeme", "placeholder", "redacted", "none", "null", "true", "false", "default", "value", "string", "password", "secret", "token", "key", "user", "name", "admin", "localhost", "http", "https", "www", "com", "org", "net", "html", "index", "image", "version", "update", "config", "settings", "service", "request", "response", "message", "document", "number", "letter", "this", "that", "with", "from", "have", "will", "long", "word", "file", "path", "data", "code", "list", "item", "page", "type")
DIGESTS = ("sha", "sha1", "sha256", "md5", "checksum", "commit", "hash", "etag", "digest", "uuid", "id", "rev", "revision", "integrity")
PATH_WORDS = ("test", "tests", "example", "examples", "sample", "doc", "docs", "fixture", "mock")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza")
CANDIDATE = re.compile(
    r"(?P<named>(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|credentials?|private_key|client_secret)[\"'\]]{0,2}[\x20\t]*(?:=>|:=|[=:])[\x20\t]*[\"']?(?P<value>[^\s\"']{6,}))"
    r"|(?P<prefixed>\b(?:" + "|".join(re.escape(p) for p in PREFIXES) + r")[A-Za-z0-9_-]{10,})"
    r"|(?P<plain>[A-Za-z0-9+/_=-]{16,})"
)
FEATURES = ("length", "digits", "uppers", "symbols", "class_changes", "entropy", "transitions", "dictionary", "hex", "named", "assigned", "quoted", "digest_before", "ordinary_near", "path_test", "prefixed", "uuid")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORD = re.compile(r"[\w-]+")


@dataclass(frozen=True)
class Lexicon:
    """Words that cover ordinary strings, the length of the longest, and the cost of each letter after each other one: rare pairs cost more."""

    words: frozenset[str]
    longest: int
    costs: np.ndarray

    def covered(self, low: str) -> int:
        """How many characters of ``low`` the words cover, taking the longest word at each place."""
        total = at = 0
        while at < len(low):
            size = next((n for n in range(min(self.longest, len(low) - at), 1, -1) if low[at : at + n] in self.words), 0) if "a" <= low[at] <= "z" else 0
            total += size
            at += size or 1
        return total


def lexicon_of(learned: Iterable[str]) -> Lexicon:
    """The lexicon of ``learned`` and the fixed words."""
    words = frozenset(ORDINARY + NAMING) | frozenset(learned)
    counts = np.ones((27, 27))
    for word in sorted(words):
        codes = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in f" {word} "]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return Lexicon(words, max(map(len, words)), -np.log2(counts / counts.sum(axis=1, keepdims=True)))


@lru_cache(1)
def fixed_lexicon() -> Lexicon:
    return lexicon_of(())


def learn_lexicon(docs: DataFrame, most: int = MOST_WORDS) -> Lexicon:
    """The lexicon of the ``most`` most frequent words of all ``docs`` (text), counted over their whole texts; words seen once don't count.

    Words are taken by classes of frequency, an eighth of an octave each, from the most
    frequent class on, and of the class in which ``most`` is reached the first ones in order of
    letters: so few rows reach the driver however many tasks counted them.

    Null and empty texts have no words, repeated rows count each; with no word seen twice, as in
    an empty table, the fixed words are the lexicon.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(f"\\b[a-z]{{{LEAST_LETTERS},20}}\\b"), 0)).alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word", F.floor(F.log2("n") * 8).cast("int").alias("frequency"))
    often = materialise(often, "words")
    whole, total, part = [], 0, None
    for r in sorted(often.groupBy("frequency").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.frequency):
        if total + r.n > most:
            part = r.frequency
            break
        total += r.n
        whole.append(r.frequency)
    learned = [r.word for r in often.where(F.col("frequency").isin(whole)).select("word").collect()] if whole else []
    if part is not None:
        learned += [r.word for r in often.where(F.col("frequency") == part).select("word").orderBy("word").limit(most - total).collect()]
    return lexicon_of(learned) if learned else fixed_lexicon()


def kind_of(c: str) -> int:
    return 0 if "0" <= c <= "9" else 1 if c.islower() else 2 if c.isupper() else 3


def words_in(text: str) -> tuple[list[int], list[int]]:
    """Where the words of a text start and end."""
    spans = [m.span() for m in WORD.finditer(text)]
    return [a for a, _ in spans], [b for _, b in spans]


def features(text: str, start: int, end: int, kind: str, path: str | None, lexicon: Lexicon | None = None, words: tuple[list[int], list[int]] | None = None) -> list[float]:
    """FEATURES of a candidate: its length and characters, their transitions, dictionary coverage, path and neighbouring words."""
    lexicon, (starts, ends) = lexicon or fixed_lexicon(), words or words_in(text)
    own = text[start:end]
    n = len(own)
    kinds = [kind_of(c) for c in own]
    share = lambda k: kinds.count(k) / n
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    counts = [own.count(c) for c in set(own)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    low = own.lower()
    codes = np.array([ord(c) - 96 if "a" <= c <= "z" else 0 for c in low])
    cost = float(lexicon.costs[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0
    last, first = bisect_right(ends, start), bisect_left(starts, end)
    before = [text[starts[k] : ends[k]].lower() for k in range(max(0, last - NEIGHBOURS), last)]
    after = [text[starts[k] : ends[k]].lower() for k in range(first, min(len(starts), first + NEIGHBOURS))]
    back = start
    while back and text[back - 1] in "\"' \t\r\n":
        back -= 1
    tail = set(re.split(r"[^a-z0-9]+", (path or "").lower()))
    return [
        math.log2(n + 1), share(0), share(2), share(3), changes, entropy, cost, lexicon.covered(low) / n, float(all(c in "0123456789abcdef" for c in low)),
        float(kind == "named" or any(w in NAMING for w in before)), float(back > 0 and text[back - 1] in "=:>"), float(text[start - 1 : start] in ('"', "'") if start else False),
        float(any(w in DIGESTS for w in before[-2:])), sum(w in ORDINARY for w in before + after) / (2 * NEIGHBOURS),
        float(bool(tail & set(PATH_WORDS))), float(own.startswith(PREFIXES)), float(UUID.fullmatch(own) is not None),
    ]


def candidates_in(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the candidates of a whole text, from left to right; a plain one has a digit or both cases."""
    for m in CANDIDATE.finditer(text):
        if m.lastgroup in ("named", "value") or m.group("named"):
            yield m.start("value"), m.end("value"), "named"
        elif m.group("prefixed"):
            yield m.start(), m.end(), "prefixed"
        else:
            own = m.group()
            if any(map(str.isdigit, own)) or not (own.islower() or own.isupper() or own[1:].islower()):
                yield m.start(), m.end(), "plain"


def find_candidates(docs: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """doc_id, start, end, kind, length and features of every candidate of ``docs`` (doc_id, text, path), in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon or fixed_lexicon())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_batches(batches, 16 << 20):
            out: list[list] = [[], [], [], [], []]
            ids, paths = batch.column("doc_id").to_pylist(), batch.column("path").to_pylist()
            for doc, text, path in zip(ids, batch.column("text").to_pylist(), paths, strict=True):
                found = list(candidates_in(text or ""))
                words = words_in(text) if found else None
                for start, end, kind in found:
                    for column, x in zip(out, (doc, start, end, kind, features(text, start, end, kind, path, shared.value, words)), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "start", "end", "kind", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("path").cast("string").alias("path"))
    return rows.mapInArrow(find, "doc_id long, start long, end long, kind string, features array<double>")


def made_finding(rng: random.Random) -> tuple[str, int, int, str, str, bool]:
    """A made-up finding (text, start, end, kind, path, secret): real formats with random values, or what is taken for one."""
    hexes, alnum, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    syllables = ("an", "ti", "on", "er", "st", "re", "ou", "le", "en", "th", "in", "de", "che", "ver", "mo", "la")
    word = lambda a, b: "".join(rng.choice(syllables) for _ in range(rng.randint(a, b)))
    prose = lambda: " ".join(word(1, 3) for _ in range(rng.randint(2, 6)))
    quote, sign = rng.choice(('"', "'", "")), rng.choice(("=", " = ", ": ", "     = ", " => ", " := "))
    name = rng.choice(("password", "token", "secret", "api_key", "pwd", "client_secret", "db_password", "API_KEY"))
    lead_in = rng.choice((f"{name}{sign}{quote}", f"{name}{sign}{quote}", f"{quote}{name}{quote}: {quote}", f'cfg["{name}"] = {quote}', f"{{'{name}': {quote}"))
    named = lambda value: (lead_in, value, quote)
    secret = rng.random() < 0.5
    if secret:
        lead, value, trail = rng.choice((
            lambda: ("", rng.choice(("AKIA", "ASIA")) + draw(upper, 16), ""),
            lambda: (rng.choice(("", "token ", "token = ")), "ghp_" + draw(alnum, 36), ""),
            lambda: ("", rng.choice(("xoxb-", "glpat-", "sk_live_")) + draw(alnum, rng.randint(18, 30)), ""),
            lambda: named(draw(hexes, rng.choice((16, 18, 20, 32, 40, 64)))),
            lambda: named(draw(alnum, rng.randint(12, 40))),
            lambda: named(draw(alnum + "!#$%&*+-", rng.randint(9, 24))),
            lambda: named(base64.b64encode(rng.randbytes(rng.randint(18, 48))).decode()),
        ))()
    else:
        lead, value, trail = rng.choice((
            lambda: (rng.choice(("id ", "uuid: ", "id=")), "-".join(draw(hexes, n) for n in (8, 4, 4, 4, 12)), ""),
            lambda: (rng.choice(("commit ", "sha256 ", "md5: ", "checksum ", "etag: ", "")), draw(hexes, rng.choice((32, 40, 64))), ""),
            lambda: named(rng.choice(("changeme", "your_token_here", "your-api-key", "example-password", "xxxxxxxxxxxx", "${SECRET_VALUE}", "<password>", "********", "os.environ", "REDACTED_VALUE", "placeholder"))),
            lambda: named(word(3, 6)),
            lambda: ("", "".join(word(2, 3).title() for _ in range(rng.randint(3, 5))), ""),
            lambda: ("", "_".join(word(2, 3) for _ in range(rng.randint(3, 5))) + str(rng.randint(1, 9)), ""),
            lambda: ("", "/".join(word(2, 3) for _ in range(rng.randint(3, 6))) + f"/{rng.randint(1, 2030)}", ""),
            lambda: ("", draw("0123456789", rng.randint(16, 20)), ""),
            lambda: ("", "=" * rng.randint(16, 60), "") if rng.random() < 0.3 else ("", word(2, 3) + "-" + word(2, 4) + f"-{rng.randint(1, 99)}-" + word(2, 3), ""),
        ))()
    head = f"{prose()} {lead}"
    whole = f"{head}{value}{trail} {prose()}"
    kind = next((k for a, b, k in candidates_in(whole) if (a, b) == (len(head), len(head) + len(value))), "plain")
    path = f"src{rng.randint(0, 30)}" if rng.random() < 0.7 else f"repo/{rng.choice(PATH_WORDS if not secret or rng.random() < 0.1 else ('app', 'lib', 'deploy'))}/{word(1, 3)}.py"
    return whole, len(head), len(head) + len(value), kind, path, secret


def made_findings(spark: SparkSession, n: int = MADE_FINDINGS, seed: int = SEED) -> DataFrame:
    """``n`` labelled findings (text, start, end, kind, path, secret) by a seeded rule."""
    rng = random.Random(seed)
    return spark.createDataFrame([made_finding(rng) for _ in range(n)], "text string, start long, end long, kind string, path string, secret boolean")


def train(findings: DataFrame, lexicon: Lexicon | None = None, most: int = MOST_FINDINGS) -> RandomForestClassificationModel | None:
    """A random forest on the features of ``findings`` (text, start, end, kind, path, secret), of at most ``most`` rows of them.

    Rows with a null text or label, or with places outside the text, are left out; repeated
    rows count each; other columns are not read.  Without a usable row there is no forest:
    the result is None, and `scan_secrets` then judges nothing.
    """
    shared = findings.sparkSession.sparkContext.broadcast(lexicon or fixed_lexicon())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            values = [features(r["text"], r["start"], r["end"], r["kind"], r["path"], shared.value) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), pa.array([float(r["secret"]) for r in rows], pa.float64())], names=["features", "label"])

    usable = findings.where("text is not null and secret is not null and start >= 0 and end > start and end <= length(text)")
    chosen = usable.orderBy(F.xxhash64("text", "start", "end"), "text", "start").limit(most)
    rows = materialise(chosen.select("text", "start", "end", "kind", "path", "secret").coalesce(1).mapInArrow(describe, "features array<double>, label double"), "findings")
    if rows.isEmpty():
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", featuresCol="vector")
    return forest.fit(rows.select(array_to_vector("features").alias("vector"), "label"))


def scan_secrets(docs: DataFrame, model: RandomForestClassificationModel | None, threshold: float = THRESHOLD, lexicon: Lexicon | None = None) -> DataFrame:
    """doc_id, start, end, kind, probability and secret for every candidate of every row of ``docs`` (doc_id, text, path).

    Places are code points of the whole text, the end exclusive; ``secret`` says that the
    forest's probability reaches ``threshold``.  ``lexicon`` must be the one of the training.
    Without a model both are null.  Null and empty texts have no candidates; a null path has no
    test words; null ids and repeated rows give their findings each; an empty table gives no
    rows; other columns are not read.
    """
    found = find_candidates(docs, lexicon)
    if model is None:
        return found.select("doc_id", "start", "end", "kind", F.lit(None).cast("double").alias("probability"), F.lit(None).cast("boolean").alias("secret"))
    scored = model.transform(found.withColumn("vector", array_to_vector("features")))
    probability = F.floor(F.coalesce(F.get(vector_to_array("probability"), 1), F.lit(0.0)) * 1e6 + 0.5) / 1e6
    return scored.select("doc_id", "start", "end", "kind", probability.alias("probability")).withColumn("secret", F.col("probability") >= threshold)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of the whole ``documents`` table, judged by a forest trained on made-up labelled findings."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.col("source"))
    lexicon = learn_lexicon(docs)
    return scan_secrets(docs, train(made_findings(spark), lexicon), lexicon=lexicon)
