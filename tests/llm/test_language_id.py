from pyspark.sql import functions as F

import math
import random

from tests.llm.cases import clashing, docs
from tidemark.llm import language_id as L


def test_held_out_documents(spark, sf_dir):
    rows = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = L.fit(rows.where(~held), sample_rows=600)
    told = L.identify(rows.where(held).select("lang", "text", F.lit(None).cast("string").alias("declared"), F.lit("h").alias("host")), model)
    n, right = told.count(), told.where("language = lang").count()
    assert right >= 0.95 * n


def test_pages_agree_with_their_path(spark, sf_dir):
    model = L.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = L.identify_pages(pages, model).join(pages.select("page_id", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("want")), "page_id")
    assert got.count() == pages.count() and got.where("language = want").count() >= 0.95 * got.count()


def test_evidence_decides_where_the_text_is_silent_about_it(spark):
    rows = docs(spark, [(k, t, lang, None, 1) for k, (t, lang) in enumerate([("the and of that with this", "en"), ("der die und das nicht mit", "de")] * 20)])
    model = L.fit(rows)
    seen = [(k, "the and of that with this", "en", "a.example.com") for k in range(10)] + [(k + 10, "der die und das nicht mit", "de", "b.example.de") for k in range(10)]
    seen += [(100, "o", "en", "a.example.com"), (101, "o", "de", "b.example.de"), (102, "o", "de", "new.example.de")]
    df = spark.createDataFrame(seen, "id long, text string, declared string, host string")
    got = {r.id: r.language for r in L.identify(df, model).collect()}
    assert got[100] == "en" and got[101] == got[102] == "de" and got[0] == "en"


def test_rejects_what_has_no_language_and_keeps_the_rest(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs(spark, [(10**6 + k, t, None, "src0", 1) for k, t in enumerate(["", "12345 67890", None, "日本語の文章がここにあります。" * 20, "ⴰⵎⴰⵣⵉⵖ ⵜⴰⵎⴰⵣⵉⵖⵜ " * 20])])
    kept = L.keep_identified(known.unionByName(more))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not any(i >= 10**6 for i in ids) and len(ids) == known.count()


def test_awkward_rows(spark):
    kept = L.keep_identified(clashing(docs(spark)))
    assert kept.columns == clashing(docs(spark)).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 2 and 4 not in ids and 5 not in ids and 7 in ids
    assert L.keep_identified(docs(spark, [])).collect() == []
    assert L.identify_pages(spark.createDataFrame([(None, None, None), (1, "no address", "<html lang=de><p>und"), (2, "http://x.example.com/", "")], "page_id long, url string, html string"), L.fit(docs(spark))).count() == 3


def test_rare_and_many_languages_have_columns(spark):
    words = lambda k: " ".join(chr(0x1200 + 40 * k + j) * 3 for j in range(12))
    common = [(k, f"the and of that with this {k}", "en", "a", 1) for k in range(3000)]
    rare = [(10_000 + k, words(1), "am", "b", 1) for k in range(2)]
    rows = docs(spark, common + rare)
    assert L.fit(rows, sample_rows=400).languages == ["am", "en"]
    many = docs(spark, common[:200] + [(20_000 + k, words(k % 90), f"l{k % 90:02}", "c", 1) for k in range(180)])
    model = L.fit(many)
    assert len(model.languages) == L.MOST_LANGUAGES + 1 and L.POOLED in model.languages and "en" in model.languages
    assert len(model.table[0]) == len(model.languages) + 1 and model.score(words(89).encode())[model.languages.index(L.POOLED)] > model.score(words(89).encode())[-1]


def test_rare_language_stays(spark, monkeypatch):
    text = " ".join(chr(0x1200 + j) * 4 for j in range(30)) + " "
    rows = docs(spark, [(k, "the and of that with this and all of it " * 4, "en", "a", 1) for k in range(6000)] + [(9_000 + k, text * 4, "am", "b", 1) for k in range(2)])
    monkeypatch.setattr(L, "SAMPLE_ROWS", 100)
    assert L.keep_identified(rows).where("lang = 'am'").count() == 2


def brute(rows, model):
    """(language, confidence) of each (text, declared, host) by plain loops over all rows."""
    languages = [*model.languages, L.UNDETERMINED]
    size, micro = len(languages), L.MICRO
    even = [(1 - L.UNDETERMINED_PRIOR) / max(1, size - 1)] * (size - 1) + [L.UNDETERMINED_PRIOR]
    mixed = lambda counts, prior, weight: [(c / micro + weight * p) / (sum(counts) / micro + weight) for c, p in zip(counts, prior, strict=True)]
    added = lambda many: [sum(x[k] for x in many) for k in range(size)]

    def softmax(logs):
        powers = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(powers) for x in powers]

    seen = []
    for text, declared, host in rows:
        letters = L.visible(text.encode() if text else None, False)
        scores = model.score(letters)
        soft = [math.floor(p * micro + 0.5) for p in softmax([x / micro + math.log(p) for x, p in zip(scores, even, strict=True)])] if letters else [0] * size
        seen.append((letters, scores, soft, (declared or "").lower(), host or ""))
    total = added([x[2] for x in seen])
    domain = lambda h: ".".join(h.split(".")[-2:])
    base = mixed(total, even, 10.0)

    def table(value, of):
        if value == "":
            return [0.0] * size
        own = added([x[2] for x in seen if of(x) == value])
        share, weight = (sum(own) + 1) / (sum(total) + 1), L.TABLE_WEIGHT * micro
        return [math.log((c + weight * share) / (n + weight)) for c, n in zip(own, total, strict=True)]

    out = []
    for letters, scores, soft, declared, host in seen:
        others = [a - b for a, b in zip(added([x[2] for x in seen if x[4] == host]), soft, strict=True)]
        prior = mixed(others, mixed(added([x[2] for x in seen if domain(x[4]) == domain(host)]), base, L.DOMAIN_WEIGHT), L.HOST_WEIGHT)
        by_declared, by_suffix = table(declared, lambda x: x[3]), table(host.split(".")[-1], lambda x: x[4].split(".")[-1])
        post = softmax([s / micro + math.log(p) + d + t for s, p, d, t in zip(scores, prior, by_declared, by_suffix, strict=True)])
        best = post.index(max(post))
        out.append((languages[best], max(post)) if letters else (L.UNDETERMINED, 0.0))
    return out


def test_fusion_matches_brute_force(spark, sf_dir):
    rng = random.Random(6)
    known = [(r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 40").limit(60).collect()]
    model = L.fit(spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(known)], "doc_id long, text string, lang string"))
    hosts = ["a.example.com", "b.example.com", "news.de", "de", "", None, "x.y.fr"]
    rows = [(rng.choice((t[: rng.randrange(1, 60)], t[rng.randrange(30) :], "", None, "12 345")), rng.choice((x, x, "EN", "zz", None, "")), rng.choice(hosts)) for t, x in known for _ in range(2)]
    rows += rows[:9]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, text string, declared string, host string").repartition(3)
    got = {r.k: (r.language, r.confidence) for r in L.identify(df, model).collect()}
    for k, (language, confidence) in enumerate(brute(rows, model)):
        assert got[k][0] == language and abs(got[k][1] - confidence) < 1e-4, (k, rows[k], got[k], language, confidence)
