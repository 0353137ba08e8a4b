"""Addresses, texts, dates and nested values of pages, documents, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, text, urls
from tidemark.functions.numbers import half_up
from tidemark.functions.rules import pattern_names
from tidemark.operators.joins import contained_entries, longest_contained
from tidemark.plans.base import query, table

KINDS = ((r"\.example\.com$", "first"), (r"^(m|blog)\.", "mirror"), (r"\.example\.net$", "second"))


@query("""WITH u AS (SELECT page_id, trim(url) AS url FROM pages),
p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM u),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains(['utm_source', 'ref', 'fbclid', 'gclid'], lower(split_part(x, '=', 1)))) AS kept FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in one form."""
    return table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("canonical"))


HOST_SQL = "regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#:]*)', 1)), '^www\\.', '')"


@query(f"""SELECT page_id, {HOST_SQL} AS host, CASE WHEN regexp_matches({HOST_SQL}, '\\.example\\.com$') THEN 'first' WHEN regexp_matches({HOST_SQL}, '^(m|blog)\\.') THEN 'mirror'
  WHEN regexp_matches({HOST_SQL}, '\\.example\\.net$') THEN 'second' ELSE 'unsupported' END AS kind,
  regexp_matches(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '^/?(index|main|home|default)?(\\.(html?|jsp|php|do|asp))?/?$') AS homepage,
  regexp_matches(url, '^https?://[^/]') AND NOT regexp_matches({HOST_SQL}, '^(localhost|10\\.|127\\.)') AS public FROM pages""")
def url_kind(spark: SparkSession, d: str) -> DataFrame:
    """The first kind whose pattern a host matches, and two more predicates."""
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.host(url).alias("host"), urls.kind_of(url, KINDS).alias("kind"), urls.homepage_like(url).alias("homepage"), urls.public_address(url).alias("public"))


@query(f"""SELECT {HOST_SQL} AS host, count(*) AS n, count(DISTINCT lower(regexp_replace(trim(url), '/+$', ''))) AS n_distinct, min(page_id) AS first_page FROM pages GROUP BY 1""")
def group_urls_by_host(spark: SparkSession, d: str) -> DataFrame:
    """Pages by host, and how many differ in more than case and closing slashes."""
    url = F.col("url")
    return table(spark, d, "pages").groupBy(urls.host(url).alias("host")).agg(F.count("*").alias("n"), F.count_distinct(urls.same_address_key(url)).alias("n_distinct"), F.min("page_id").alias("first_page"))


@query(f"""SELECT page_id, {HOST_SQL} AS origin, 'page::' || {HOST_SQL} AS seed_key, sha256(url) AS cache_key FROM pages""")
def host_origin_key(spark: SparkSession, d: str) -> DataFrame:
    """Origin, seed and cache keys of an address."""
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.origin_key(url).alias("origin"), F.concat_ws("::", F.lit("page"), urls.host(url)).alias("seed_key"), F.sha2(url, 256).alias("cache_key"))


@query("""WITH t AS (SELECT page_id, url || ' ' || upper(url) || ', see ' || url || '.' AS body FROM pages),
f AS (SELECT page_id, list_transform(regexp_extract_all(body, 'https?://[^\\s"''<>()]+'), lambda u: regexp_replace(u, '[.,;:!?\\]}]+$', '')) AS found FROM t)
SELECT page_id, array_to_string(list_filter(found, lambda u, i: list_position(list_transform(found, lambda v: lower(v)), lower(u)) = i), ' ') AS urls FROM f""")
def url_extract_all(spark: SparkSession, d: str) -> DataFrame:
    """Addresses inside a text, each once."""
    body = F.concat("url", F.lit(" "), F.upper("url"), F.lit(", see "), "url", F.lit("."))
    return table(spark, d, "pages").select("page_id", F.array_join(urls.extract_urls(body), " ").alias("urls"))


@query("""SELECT doc_id, nullif(substr(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), 1, 80), '') AS title FROM documents""")
def title_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """Titles with single spaces and a greatest length."""
    return table(spark, d, "documents").select("doc_id", text.sanitize_title(F.col("text"), 80).alias("title"))


WORDS = ("than", "thing", "nicht", "dans", "para", "the", "der", "ing")


@query(f"""WITH k(k) AS (VALUES {", ".join(f"('{w}')" for w in WORDS)})
SELECT doc_id, m.k AS matched FROM documents LEFT JOIN (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY length(k) DESC, k) AS r
  FROM documents JOIN k ON contains(lower(text), k)) m USING (doc_id) WHERE r = 1 OR r IS NULL""")
def keyword_contains_join(spark: SparkSession, d: str) -> DataFrame:
    """The longest entry of a small dictionary that a text contains."""
    entries = spark.createDataFrame([(k,) for k in WORDS], "key string")
    return longest_contained(table(spark, d, "documents").select("doc_id", "text"), "text", ["doc_id"], entries).select("doc_id", "matched")


@query("""WITH k AS (SELECT DISTINCT lower(p_name) AS k FROM part WHERE p_partkey <= 1000 UNION SELECT DISTINCT lower(o_orderpriority) FROM orders),
t AS (SELECT p_partkey, p_name || ' / ' || p_type AS t FROM part)
SELECT p_partkey, k AS matched FROM (SELECT p_partkey, k, row_number() OVER (PARTITION BY p_partkey ORDER BY length(k) DESC, k) AS r FROM t JOIN k ON contains(lower(t), k)) WHERE r = 1""")
def dictionary_contains_join(spark: SparkSession, d: str) -> DataFrame:
    """The longest entry of a dictionary of any size that a text contains, by shared pieces of text."""
    parts = table(spark, d, "part")
    entries = parts.where("p_partkey <= 1000").select(F.lower("p_name").alias("key")).union(table(spark, d, "orders").select(F.lower("o_orderpriority").alias("key"))).distinct()
    texts = parts.select("p_partkey", F.concat("p_name", F.lit(" / "), "p_type").alias("t"))
    found = contained_entries(texts, "t", ["p_partkey"], entries, "key")
    return found.groupBy("p_partkey").agg(F.min(F.struct((-F.length("_entry")).alias("n"), F.col("_entry").alias("e")))["e"].alias("matched"))


PATTERNS = {"email": r"[a-z0-9.]+@[a-z0-9.]+", "phone": r"\+[0-9]", "licence": r"(?i)licen[cs]ed? ", "secret": r"(password|token) ?=", "upper": r"[A-Z]{12}"}


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in PATTERNS.items()) + "], lambda x: x IS NOT NULL), ',') AS flags FROM documents")
def regex_category_flags(spark: SparkSession, d: str) -> DataFrame:
    """All categories whose pattern a text matches, in their order."""
    return table(spark, d, "documents").select("doc_id", F.array_join(pattern_names(F.col("text"), PATTERNS), ",").alias("flags"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(list_filter(s, lambda x: contains(lower(x), 'ing ') OR contains(lower(x), 'ung '))) AS hits,
  array_to_string(list_slice(list_filter(s, lambda x: contains(lower(x), 'ing ') OR contains(lower(x), 'ung ')), 1, 2), ' / ') AS first FROM s""")
def sentences_with_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that hold one of some words: how many, and the first two."""
    words = ("ing ", "ung ")
    found = text.sentences_with(F.col("text"), words, 1_000_000)
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("hits"), F.array_join(F.slice(found, 1, 2), " / ").alias("first"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE (props::JSON ->> 'k')::INTEGER = 7) AS n_seven, sum((props::JSON ->> 'k')::INTEGER)::BIGINT AS total FROM events
WHERE (props::JSON ->> 'k') <> '13' GROUP BY 1""")
def json_field_filter(spark: SparkSession, d: str) -> DataFrame:
    """Filter and sum by a field of a JSON text, read with its schema once."""
    k = F.from_json("props", "k int")["k"]
    rows = table(spark, d, "events").select("event_type", k.alias("k")).where("k <> 13")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("k") == 7).alias("n_seven"), F.sum("k").alias("total"))


@query("""SELECT event_type, ((ts + INTERVAL 9 HOURS)::DATE)::VARCHAR AS day, (((ts + INTERVAL 9 HOURS)::DATE)::TIMESTAMP - INTERVAL 9 HOURS) AS starts,
  (((ts + INTERVAL 9 HOURS)::DATE + 1)::TIMESTAMP - INTERVAL 9 HOURS) AS ends, count(*) AS n FROM events GROUP BY ALL""")
def date_bounds_kst(spark: SparkSession, d: str) -> DataFrame:
    """Events by local day, with the instants at which it begins and ends."""
    day = dates.local_date(F.col("ts").cast("timestamp"))
    rows = table(spark, d, "events").select("event_type", day.alias("day"))
    n = rows.groupBy("event_type", "day").agg(F.count("*").alias("n"))
    return n.select("event_type", F.col("day").cast("string").alias("day"), dates.day_start(F.col("day")).cast("timestamp_ntz").alias("starts"), dates.day_end(F.col("day")).cast("timestamp_ntz").alias("ends"), "n")


@query("""SELECT o_orderkey, floor(epoch_us(TIMESTAMP '2001-08-01 12:00:00' - o_orderdate) / 86400000000)::BIGINT AS days,
  floor(epoch_us(TIMESTAMP '2001-08-01 12:00:00' - o_orderdate) / 86400000000.0 * 100 + 0.5) / 100 AS age,
  o_orderdate < TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 60 DAYS AS stale FROM orders""")
def days_between(spark: SparkSession, d: str) -> DataFrame:
    """Whole and fractional days up to a given instant."""
    as_of, at = F.lit("2001-08-01 12:00:00").cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", dates.whole_days_between(at, as_of).alias("days"), half_up(dates.days_since(at, as_of), 2).alias("age"), dates.stale(at, as_of, 60 * 86400).alias("stale"))


@query("""WITH f AS (SELECT s_suppkey, (s_suppkey % 6)::INTEGER AS failures, CASE WHEN s_acctbal > 5000 THEN 1 WHEN s_acctbal > 0 THEN 3 ELSE 7 END AS base FROM supplier)
SELECT s_suppkey, least(14, base * CASE WHEN failures <= 0 THEN 1 WHEN failures = 1 THEN 2 WHEN failures = 2 THEN 3 ELSE 7 END)::INTEGER AS days,
  (DATE '2024-01-31' + least(14, base * CASE WHEN failures <= 0 THEN 1 WHEN failures = 1 THEN 2 WHEN failures = 2 THEN 3 ELSE 7 END)::INTEGER)::VARCHAR AS next_visit FROM f""")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When a site is visited next, by its class and failures in a row."""
    base = F.when(F.col("s_acctbal") > 5000, 1).when(F.col("s_acctbal") > 0, 3).otherwise(7)
    days = dates.backoff_days(base, F.col("s_suppkey") % 6).cast("int")
    return table(spark, d, "supplier").select("s_suppkey", days.alias("days"), F.date_add(F.lit("2024-01-31").cast("date"), days).cast("string").alias("next_visit"))


@query("""WITH t AS (SELECT o_orderkey, 'From ' || strftime(o_orderdate, '%Y.%m.%d') || ' to 2002-02-30, not 2003/13/01; (c) 1999' AS t FROM orders)
SELECT o_orderkey, least(replace(regexp_extract(t, '[0-9]{4}\\.[0-9]{2}\\.[0-9]{2}'), '.', '-'), '2002-02-30') AS first_day,
  greatest(replace(regexp_extract(t, '[0-9]{4}\\.[0-9]{2}\\.[0-9]{2}'), '.', '-'), '2002-02-30') AS last_day,
  array_to_string(list_sort(list_distinct([regexp_extract(t, '[0-9]{4}'), '2002', '2003'])), ',') AS named,
  len(list_distinct([regexp_extract(t, '[0-9]{4}'), '2002', '2003']))::INTEGER AS n_years FROM t""")
def iso_day_extraction(spark: SparkSession, d: str) -> DataFrame:
    """First and last day that a text names, kept as strings whether or not the month has such a day, and its years without the copyright."""
    body = F.concat(F.lit("From "), F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit(" to 2002-02-30, not 2003/13/01; (c) 1999"))
    days, years = dates.first_and_last_day(body), dates.years_in(dates.without_copyright_years(body))
    return table(spark, d, "orders").select("o_orderkey", days["first_day"].alias("first_day"), days["last_day"].alias("last_day"), F.array_join(F.array_sort(years), ",").alias("named"), F.size(years).alias("n_years"))


@query("""WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'chars': length(text)} ORDER BY turn) AS turns FROM conversations GROUP BY 1)
SELECT conv_id, len(turns)::INTEGER AS n, len(list_filter(turns, lambda x: x.role = 'assistant'))::INTEGER AS n_answers, len(list_filter(turns, lambda x: x.chars > 1000)) > 0 AS any_long,
  len(list_filter(turns, lambda x: x.chars <= 20)) = 0 AS all_long, array_to_string(list_transform(turns, lambda x: x.role), '>') AS roles, list_sum(list_transform(turns, lambda x: x.chars))::BIGINT AS chars FROM c""")
def array_explode_turns(spark: SparkSession, d: str) -> DataFrame:
    """Nested turns: filters, any, every, joins and sums over arrays."""
    turn = F.struct("turn", "role", F.length("text").alias("chars"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return c.select(
        "conv_id", F.size("turns").alias("n"), F.size(F.filter("turns", lambda x: x["role"] == "assistant")).alias("n_answers"),
        F.exists("turns", lambda x: x["chars"] > 1000).alias("any_long"), F.forall("turns", lambda x: x["chars"] > 20).alias("all_long"),
        F.array_join(F.transform("turns", lambda x: x["role"]), ">").alias("roles"), F.aggregate("turns", F.lit(0).cast("long"), lambda s, x: s + x["chars"]).alias("chars"),
    )


@query("""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), '') AS title,
  len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']+)["'']'))::INTEGER AS n_links,
  array_to_string(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1), ' ') AS links FROM pages""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Title and link targets of every page."""
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", text.page_title(html).alias("title"), F.size(text.links(html)).alias("n_links"), F.array_join(text.links(html), " ").alias("links"))


@query()
def html_visible_text(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of a page sees, and what stands around its first link word."""
    shown = text.visible_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(shown).alias("chars"), F.sha2(shown, 256).alias("text_sha256"), text.around(shown, " the ", 20, 20).alias("context"))


@query()
def nfkc_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Names as keys for comparison: compatibility form, no legal form, letters and digits alone."""
    name = F.concat(F.lit("㈜ "), F.col("c_name"), F.lit(" (Ｃｏ)"))
    keys = text.long_keys(F.array(text.name_key(name), F.lower("c_mktsegment")))
    return table(spark, d, "customer").select("c_custkey", text.name_key(name).alias("key"), F.array_join(keys, ",").alias("keys"), F.array_join(text.aliases_in_brackets(F.lit("A (one) (two) (one)")), ",").alias("aliases"))


@query("""SELECT doc_id, array_to_string(list_slice(list_filter([CASE WHEN regexp_matches(text, 'password') THEN 'secret' END, CASE WHEN regexp_matches(source, '^src1') THEN 'first sources' END,
  CASE WHEN regexp_matches(lang, 'de|fr') THEN 'continental' END, CASE WHEN regexp_matches(text, '@') THEN 'mail' END], lambda x: x IS NOT NULL), 1, 3), ',') AS badges FROM documents""")
def issue_badges(spark: SparkSession, d: str) -> DataFrame:
    """Up to three labels by patterns over several texts."""
    # Each hint looks at the field it is meant for, so that a text can't stand in for a source.
    rows = table(spark, d, "documents")
    found = F.array_compact(F.array(
        F.when(F.col("text").rlike("password"), "secret"), F.when(F.col("source").rlike("^src1"), "first sources"),
        F.when(F.col("lang").rlike("de|fr"), "continental"), F.when(F.col("text").rlike("@"), "mail"),
    ))
    return rows.select("doc_id", F.array_join(F.slice(found, 1, 3), ",").alias("badges"))
