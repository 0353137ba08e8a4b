"""Rules on addresses, questions, duties, outcomes and dates over the given tables: inputs are read from columns, the SQL decides anew.

Inputs are written once, as SQL that both engines read; what the rules make of them is column
expressions here and chains of conditions there.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, forms, text, urls
from tidemark.operators import cases as case_rules
from tidemark.operators import collecting, diagnosis, freshness, notices, obligations, outcomes, quality, questions
from tidemark.plans.base import query, spread, table


def chosen(column: str, values: Mapping[str, str | None], default: str | None = None) -> str:
    """SQL for the value that a column's content stands for."""
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in values.items()) + f" ELSE {quoted(default)} END"


def given(spark: SparkSession, d: str, name: str, key: str, inputs: Mapping[str, str]) -> DataFrame:
    return table(spark, d, name).select(F.expr(key).alias("id"), *[F.expr(sql).alias(c) for c, sql in inputs.items()])


def given_sql(name: str, key: str, inputs: Mapping[str, str]) -> str:
    return f"SELECT {key} AS id, " + ", ".join(f"{sql} AS {c}" for c, sql in inputs.items()) + f" FROM {name}"


def listed(conditions: Mapping[str, str], engine: str) -> str:
    """SQL for the names whose condition holds, as an array of either engine."""
    each = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in conditions.items())
    return f"array_compact(array({each}))" if engine == "spark" else f"list_filter([{each}], lambda x: x IS NOT NULL)"


def strings(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# --- addresses -----------------------------------------------------------------------------------------------------

TLD, PREFIX, LANG, NUMBER = (f"regexp_extract(url, '{p}', 1)" for p in ("[.](com|net|org)", "://([a-z]+)[.]", "[a-z]/([a-z]+)/", "/([0-9]+)"))
WAYS = {
    "com": f"'Docs.Google.com' || CASE {LANG} WHEN 'en' THEN '/forms/d/e/f' || {NUMBER} || '/viewform' WHEN 'fr' THEN '/forms/d/f' || {NUMBER} || '/edit' WHEN 'de' THEN '/forms/d/e/f' || {NUMBER} || '/formResponse' ELSE '/document/d/f' || {NUMBER} END",
    "net": f"CASE {PREFIX} WHEN 'm' THEN 'answer.moaform.com' || CASE {LANG} WHEN 'en' THEN '/answers/a' || {NUMBER} || '/start' ELSE '/answers/answers' END WHEN 'blog' THEN 'help.moaform.com/q/x' "
    f"ELSE 'www.moaform.com' || CASE {LANG} WHEN 'en' THEN '/q/q' || {NUMBER} WHEN 'de' THEN '/s/s' || {NUMBER} WHEN 'fr' THEN '/survey/404' ELSE '/pricing' END END",
    "org": f"CASE {PREFIX} WHEN 'm' THEN 'forms.gle/' || {NUMBER} WHEN 'blog' THEN 'form.naver.com' || CASE {LANG} WHEN 'en' THEN '/response/r_' || {NUMBER} ELSE '/forms/r_' || {NUMBER} END ELSE 'surveyl.ink/' || CASE {LANG} WHEN 'es' THEN 'a/b' ELSE {NUMBER} END END",
}
ADDRESS = "regexp_extract(url, '^([a-z]+://)', 1) || CASE " + " ".join(f"WHEN {TLD} = '{t}' THEN {w}" for t, w in WAYS.items()) + " END || regexp_extract(url, '(/?([?#].*)?)$', 1)"
ADDRESSES = {"url": ADDRESS, "tld": TLD, "prefix": PREFIX, "lang": LANG, "n": NUMBER}
ADDRESS_SQL = f"""a AS ({given_sql("pages", "page_id", ADDRESSES)}),
f AS (SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS way, list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda q: q <> '') AS q FROM a),
g AS (SELECT *, host = 'docs.google.com' AND contains(way, '/forms/') AS google, CASE WHEN host = 'docs.google.com' AND ends_with(way, '/viewform') THEN 'f' || n WHEN host = 'form.naver.com' AND starts_with(way, '/response/') THEN 'r_' || n WHEN host = 'answer.moaform.com' AND ends_with(way, '/start') THEN 'a' || n
  WHEN host = 'www.moaform.com' AND starts_with(way, '/q/') THEN 'q' || n WHEN host = 'www.moaform.com' AND starts_with(way, '/s/') THEN 's' || n WHEN host = 'surveyl.ink' AND way = '/' || n THEN n END AS form_id FROM f),
h AS (SELECT *, CASE WHEN form_id IS NULL THEN NULL WHEN google THEN 'google_forms' WHEN host = 'form.naver.com' THEN 'naver_form' ELSE 'moaform' END AS platform,
  CASE WHEN form_id IS NOT NULL THEN NULL WHEN host = 'forms.gle' THEN 'shortener' WHEN google AND ends_with(way, '/edit') THEN 'editor' WHEN google AND ends_with(way, '/formResponse') THEN 'submission' WHEN host = 'help.moaform.com' THEN 'no_form_host' ELSE 'no_form_path' END AS reason,
  CASE WHEN google THEN regexp_replace(way, '/(edit|viewform|formResponse)$', '') || '/viewform' ELSE way END AS new_way, CASE WHEN google OR (host = 'www.moaform.com' AND starts_with(way, '/q/')) THEN [] ELSE list_filter(q, lambda x: NOT starts_with(x, 'utm_') AND NOT starts_with(x, 'ref=')) END AS kept FROM g)"""


@query(f"""WITH {ADDRESS_SQL} SELECT id, form_id IS NOT NULL AS ok, platform, form_id, reason, CASE WHEN reason = 'shortener' THEN 'shortener' ELSE coalesce(platform, 'unsupported') END AS kind, host <> 'docs.google.com' OR google AS domain,
  scheme || '://' || host || new_way || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM h""")
def form_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Which form each page's address would belong to, or why none; its kind; and its canonical form."""
    rows = given(spark, d, "pages", "page_id", ADDRESSES).withColumn("told", forms.response_address(F.col("url")))
    return rows.select("id", "told.ok", "told.platform", "told.form_id", "told.reason", forms.address_kind(F.col("url")).alias("kind"), forms.form_domain(F.col("url")).alias("domain"), forms.canonical_address(F.col("url")).alias("canonical"))


@query(f"WITH {ADDRESS_SQL} SELECT id, row_number() OVER (ORDER BY CASE WHEN host = 'forms.gle' THEN 0 ELSE 1 END, id) AS place FROM h ORDER BY place LIMIT 20")
def shortened_first(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty addresses, shortened ones before others."""
    rows = given(spark, d, "pages", "page_id", ADDRESSES).withColumn("_first", forms.shorteners_first(F.col("url"))).orderBy("_first", "id").limit(20)
    return rows.select("id", F.row_number().over(Window.orderBy("_first", "id")).cast("long").alias("place"))


HOME = f"CASE {TLD} WHEN 'com' THEN 'https://www.' || regexp_extract(url, '://([^/?#]*)', 1) || '/' WHEN 'net' THEN 'https://m.therou.example.com' END"
PAGE = f"CASE WHEN {PREFIX} = 'm' AND {LANG} = 'fr' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/index.html' WHEN {PREFIX} = 'blog' AND {LANG} = 'de' THEN {ADDRESS} WHEN {LANG} = 'es' AND {TLD} = 'org' THEN NULL ELSE url END"
SOURCES = {"page": PAGE, "home": HOME}
SOURCE_SQL = f"""s AS ({given_sql("pages", "page_id", SOURCES)}), h AS (SELECT *, regexp_replace(lower(regexp_extract(page, '://([^/?#]*)', 1)), '^www[.]', '') AS host, regexp_replace(lower(regexp_extract(home, '://([^/?#]*)', 1)), '^www[.]', '') AS own FROM s),
r AS (SELECT *, page IS NOT NULL AND NOT regexp_matches(host, '^(docs[.]google[.]com|forms[.]gle|form[.]naver[.]com|(.*[.])?moaform[.]com|surveyl[.]ink)$') AND (home IS NULL OR host = own) AND NOT ends_with(page, '/index.html') AS real FROM h)"""


@query(f"WITH {SOURCE_SQL} SELECT id, CASE WHEN starts_with(host, 'docs.google') AND contains(page, '/document/') THEN home IS NULL OR host = own ELSE real END AS real, page IS NOT NULL AS public FROM r")
def source_pages(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page is a real source: on its institution's host, not its start page and no form platform; and whether its address may be fetched."""
    rows = given(spark, d, "pages", "page_id", SOURCES)
    return rows.select("id", collecting.real_source(F.col("page"), F.col("home")).alias("real"), urls.public_address(F.col("page")).alias("public"))


@query(f"WITH {SOURCE_SQL}, t AS (SELECT *, CASE WHEN starts_with(host, 'docs.google') AND contains(page, '/document/') THEN home IS NULL OR host = own ELSE real END AS ok FROM r) SELECT count(*) AS n, count(page) AS with_page, count(*) FILTER (WHERE ok) AS real_page FROM t")
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    """How many sources have a page, and a real one."""
    rows = given(spark, d, "pages", "page_id", SOURCES)
    return rows.agg(F.count("*").alias("n"), F.count("page").alias("with_page"), F.count_if(collecting.real_source(F.col("page"), F.col("home"))).alias("real_page"))


# --- questions -----------------------------------------------------------------------------------------------------

#: What the words of part names stand for, so that names ask for something.
ASKED = {"small": "이름", "red": "휴대전화", "blue": "성별", "new": "거주지", "cold": "건강 상태", "large": "주민등록번호", "hot": "이메일", "old": "종교"}
HOW = {"ring": "만족도", "bolt": "적어 주세요", "plate": "의견", "rod": "번호", "gear": "선호하는 프로그램", "gizmo": "그 밖", "anvil": "연령", "widget": "방문 목적"}
LABEL = f"{chosen("split_part(p_name, ' ', 1)", ASKED)} || ' ' || {chosen("split_part(p_name, ' ', 2)", HOW)}"
KIND = chosen("p_type", {"SMALL": "short_text", "LARGE": "long_text", "PROMO": "file"}, "radio")
QUESTIONS = {"label": LABEL, "kind": KIND, "personal": "p_size > 25"}
FOUND = {"name": "이름", "phone": r"휴대\s*전화", "email": "이메일", "gender": "성별", "age_range": "연령", "residence_area": "거주지", "sensitive_health": r"건강\s*상태", "sensitive_religion": "종교", "resident_registration_number": "주민등록번호"}
SAID = "CASE " + " ".join(f"WHEN regexp_matches(label, '{p}') THEN '{n}'" for n, p in questions.OPINIONS.items()) + f" WHEN regexp_matches(label, '{questions.EXCLUDED}') AND NOT asked THEN 'general_opinion' END"


@query(f"""WITH p AS ({given_sql("part", "p_partkey", QUESTIONS)}), c AS (SELECT *, regexp_matches(label, '{questions.SOLICITED}') AS asked, list_filter([{", ".join(f"CASE WHEN regexp_matches(label, '{p}') THEN '{n}' END" for n, p in FOUND.items())}], lambda x: x IS NOT NULL) AS f FROM p),
o AS (SELECT *, {SAID} AS opinion, regexp_matches(label, '{"|".join(questions.OPINIONS.values())}') AS says, asked OR list_has_any(f, ['name', 'phone', 'email', 'resident_registration_number']) AS direct FROM c),
g AS (SELECT *, CASE WHEN direct OR opinion IS NULL THEN f ELSE [opinion] END AS got FROM o)
SELECT id, array_to_string(got, ',') AS categories, CASE WHEN (regexp_matches(label, '{questions.EXCLUDED}') AND NOT asked) OR says THEN 'D1' WHEN list_contains(got, 'resident_registration_number') THEN 'D5' WHEN list_has_any(got, ['sensitive_health', 'sensitive_religion']) THEN 'D4' WHEN list_has_any(got, ['name', 'phone', 'email']) THEN 'D3'
  WHEN list_has_any(got, ['gender', 'age_range', 'residence_area']) THEN 'D2' WHEN len(got) > 0 THEN 'D1' WHEN asked THEN 'D3' WHEN kind IN ('long_text', 'short_text') AND NOT personal THEN 'D1' WHEN personal THEN 'D2' ELSE 'D1' END AS level FROM g""")
def question_categories(spark: SparkSession, d: str) -> DataFrame:
    """What questions made of part names ask for, and how much that risks."""
    rows = spread(given(spark, d, "part", "p_partkey", QUESTIONS))
    none = F.lit(None).cast("string")
    return rows.select("id", F.array_join(questions.detect_categories(F.col("label")), ",").alias("categories"), questions.full_question_level(F.col("label"), none, F.col("kind"), F.col("personal")).alias("level"))


# --- duties --------------------------------------------------------------------------------------------------------

WORDS = chosen("o_orderpriority", {"1-URGENT": "직원 조사", "2-HIGH": "경품 이벤트", "3-MEDIUM": "마케팅 안내", "4-NOT SPECIFIED": "민원 접수", "5-LOW": "관광 직원"})
LEVEL = "'D' || CAST(1 + CAST(floor(o_totalprice) AS BIGINT) % 5 AS VARCHAR(1))"
FORMS = {
    "text": f"{WORDS} || CASE WHEN o_orderstatus = 'P' THEN ' 학생' ELSE '' END", "public": "o_orderstatus = 'O'", "verified": "year(o_orderdate) = 1998", "level": LEVEL, "anonymous": "month(o_orderdate) < 4",
    "platform": "CASE WHEN o_totalprice > 350000 THEN 'google_forms' WHEN o_totalprice > 250000 THEN 'naver_form' WHEN o_totalprice > 200000 THEN 'wiseon_csap' WHEN o_totalprice > 150000 THEN 'self_hosted' ELSE 'other' END",
}


def _keys(keys) -> str:
    return "[" + ", ".join(f"'{k}'" for k in keys) + "]"


O = obligations  # noqa: E741


@query(f"""WITH f AS ({given_sql("orders", "o_orderkey", FORMS)}), t AS (SELECT *, CASE WHEN verified OR platform = 'wiseon_csap' THEN 'csap_verified' WHEN platform = 'google_forms' THEN 'overseas_saas' WHEN platform = 'naver_form' THEN 'domestic_saas' WHEN platform = 'self_hosted' THEN 'self_hosted' ELSE 'generic_limited' END AS tool,
  contains(text, '직원') AND NOT contains(text, '관광') AS employee FROM f),
g AS (SELECT *, {listed({"public_agency": "public", "event_prize": "contains(text, '경품')", "employee_survey": "employee", "marketing": "contains(text, '마케팅')", "complaint_report": "contains(text, '민원')", "child_possible": "contains(text, '학생')"}, "duckdb")} AS own FROM t),
h AS (SELECT *, CASE WHEN len(own) > 0 THEN own ELSE ['general_company'] END AS flags FROM g),
u AS (SELECT *, CASE WHEN level >= 'D2' THEN {_keys(O.PERSONAL)} ELSE [] END || CASE WHEN level >= 'D2' AND tool IN ('domestic_saas', 'overseas_saas') THEN {_keys(O.TRUSTEE)} ELSE [] END || CASE WHEN level >= 'D3' AND tool = 'overseas_saas' THEN {_keys(O.OVERSEAS)} WHEN level = 'D2' AND tool = 'overseas_saas' THEN ['overseas_transfer'] ELSE [] END
  || CASE WHEN level >= 'D4' THEN {_keys(O.SENSITIVE)} ELSE [] END || CASE WHEN employee THEN {_keys(O.EMPLOYEE)} WHEN anonymous THEN ['anonymity_standard'] ELSE [] END || CASE WHEN contains(text, '경품') THEN {_keys(O.PRIZE)} ELSE [] END || CASE WHEN contains(text, '마케팅') THEN {_keys(O.MARKETING)} ELSE [] END || CASE WHEN public THEN {_keys(O.PUBLIC)} ELSE [] END AS due FROM h)
SELECT id, array_to_string(flags, ',') AS flags, tool, array_to_string(list_filter(due, lambda x, i: list_position(due, x) = i), ',') AS duties FROM u""")
def form_duties(spark: SparkSession, d: str) -> DataFrame:
    """Context of a form, the level of its tool and the duties that follow."""
    rows = given(spark, d, "orders", "o_orderkey", FORMS)
    rows = rows.withColumn("flags", obligations.context_flags(F.col("text"), F.col("public"))).withColumn("tool", obligations.tool_level(F.col("platform"), F.col("verified")))
    due = obligations.duties(F.col("flags"), F.col("level"), F.col("tool"), F.col("anonymous"))
    return rows.select("id", F.array_join("flags", ",").alias("flags"), "tool", F.array_join(due, ",").alias("duties"))


GAPS = {
    "sensitive_consent": "month(o_orderdate) % 2 = 0", "retention_period": "o_orderpriority LIKE '1%'", "overseas_transfer": "o_orderstatus = 'F'", "trustee": "day(o_orderdate) > 20", "collection_items": "day(o_orderdate) < 4", "collection_purpose": "month(o_orderdate) = 7",
    "prize_destruction": "year(o_orderdate) > 1996", "public_csap_verification": "o_totalprice > 100000", "marketing_optional_consent": "o_totalprice < 300000",
}
MARKS = {"public_agency": "o_orderstatus <> 'P'", "employee_survey": "o_orderpriority LIKE '5%'", "event_prize": "o_orderpriority LIKE '2%'", "marketing": "o_orderpriority LIKE '3%'"}
HINTS = {
    "level": LEVEL, "tool": "CASE WHEN o_totalprice > 350000 THEN 'overseas_saas' WHEN o_totalprice > 200000 THEN 'domestic_saas' ELSE 'self_hosted' END", "score": "o_totalprice / 5000",
    "anonymous": "CASE WHEN month(o_orderdate) < 3 THEN TRUE WHEN month(o_orderdate) < 10 THEN FALSE END", "identifier": "day(o_orderdate) < 15", "quasi": "day(o_orderdate) > 5", "employee": "o_totalprice > 250000", "disclosed": "day(o_orderdate) = 25",
    "partial": "o_orderstatus = 'F'", "generic": "o_totalprice < 200000",
}
G = lambda n: f"list_contains(gaps, '{n}')"
DIRECT, PUBLIC, OUT, OVER = "level >= 'D3'", "list_contains(flags, 'public_agency')", "tool IN ('domestic_saas', 'overseas_saas')", "tool = 'overseas_saas'"
RULES = {
    "sensitive_no_consent": f"level >= 'D4' AND {G('sensitive_consent')}", "unique_identifier": "level = 'D5'", "public_external_sensitive": f"{PUBLIC} AND {OUT} AND level >= 'D4'", "public_google_overseas": f"{PUBLIC} AND {OVER} AND {DIRECT} AND {G('overseas_transfer')}",
    "employee_sensitive_identifiable": "list_contains(flags, 'employee_survey') AND employee AND quasi", "anonymous_contradiction": "coalesce(anonymous, FALSE) AND identifier", "no_retention": f"{DIRECT} AND {G('retention_period')}", "no_items": f"{DIRECT} AND {G('collection_items')}",
    "no_purpose": f"{DIRECT} AND {G('collection_purpose')}", "saas_no_trustee": f"{DIRECT} AND {OUT} AND {G('trustee')} AND NOT disclosed", "overseas_no_notice": f"{DIRECT} AND {OVER} AND {G('overseas_transfer')}",
    "event_no_destruction": f"list_contains(flags, 'event_prize') AND {DIRECT} AND {G('prize_destruction')}", "public_no_csap": f"{PUBLIC} AND {OUT} AND {DIRECT} AND {G('public_csap_verification')}", "marketing_no_consent": f"list_contains(flags, 'marketing') AND {G('marketing_optional_consent')}",
}
WORST = list(RULES)[:6]


@query(f"""WITH h AS ({given_sql("orders", "o_orderkey", HINTS | {"gaps": listed(GAPS, "duckdb"), "flags": listed(MARKS, "duckdb")})}), r AS (SELECT *, {listed(RULES, "duckdb")} AS ids, CASE WHEN score >= 80 THEN 'safe' WHEN score >= 60 THEN 'caution' WHEN score >= 40 THEN 'risk' ELSE 'high_risk' END AS by_score FROM h),
c AS (SELECT *, partial AND generic AND by_score IN ('risk', 'high_risk') AS capped FROM r)
SELECT id, array_to_string(ids, ',') AS rules, CASE WHEN list_has_any(ids, {_keys(WORST)}) THEN 'high_risk' WHEN len(ids) > 0 THEN 'risk' END AS grade, CASE WHEN capped THEN 'caution' ELSE by_score END AS final, CASE WHEN capped THEN greatest(score, 60.0) ELSE score END AS final_score FROM c""")
def grade_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Which of the fourteen rules hold for a form, the grade they ask for, and the cap of forms that were read in part."""
    rows = given(spark, d, "orders", "o_orderkey", HINTS | {"gaps": listed(GAPS, "spark"), "flags": listed(MARKS, "spark")})
    hints = {"claims_anonymous": F.col("anonymous"), "identifier_questions": F.col("identifier"), "quasi_questions": F.col("quasi"), "employee_sensitive": F.col("employee"), "trustee_disclosed": F.col("disclosed")}
    told = obligations.overrides(obligations.override_rules(F.col("level"), F.col("tool"), F.col("flags"), F.col("gaps"), hints))
    by_score = F.when(F.col("score") >= 80, "safe").when(F.col("score") >= 60, "caution").when(F.col("score") >= 40, "risk").otherwise("high_risk")
    rows = rows.withColumn("told", told).withColumn("capped", obligations.partial_cap(by_score, F.col("score"), F.col("partial"), F.col("generic")))
    return rows.select("id", F.array_join("told.ids", ",").alias("rules"), "told.grade", F.col("capped.grade").alias("final"), F.col("capped.score").alias("final_score"))


NOTICES = {
    "said": "substr(trim(split_part(text, '.', 1)), 1, 60)", "key": chosen("lang", {"en": "collection_purpose", "de": "retention_period", "fr": "sensitive_consent", "es": "overseas_transfer"}, "trustee"),
    "level": "CASE WHEN n_chars < 300 THEN 'D1' WHEN n_chars < 700 THEN 'D2' ELSE 'D3' END",
}


@query(f"""WITH n AS ({given_sql("documents", "doc_id", NOTICES)}), s AS (SELECT *, CASE WHEN said IS NULL OR length(said) < 8 THEN 'missing' WHEN NOT (contains(lower(said), 'the') OR contains(lower(said), 'que')) THEN 'unclear' ELSE 'present' END AS status FROM n)
SELECT id, status, CASE WHEN status = 'present' THEN 'info' WHEN key IN ('sensitive_consent', 'overseas_transfer') THEN CASE status WHEN 'missing' THEN 'critical' ELSE 'high' END WHEN level = 'D3' THEN CASE status WHEN 'missing' THEN 'high' ELSE 'medium' END
  WHEN level = 'D2' AND key <> 'trustee' THEN CASE status WHEN 'missing' THEN 'medium' ELSE 'low' END WHEN level = 'D2' THEN 'medium' WHEN status = 'missing' THEN 'medium' ELSE 'low' END AS severity FROM s""")
def notice_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first sentence of a text meets a duty, and how bad it is if not."""
    rows = given(spark, d, "documents", "doc_id", NOTICES).withColumn("status", obligations.notice_status(F.col("said"), ("the", "Que")))
    return rows.select("id", "status", obligations.gap_severity(F.col("key"), F.col("status"), F.col("level")).alias("severity"))


@query("""WITH b AS (SELECT doc_id AS id, coalesce(text, '') AS t, list_transform(string_split(text, '. '), lambda x: trim(x)) AS s FROM documents)
SELECT id, CASE WHEN len(list_filter(s, lambda x: regexp_matches(x, '(of|de)\\s+the'))) > 0 THEN 'FOUND_CONFIRMED' WHEN len(list_filter(s, lambda x: regexp_matches(x, 'ing|ung') AND length(x) >= 40)) > 0 THEN 'FOUND_POSSIBLE' WHEN regexp_matches(t, '(of|de)\\s+the') THEN 'FOUND_CONFIRMED' WHEN regexp_matches(t, 'ing|ung') THEN 'NEEDS_REVIEW' ELSE 'NOT_FOUND' END AS certainty FROM b""")
def notice_facts(spark: SparkSession, d: str) -> DataFrame:
    """How sure it is that a text tells something, from its sentences and the whole of it."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"), F.transform(F.split("text", r"\. "), lambda x: F.trim(x)).alias("blocks"))
    return rows.select("id", obligations.notice_fact(F.col("blocks"), F.col("t"), r"(of|de)\s+the", "ing|ung", 40).alias("certainty"))


NOTICED = {
    "purpose": chosen("o_orderpriority", {"1-URGENT": "수집 목적: 서비스 운영", "2-HIGH": "동의합니다.", "3-MEDIUM": "아무 말도 없는 긴 글", "4-NOT SPECIFIED": "짧다"}), "retention": "CASE WHEN day(o_orderdate) > 20 THEN '보유기간은 일 년입니다' WHEN day(o_orderdate) > 10 THEN '이 글은 다른 글입니다' END",
    "consent_text": "CASE WHEN month(o_orderdate) = 3 THEN '제출' END", "privacy_notice": "CASE WHEN month(o_orderdate) > 3 THEN '개인정보 처리 안내: 이름과 연락처' END", "overseas_transfer": "CASE WHEN o_totalprice > 400000 THEN '해외 보관: 미국 국가' END", "trustee": "CASE WHEN o_totalprice < 50000 THEN '위탁업무를 맡긴 수탁자' END",
    "privacy_policy_url": "CASE WHEN o_orderstatus = 'F' THEN 'http://x' WHEN o_orderstatus = 'O' THEN 'abc' END",
}
FORM = {
    "corpus": "CASE WHEN year(o_orderdate) = 1996 THEN '서비스 개선을 위한 만족도 조사' WHEN year(o_orderdate) = 1997 THEN '기간: 일 년' END", "has_consent": "o_orderpriority LIKE '5%'", "n_questions": "day(o_orderdate) % 3", "domestic_storage": "CASE WHEN day(o_orderdate) < 15 THEN TRUE END", "csap_verified": "month(o_orderdate) < 7",
    "trustee_disclosed": "day(o_orderdate) = 28", "fact": "CASE WHEN o_totalprice > 300000 THEN 'FOUND_CONFIRMED' WHEN o_totalprice > 250000 THEN 'FOUND_POSSIBLE' WHEN o_totalprice > 200000 THEN 'NEEDS_REVIEW' END",
}
WANTED = ("collection_purpose", "collection_items", "retention_period", "overseas_country", "trustee", "privacy_policy_link", "no_such_duty")
FULL = lambda f: f"(length(coalesce({f}, '')) >= 8 AND {f} NOT IN ('동의합니다.', '제출'))"
SAYS_IT = {"collection_purpose": "목적|경품 지급", "collection_items": "항목|성명|이름|휴대폰|연락처|이메일", "retention_period": "기간|보유|종료|목적 달성|경품 발송 완료", "trustee": "위탁|수탁자"}


@query(f"""WITH x AS ({given_sql("orders", "o_orderkey", NOTICED | FORM)}), e AS (SELECT x.*, unnest({_keys(WANTED)}) AS duty FROM x),
t AS (SELECT *, CASE duty WHEN 'collection_purpose' THEN coalesce(purpose, privacy_notice) WHEN 'collection_items' THEN privacy_notice WHEN 'retention_period' THEN retention WHEN 'overseas_country' THEN overseas_transfer WHEN 'trustee' THEN trustee WHEN 'privacy_policy_link' THEN privacy_policy_url END AS own FROM e),
w AS (SELECT *, CASE WHEN duty IN {strings(SAYS_IT)} THEN CASE WHEN {FULL("own")} THEN own || chr(10) || coalesce(corpus, '') WHEN {FULL("corpus")} THEN corpus ELSE own END ELSE own END AS txt FROM t),
b AS (SELECT *, CASE WHEN duty = 'no_such_duty' THEN 'missing' WHEN duty = 'privacy_policy_link' THEN CASE WHEN length(coalesce(txt, '')) < 5 THEN 'missing' WHEN contains(txt, 'http') THEN 'present' ELSE 'unclear' END WHEN NOT {FULL("txt")} THEN 'missing'
  WHEN CASE duty {" ".join(f"WHEN '{k}' THEN regexp_matches(txt, '{p}')" for k, p in SAYS_IT.items())} ELSE regexp_matches(txt, '국가|미국|해외') END THEN 'present' ELSE 'unclear' END AS s0, CASE WHEN duty IN ('collection_purpose', 'retention_period') THEN fact END AS f FROM w),
c AS (SELECT *, CASE WHEN f = 'FOUND_CONFIRMED' THEN 'present' WHEN (f = 'FOUND_POSSIBLE' AND s0 <> 'present') OR (f = 'NEEDS_REVIEW' AND s0 = 'missing') THEN 'unclear' ELSE s0 END AS s1 FROM b),
g AS (SELECT *, CASE WHEN consent_text IS NOT NULL AND privacy_notice IS NULL AND NOT has_consent AND duty IN ('collection_purpose', 'collection_items', 'retention_period') AND NOT coalesce(f IN ('FOUND_CONFIRMED', 'FOUND_POSSIBLE'), FALSE) THEN 'missing' ELSE s1 END AS s2 FROM c)
SELECT id, duty, CASE WHEN starts_with(duty, 'overseas_') AND coalesce(domestic_storage, FALSE) AND csap_verified THEN 'present' WHEN duty = 'trustee' AND trustee_disclosed THEN 'present' WHEN s2 = 'missing' AND ((duty = 'collection_purpose' AND coalesce(contains(corpus, '서비스 개선'), FALSE)) OR (duty = 'collection_items' AND n_questions > 0)) THEN 'unclear' ELSE s2 END AS status FROM g""")
def notice_statuses(spark: SparkSession, d: str) -> DataFrame:
    """How the notices of each form meet seven duties, one of them unknown."""
    rows = given(spark, d, "orders", "o_orderkey", NOTICED | FORM)
    told = F.map_from_arrays(F.array(*[F.lit(n) for n in NOTICED]), F.array(*[F.col(n) for n in NOTICED]))
    facts = F.map_from_arrays(F.array(F.lit("collection_purpose"), F.lit("retention_period")), F.array("fact", "fact"))
    ready = rows.select("*", told.alias("notices"), facts.alias("facts"), F.array(*[F.lit(x) for x in WANTED]).alias("duties"))
    return notices.evaluate_notices(ready, "id")


SIGNS = {"official": "CASE WHEN s_acctbal > 5000 THEN TRUE WHEN s_acctbal > 1000 THEN FALSE END", "access": "CASE WHEN s_nationkey > 16 THEN TRUE WHEN s_nationkey > 8 THEN FALSE END", "raw": "CASE WHEN s_name LIKE '%7%' THEN TRUE WHEN s_name LIKE '%3%' THEN FALSE END", "public": "s_nationkey % 2 = 0", "employee": "s_acctbal > 3000"}
SIGN = {n: f"CASE WHEN {n} THEN 'confirmed' WHEN NOT {n} THEN 'missing' ELSE 'unknown' END" for n in ("official", "access", "raw")}


@query(f"""WITH s AS ({given_sql("supplier", "s_suppkey", SIGNS)}), c AS (SELECT id, list_filter([CASE WHEN public THEN 'official:' || {SIGN["official"]} END, 'access:' || {SIGN["access"]}, CASE WHEN employee THEN 'raw:' || {SIGN["raw"]} END], lambda x: x IS NOT NULL) AS l FROM s)
SELECT id, array_to_string(l, ',') AS checks, floor(len(list_filter(l, lambda x: ends_with(x, 'missing'))) * 1.5 + len(list_filter(l, lambda x: ends_with(x, 'unknown'))) * 0.75 + 0.5)::DOUBLE AS deduction FROM c""")
def management_signs(spark: SparkSession, d: str) -> DataFrame:
    """Signs of good keeping that are confirmed, missing or unknown, those that apply alone, and what they cost."""
    told = obligations.management_checks({n: F.col(n) for n in SIGN}, {"official": F.col("public"), "raw": F.col("employee")})
    rows = given(spark, d, "supplier", "s_suppkey", SIGNS).withColumn("told", told)
    return rows.select("id", F.array_join(F.transform("told.checks", lambda x: F.concat_ws(":", x["name"], x["status"])), ",").alias("checks"), "told.deduction")


# --- outcomes ------------------------------------------------------------------------------------------------------

SCANS = {
    "reason": "CASE WHEN value < 10 THEN 'The survey is closed.' WHEN value < 20 THEN 'Login required to view' WHEN value < 30 THEN 'Questions could not be read (JavaScript)' WHEN value < 40 THEN 'unexpected exception, try again' WHEN value < 50 THEN 'request timeout' WHEN value < 60 THEN 'survey is closed, timed out' WHEN value < 70 THEN '' END",
    "scan": chosen("event_type", {"error": "failed", "click": "limited", "view": "completed", "signup": "pending", "purchase": "cancelled"}), "risk": "CASE WHEN props LIKE '%7%' THEN 'limited' ELSE 'low' END", "diagnosis": "CASE WHEN props LIKE '%4%' THEN 'limited' END",
}
SCAN_SQL = f"""s AS ({given_sql("events", "event_id", SCANS)}), w AS (SELECT *, coalesce(contains(reason, 'closed'), FALSE) AS closed, coalesce(contains(reason, 'Login'), FALSE) AS login, coalesce(contains(reason, 'JavaScript'), FALSE) AS unread, coalesce(regexp_matches(reason, 'try again|timeout|timed out'), FALSE) AS broke, coalesce(contains(reason, 'try again'), FALSE) AS again FROM s),
b AS (SELECT *, CASE WHEN (scan = 'failed' OR broke) AND closed AND NOT again THEN 'survey_closed' WHEN (scan = 'failed' OR broke) AND login THEN 'access_restricted' WHEN (scan = 'failed' OR broke) AND broke THEN 'system_failure' WHEN closed THEN 'survey_closed' WHEN login THEN 'access_restricted' WHEN unread THEN 'extraction_limited' WHEN broke THEN 'system_failure' ELSE 'extraction_limited' END AS why FROM w),
k AS (SELECT *, CASE WHEN risk = 'limited' OR coalesce(diagnosis = 'limited', FALSE) OR scan IN ('limited', 'failed') THEN why ELSE 'normal_diagnosis' END AS bucket, CASE WHEN scan IN ('limited', 'failed') THEN why ELSE 'normal_diagnosis' END AS own FROM b)"""


@query(f"""WITH {SCAN_SQL} SELECT id, bucket, CASE WHEN unread OR broke THEN NULL WHEN closed THEN 'closed' WHEN login THEN 'restricted' END AS feedback, CASE WHEN scan = 'pending' THEN 'queued' WHEN scan = 'completed' THEN 'completed' WHEN own = 'survey_closed' THEN 'skipped_closed' WHEN own = 'access_restricted' THEN 'skipped_restricted'
  WHEN own = 'system_failure' OR coalesce(regexp_matches(reason, 'timed? ?out'), FALSE) THEN 'timeout' WHEN scan = 'cancelled' THEN 'failed_final' WHEN scan = 'failed' THEN 'failed_retryable' ELSE 'limited' END AS link_status FROM k""")
def limited_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Why a diagnosis stayed limited, what that says about the link, and the status of the linkage."""
    rows, none = given(spark, d, "events", "event_id", SCANS), F.lit("")
    bucket = outcomes.limited_bucket(F.col("risk"), F.col("diagnosis"), none, F.col("scan"), F.col("reason"))
    from_scan = outcomes.limited_bucket(none, none, none, F.col("scan"), F.col("reason"))
    return rows.select("id", bucket.alias("bucket"), outcomes.link_feedback(F.col("reason")).alias("feedback"), outcomes.link_status(F.col("scan"), from_scan, F.col("reason")).alias("link_status"))


@query(f"WITH {SCAN_SQL} SELECT bucket, count(*) AS n FROM k GROUP BY 1")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many diagnoses ended in each bucket."""
    return limited_outcomes(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))


FEEDBACK = {"old": "CASE WHEN o_totalprice > 5000 THEN CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'active' WHEN 'P' THEN 'ignored' END END", "target": chosen("o_orderpriority", {"1-URGENT": "closed", "2-HIGH": "restricted", "3-MEDIUM": None, "4-NOT SPECIFIED": "active", "5-LOW": "invalid"}), "hours": "o_totalprice / 40000"}


@query(f"""WITH f AS ({given_sql("orders", "o_orderkey", FEEDBACK)}), w AS (SELECT *, CASE WHEN old IS NULL THEN 'no_link' WHEN target IS NULL THEN 'no_target' WHEN old = target THEN 'already_there' WHEN old = 'closed' AND target = 'restricted' THEN 'keeps_closed' WHEN old = 'ignored' THEN 'set_aside' WHEN hours < 6 THEN 'seen_recently' ELSE 'applied' END AS why FROM f)
SELECT id, why = 'applied' AS applied, why FROM w""")
def status_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Whether a diagnosis may change the status of a link, and why not."""
    rows = given(spark, d, "orders", "o_orderkey", FEEDBACK)
    why = outcomes.feedback_reason(F.col("old"), F.col("target"), F.col("hours"))
    return rows.select("id", (why == "applied").alias("applied"), why.alias("why"))


SAFETY = {
    "privacy": chosen("c_mktsegment", {"MACHINERY": "limited", "BUILDING": "direct_identifier", "AUTOMOBILE": "quasi_only", "HOUSEHOLD": "minimal", "FURNITURE": "sensitive_or_high_risk"}), "verdict": "CASE WHEN c_nationkey = 3 THEN 'DO_NOT_RESPOND' WHEN c_nationkey = 4 THEN 'RESPOND_WITH_CAUTION' ELSE 'OK' END",
    "subject": "CASE WHEN c_acctbal < 1000 THEN 'unknown' WHEN c_acctbal < 4000 THEN 'public_agency' ELSE 'private_company' END", "external": "c_nationkey > 9", "direct": "c_nationkey % 4", "sensitive": "CASE WHEN c_name LIKE '%1' THEN 1 ELSE 0 END", "high": "CASE WHEN c_name LIKE '%2' THEN 1 ELSE 0 END", "gaps": "c_nationkey % 5",
    "consent_missing": "c_name LIKE '%11'", "employee": "c_acctbal > 7000",
}


@query(f"""WITH s AS ({given_sql("customer", "c_custkey", SAFETY)}), b AS (SELECT *, privacy = 'direct_identifier' OR direct > 0 AS has, sensitive > 0 OR high > 0 AS risky FROM s)
SELECT id, CASE WHEN privacy = 'limited' THEN 'JUDGMENT_UNKNOWN' WHEN privacy = 'sensitive_or_high_risk' OR risky OR verdict = 'DO_NOT_RESPOND' OR (subject = 'unknown' AND has) OR (has AND subject = 'public_agency' AND external) THEN 'STOP_RESPONSE' WHEN subject = 'unknown' THEN 'SECURITY_CHECK' WHEN has THEN 'NOTICE_CHECK'
  WHEN privacy = 'quasi_only' OR verdict = 'RESPOND_WITH_CAUTION' THEN 'PII_CAUTION' ELSE 'SAFE_RESPOND' END AS safety,
  privacy NOT IN ('minimal', 'quasi_only', 'limited') AND ((risky AND gaps >= 3) OR (high > 0 AND external) OR (sensitive > 0 AND consent_missing) OR (subject = 'unknown' AND direct >= 2 AND (risky OR direct >= 3)) OR (subject = 'public_agency' AND (direct > 0 OR risky) AND external AND gaps >= 2) OR (employee AND direct > 0 AND gaps >= 2)) AS report FROM b""")
def safety_types(spark: SparkSession, d: str) -> DataFrame:
    """How safe it is to answer a form, and whether to report it."""
    rows, c = given(spark, d, "customer", "c_custkey", SAFETY), F.col
    safety = outcomes.safety_type(c("privacy"), c("verdict"), c("subject"), c("external"), c("direct"), c("sensitive"), c("high"))
    return rows.select("id", safety.alias("safety"), outcomes.report_advised(c("privacy"), c("subject"), c("external"), c("direct"), c("sensitive"), c("high"), c("gaps"), c("consent_missing"), c("employee")).alias("report"))


# --- days ----------------------------------------------------------------------------------------------------------

DAY = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))"
Y, M, D = (f"split_part({DAY}, '-', {k})" for k in (1, 2, 3))
PERIODS = {
    "said": f"CASE o_orderpriority WHEN '1-URGENT' THEN 'Posted: ' || {DAY} || ', survey' WHEN '2-HIGH' THEN '등록일 : ' || {Y} || '. ' || {M} || '. ' || {D} || ' 조사' WHEN '3-MEDIUM' THEN '작성일 ' || {D} || '/' || {M} || '/' || {Y} WHEN '4-NOT SPECIFIED' THEN '기간 ' || {Y} || '.' || {M} || '.' || {D} || ' ~ ' || {Y} || '.12.31' "
    f"ELSE 'open ' || {M} || '.' || {D} || '(월) ~ 12.' || {D} || ', Copyright 1990-1999' END || CASE o_orderstatus WHEN 'F' THEN ' 2002-01-02 ~ 2002-02-03' ELSE '' END",
    "day": DAY, "kind": "substr(o_orderpriority, 1, 1)", "more": "o_orderstatus = 'F'",
}


@query(f"""WITH p AS ({given_sql("orders", "o_orderkey", PERIODS)}), x AS (SELECT *, split_part(day, '-', 1) AS y, split_part(day, '-', 2) AS m, split_part(day, '-', 3) AS d FROM p)
SELECT id, CASE WHEN kind IN ('1', '2') THEN day WHEN kind = '3' AND more THEN '2002-01-02' WHEN kind = '3' THEN CASE WHEN d::INT <= 12 THEN y || '-' || d || '-' || m ELSE day END END AS posted,
  CASE WHEN kind = '4' THEN CASE WHEN more THEN least(day, '2002-01-02') ELSE day END WHEN more THEN '2002-01-02' WHEN kind = '5' THEN '2001-' || m || '-' || d END AS first_day,
  CASE WHEN kind = '4' THEN CASE WHEN more THEN greatest(y || '-12-31', '2002-02-03') ELSE y || '-12-31' END WHEN more THEN '2002-02-03' WHEN kind = '5' THEN '2001-12-' || d END AS last_day FROM x""")
def posted_days_and_periods(spark: SparkSession, d: str) -> DataFrame:
    """The day on which a text says it was posted, and the first and last day of the periods it names."""
    rows = given(spark, d, "orders", "o_orderkey", PERIODS).withColumn("p", dates.periods(F.col("said"), 2001))
    return rows.select("id", dates.posted_day(F.col("said")).alias("posted"), "p.first_day", "p.last_day")


LANES = {
    "status": chosen("p_type", {"MEDIUM": "active", "STANDARD": "Active", "LARGE": "discovered", "SMALL": "closed", "PROMO": None}, "odd"), "freshness": "CASE WHEN p_size < 8 THEN 'stale_candidate' WHEN p_size < 20 THEN 'active' WHEN p_size < 30 THEN 'active_candidate' ELSE 'unknown' END",
    "reason": chosen("split_part(p_name, ' ', 2)", {"ring": "recent_window", "bolt": "date_unknown_hold", "plate": "active_unknown_date", "rod": "published_recent", "gear": "active_candidate"}, "other"), "should": "p_brand NOT LIKE '%7'", "title": "CASE WHEN p_name LIKE 'old %' THEN 'My thesis: ' || p_name ELSE p_name END", "official": "p_retailprice > 950",
}


@query(f"""WITH x AS ({given_sql("part", "p_partkey", LANES)}), l AS (SELECT *, CASE WHEN starts_with(title, 'My thesis') THEN 'screened_out' WHEN freshness = 'stale_candidate' THEN 'stale_candidate' WHEN status = 'closed' THEN 'screened_out' WHEN status = 'discovered' THEN 'collect_candidate' WHEN status IS NULL THEN 'raw_discovered' WHEN lower(status) <> 'active' THEN 'collect_candidate'
  WHEN reason IN ('date_unknown_hold', 'active_unknown_date') THEN 'date_unknown_hold' WHEN NOT should THEN 'screened_out' WHEN freshness = 'active_candidate' OR reason = 'active_candidate' THEN 'active_candidate' WHEN reason IN ('recent_window', 'published_recent') OR freshness = 'active' THEN 'active_recent' ELSE 'collect_confirmed' END AS lane FROM x),
h AS (SELECT *, lane IN ('active_recent', 'active_candidate', 'collect_confirmed') AS sure FROM l)
SELECT id, lane, CASE WHEN lane = 'date_unknown_hold' THEN 'date_unknown' WHEN lane = 'stale_candidate' THEN 'stale' WHEN lane = 'screened_out' THEN 'screened' WHEN NOT sure THEN 'not_confirmed' END AS hold, sure AND should AND official AND NOT starts_with(title, 'My thesis') AS auto FROM h""")
def collect_lanes(spark: SparkSession, d: str) -> DataFrame:
    """The lane of a found form, why it is held back, and whether it is diagnosed without asking."""
    rows = given(spark, d, "part", "p_partkey", LANES)
    rows = rows.withColumn("lane", collecting.lane(F.col("status"), F.col("freshness"), F.col("reason"), F.col("should"), F.col("title")))
    return rows.select("id", "lane", collecting.hold_reason(F.col("lane")).alias("hold"), collecting.auto_target(F.col("lane"), F.col("should"), F.col("title"), F.col("official")).alias("auto"))


CONFIDENCE = {"posted": f"CASE WHEN o_orderpriority LIKE '1%' THEN {DAY} END", "start": f"CASE WHEN o_orderpriority LIKE '2%' THEN {DAY} END", "last": f"CASE WHEN o_totalprice > 400000 THEN {DAY} END", "deadline": f"CASE WHEN o_totalprice < 20000 THEN {DAY} END", "eligible": "o_orderstatus = 'O'", "unknown": "o_orderstatus = 'P'", "language": "day(o_orderdate) < 9", "cap": "CASE WHEN month(o_orderdate) > 6 THEN 'low' WHEN month(o_orderdate) > 3 THEN 'high' END"}


@query(f"""WITH x AS ({given_sql("orders", "o_orderkey", CONFIDENCE)}), t AS (SELECT *, posted IS NOT NULL OR last IS NOT NULL OR deadline IS NOT NULL AS dated FROM x)
SELECT id, CASE WHEN coalesce(cap = 'low', FALSE) THEN CASE WHEN dated THEN 'medium' WHEN unknown THEN 'none' ELSE 'low' END WHEN dated THEN 'high' WHEN eligible THEN 'medium' WHEN unknown THEN 'none' ELSE 'low' END AS confidence FROM t""")
def freshness_confidence(spark: SparkSession, d: str) -> DataFrame:
    """How sure the freshness of a form is, with the cap of its source page."""
    rows, c = given(spark, d, "orders", "o_orderkey", CONFIDENCE), F.col
    return rows.select("id", collecting.confidence(c("posted"), c("start"), c("last"), c("deadline"), c("eligible"), c("unknown"), c("language"), c("cap")).alias("confidence"))


# --- cases ---------------------------------------------------------------------------------------------------------

BADGES = {"수집 목적 고지 미흡": "c_mktsegment = 'MACHINERY'", "CSAP 확인": "c_nationkey < 4", "위탁 안내": "c_acctbal < 0", "국외이전": "c_name LIKE '%5'", "기타": "c_mktsegment = 'BUILDING'"}
OUTREACH = {
    "org": "CASE WHEN c_nationkey % 2 = 0 THEN 'public' WHEN c_nationkey < 20 THEN 'private' END", "personal": "c_acctbal > 2000", "sensitive": "c_name LIKE '%33'", "high": "CASE WHEN c_name LIKE '%44' THEN TRUE WHEN c_acctbal > 0 THEN FALSE END", "risk": "CASE WHEN c_acctbal > 8000 THEN 'High' WHEN c_acctbal > 100 THEN 'low' END",
    "report": "c_name LIKE '%77'", "evidence": "CASE WHEN c_nationkey > 3 THEN c_nationkey % 4 END", "capture": chosen("c_mktsegment", {"MACHINERY": "success", "BUILDING": "partial", "AUTOMOBILE": "Pending", "HOUSEHOLD": "running"}),
}
C = case_rules
HAS_GAP = "len(badges) > 0"


@query(f"""WITH x AS ({given_sql("customer", "c_custkey", OUTREACH | {"badges": listed(BADGES, "duckdb")})}), y AS (SELECT *, coalesce(risk = 'High', FALSE) AS severe, coalesce(high, FALSE) AS top, coalesce(org = 'public', FALSE) AS pub, coalesce(evidence, 0) AS n, lower(coalesce(capture, '')) AS state FROM x)
SELECT id, CASE WHEN report OR sensitive OR top OR (personal AND {HAS_GAP} AND ((pub AND n > 0) OR (NOT pub AND severe))) THEN 'A' WHEN personal THEN 'B' ELSE 'C' END AS priority,
  CASE WHEN state IN ('pending', 'running') THEN '{C.TO_DO}' WHEN n = 0 THEN '{C.FEW}' WHEN state = 'partial' THEN '{C.SOME}' WHEN state = 'success' OR n >= 2 THEN '{C.READY}' ELSE '{C.SOME}' END AS evidence,
  CASE WHEN top OR severe THEN '위반 소지' WHEN list_has_any(badges, ['CSAP 확인', '국외이전']) THEN '확인 필요' ELSE '개선 필요' END AS wording FROM y""")
def outreach_priorities(spark: SparkSession, d: str) -> DataFrame:
    """Whom to write to first, what evidence there is, and how to put it."""
    rows, c = given(spark, d, "customer", "c_custkey", OUTREACH | {"badges": listed(BADGES, "spark")}), F.col
    priority = case_rules.outreach_priority(c("org"), c("personal"), c("sensitive"), c("high"), c("risk"), c("report"), c("evidence"), c("badges"))
    return rows.select("id", priority.alias("priority"), case_rules.evidence_status(c("evidence"), c("capture")).alias("evidence"), case_rules.wording(c("high"), c("risk"), c("badges")).alias("wording"))


PUBLISHED = {"subject": "CASE WHEN c_nationkey < 8 THEN 'public' WHEN c_nationkey < 16 THEN 'private' ELSE 'other' END", "risk": "CASE WHEN c_acctbal > 7000 THEN 'critical' WHEN c_acctbal > 4000 THEN 'High' ELSE 'low' END"}
OPEN = {"gap": "c_name LIKE '%1'"}


@query(f"""WITH b AS ({given_sql("customer", "c_custkey", PUBLISHED | {"badges": listed(BADGES, "duckdb"), "gaps": listed(OPEN, "duckdb")})}), c AS (SELECT subject = 'public' AS pub, subject = 'private' AS priv, risk IN ('critical', 'High') AS sev, len(gaps) > 0 OR list_contains(badges, '수집 목적 고지 미흡') AS notice, list_has_any(badges, ['CSAP 확인', '위탁 안내']) AS tool FROM b)
SELECT 'all' AS name, count(*) AS n FROM c UNION ALL SELECT 'public', count(*) FILTER (WHERE pub) FROM c UNION ALL SELECT 'private', count(*) FILTER (WHERE priv) FROM c UNION ALL SELECT 'high-risk', count(*) FILTER (WHERE sev) FROM c UNION ALL SELECT 'notice-gap', count(*) FILTER (WHERE notice) FROM c UNION ALL SELECT 'external-tool', count(*) FILTER (WHERE tool) FROM c""")
def public_case_filters(spark: SparkSession, d: str) -> DataFrame:
    """How many public cases each filter of their list keeps, by patterns over arrays of badges."""
    rows, c = given(spark, d, "customer", "c_custkey", PUBLISHED | {"badges": listed(BADGES, "spark"), "gaps": listed(OPEN, "spark")}), F.col
    named = case_rules.public_filters(c("subject"), c("risk"), c("gaps"), c("badges"))
    counts = rows.agg(*[F.count_if(p).alias(n) for n, p in named.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("n")) for n in named])).alias("r")).select("r.*")


ISSUES = {
    "finding": "CASE l_linenumber WHEN 1 THEN 'personal_info_risk' WHEN 2 THEN 'notice_gap' WHEN 3 THEN 'limited_diagnosis' WHEN 4 THEN 'operator_unclear' WHEN 5 THEN 'Tool_Governance' WHEN 6 THEN 'high_risk_info' END",
    "domain": "CASE l_returnflag WHEN 'R' THEN CASE WHEN l_quantity > 40 THEN 'retention' WHEN l_quantity > 30 THEN 'overseas_transfer' WHEN l_quantity > 20 THEN 'sensitive_data' WHEN l_quantity > 10 THEN 'consent' ELSE 'public_sector' END WHEN 'A' THEN 'contact' END",
}


@query(f"""WITH x AS ({given_sql("lineitem", "l_orderkey", ISSUES)}), y AS (SELECT *, lower(coalesce(finding, 'other')) AS k, coalesce(domain, '') AS a FROM x),
z AS (SELECT id, CASE WHEN a = 'retention' THEN 'retention_gap' WHEN a = 'consent' THEN 'consent_gap' WHEN a = 'overseas_transfer' THEN 'overseas_check' WHEN a = 'public_sector' THEN 'public_cloud_check' WHEN k = 'tool_governance' THEN 'external_tool_check' WHEN k = 'operator_unclear' THEN 'operator_check' WHEN k = 'limited_diagnosis' THEN 'limited'
  WHEN a = 'sensitive_data' THEN 'sensitive_questions' WHEN k = 'high_risk_info' THEN 'high_risk_questions' WHEN k = 'personal_info_risk' THEN 'personal_questions' WHEN k = 'notice_gap' OR a = 'contact' THEN 'notice_gap' ELSE 'other' END AS label FROM y) SELECT id, label, count(*) AS n FROM z GROUP BY ALL""")
def public_issue_labels(spark: SparkSession, d: str) -> DataFrame:
    """The public labels of a case's findings, by twelve ordered rules, and how often each occurs."""
    rows = given(spark, d, "lineitem", "l_orderkey", ISSUES)
    return rows.groupBy("id", case_rules.issue_label(F.col("finding"), F.col("domain")).alias("label")).agg(F.count("*").alias("n"))


BUCKETS = {
    "code": chosen("split_part(p_name, ' ', 1)", {"small": "Name", "red": "satisfaction", "blue": "sensitive_health", "new": "gender", "cold": "zzz", "large": ""}), "label": chosen("split_part(p_name, ' ', 2)", {"ring": "휴대전화", "bolt": "의견", "plate": "생년월일", "rod": "연령", "gear": "종교"}),
    "item": chosen("p_type", {"MEDIUM": "수집 목적 안내", "STANDARD": "보유 및 이용기간", "LARGE": "수집 항목", "SMALL": "동의 거부권", "PROMO": "기타"}), "decision_id": chosen("p_brand", {"Brand#1": "JUDGMENT_UNKNOWN", "Brand#2": " STOP_RESPONSE ", "Brand#3": "x"}), "decision_label": chosen("p_brand", {"Brand#4": "문항 분석 불가", "Brand#5": "응답 주의", "Brand#6": "y", "Brand#7": " 응답 가능"}),
}


@query(f"""WITH x AS ({given_sql("part", "p_partkey", BUCKETS)}), y AS (SELECT *, lower(coalesce(code, '')) AS c, coalesce(label, '') AS l, trim(coalesce(decision_id, '')) AS d, trim(coalesce(decision_label, '')) AS e FROM x)
SELECT id, CASE WHEN c = 'name' OR l = '생년월일' THEN 'identity' WHEN l = '휴대전화' THEN 'contact' WHEN c = 'sensitive_health' OR l = '종교' THEN 'sensitive' WHEN c = 'gender' OR l = '연령' THEN 'demographic' WHEN c = 'satisfaction' THEN NULL ELSE 'other' END AS bucket,
  CASE WHEN d = 'JUDGMENT_UNKNOWN' OR e = '문항 분석 불가' THEN 'JUDGMENT_UNKNOWN' WHEN d = 'STOP_RESPONSE' THEN 'STOP_RESPONSE' WHEN e = '응답 주의' THEN 'PII_CAUTION' WHEN e = '응답 가능' THEN 'SAFE_RESPOND' ELSE 'OTHER' END AS decision,
  CASE WHEN contains(item, '목적') THEN 'purpose' WHEN contains(item, '항목') THEN 'items' WHEN contains(item, '보유') THEN 'retention' WHEN contains(item, '거부') THEN 'refusal' END AS notice_item FROM y""")
def label_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of data categories, decisions by id or alias, and notice items by their first pattern."""
    rows = given(spark, d, "part", "p_partkey", BUCKETS)
    return rows.select("id", case_rules.category_bucket(F.col("code"), F.col("label")).alias("bucket"), case_rules.decision(F.col("decision_id"), F.col("decision_label")).alias("decision"), case_rules.notice_item(F.col("item")).alias("notice_item"))


HEADS = {"small": "(주)", "red": "서울시", "blue": "부산시 ", "new": "재단법인 ", "cold": "Ab ", "large": "대전시 ", "hot": "㈜", "old": ""}
TAILS = {"ring": "한빛", "bolt": "연구소", "plate": "박물관 (별관)", "rod": "청", "gear": "문화회관 (주)", "gizmo": "도서관(작은 집)", "anvil": "값", "widget": "쌀 99"}
NAMES = {"name": f"{chosen("split_part(p_name, ' ', 1)", HEADS)} || {chosen("split_part(p_name, ' ', 2)", TAILS)}"}
LEGAL = text.LEGAL_FORMS
WHOLE = "regexp_replace(" * 2 + "replace(replace(replace(replace(replace(bare, '부산시', '부산광역시'), '대구시', '대구광역시'), '인천시', '인천광역시'), '대전시', '대전광역시'), '울산시', '울산광역시'), '서울시청', '서울특별시청', 'g'), '서울시', '서울특별시', 'g')"
PART = lambda names, at: "([" + ", ".join(f"'{x}'" for x in names) + f"])[{at} + 1]"
LETTER = f"CASE WHEN unicode(c) BETWEEN 44032 AND 55203 THEN {PART(text.ONSETS, '((unicode(c) - 44032) // 588)')} || {PART(text.VOWELS, '(((unicode(c) - 44032) % 588) // 28)')} || {PART(text.CODAS, '((unicode(c) - 44032) % 28)')} WHEN regexp_matches(c, '^[A-Za-z0-9]$') THEN lower(c) ELSE '' END"


@query(f"""WITH x AS ({given_sql("part", "p_partkey", NAMES)}), b AS (SELECT *, trim(regexp_replace(regexp_replace(name, '{LEGAL}', '', 'g'), '\\([^)]*\\)', '', 'g')) AS bare, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(name, '㈜', '(주)'), '{LEGAL}', '', 'g'), '\\([^)]*\\)', '', 'g')), '[^가-힣a-z0-9]+', '', 'g') AS k,
  list_filter(list_transform(regexp_extract_all(name, '\\(([^)]+)\\)', 1), lambda a: trim(a)), lambda a: a <> '주') AS inner_ FROM x),
w AS (SELECT *, {WHOLE} AS whole FROM b), v AS (SELECT *, list_filter([name, bare, whole] || inner_, lambda a: length(trim(a)) >= 2) AS every FROM w)
SELECT id, k AS key, array_to_string(list_filter(every, lambda a, i: list_position(every, a) = i), ',') AS aliases, array_to_string(list_transform(string_split(name, ''), lambda c: {LETTER}), '') AS latin FROM v""")
def institution_names(spark: SparkSession, d: str) -> DataFrame:
    """Keys of institution names made of part names, their aliases and their Latin letters."""
    rows = given(spark, d, "part", "p_partkey", NAMES)
    return rows.select("id", text.name_key(F.col("name")).alias("key"), F.array_join(text.name_aliases(F.col("name")), ",").alias("aliases"), text.romanized(F.col("name")).alias("latin"))


# --- freshness -----------------------------------------------------------------------------------------------------

FRESH = {
    "title": f"CASE {PREFIX} WHEN 'm' THEN 'Survey has ended' WHEN 'blog' THEN 'My thesis' ELSE 'Form' END || CASE WHEN {NUMBER} LIKE '%7' THEN ' of last year''s' WHEN {NUMBER} LIKE '%8' THEN ', now open' ELSE '' END", "snippet": f"CASE {LANG} WHEN 'fr' THEN CASE WHEN {NUMBER} LIKE '1%' THEN 'Sign in to continue' ELSE '' END "
    f"WHEN 'en' THEN CASE WHEN {NUMBER} LIKE '2%' THEN '2026.01.01 ~ 2026.01.20' WHEN {NUMBER} LIKE '3%' THEN '2026.05.01 ~ 2026.05.20' WHEN {NUMBER} LIKE '4%' THEN '2026.02.01 ~ 2026.04.20' ELSE '' END WHEN 'de' THEN CASE WHEN {NUMBER} LIKE '5%' THEN 'Results of 2023' WHEN {NUMBER} LIKE '6%' THEN 'In 2024' ELSE '' END ELSE '' END",
    "page_text": "''", "url": f"CASE WHEN {NUMBER} LIKE '%9' THEN 'https://x.kr/closedform' ELSE 'https://x.kr/a' END", "published_on": f"CASE WHEN {TLD} = 'net' THEN '2025-06-01' WHEN {TLD} = 'org' AND {LANG} <> 'en' THEN '2026-02-20' END",
}


@query(f"""WITH x AS ({given_sql("pages", "page_id", FRESH)}), r AS (SELECT *, CASE WHEN ends_with(url, 'closedform') THEN 'closed:closed_url' WHEN starts_with(title, 'Survey has ended') THEN 'closed:closed_phrase' WHEN starts_with(snippet, 'Sign in') THEN 'restricted:restricted_phrase' WHEN starts_with(title, 'My thesis') THEN 'ignored:personal_research' WHEN contains(title, 'last year') THEN 'stale:previous_year_phrase'
  WHEN ends_with(snippet, '01.20') THEN 'closed:end_date_passed' WHEN starts_with(snippet, '2026.05') THEN 'discovered:start_date_future' WHEN snippet = 'Results of 2023' THEN 'stale:stale_topic_year' WHEN snippet = 'In 2024' THEN 'stale:stale_year' WHEN published_on = '2025-06-01' AND NOT ends_with(snippet, '04.20') THEN 'stale:published_too_old' WHEN published_on = '2026-02-20' THEN 'discovered:published_recent'
  WHEN contains(title, 'now open') THEN 'discovered:in_progress_phrase' WHEN ends_with(snippet, '04.20') THEN 'discovered:recent_window' ELSE 'discovered:date_unknown_hold' END AS o FROM x) SELECT id, split_part(o, ':', 1) AS status, split_part(o, ':', 2) AS reason FROM r""")
def freshness_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a found form is still open on a given day, by ordered rules."""
    told = freshness.evaluate_freshness(given(spark, d, "pages", "page_id", FRESH), "2026-03-05")
    return told.select("id", "freshness.status", "freshness.reason")


TRIAGE = {
    "title": f"CASE {LANG} WHEN 'en' THEN 'City hall survey' WHEN 'fr' THEN 'Customer satisfaction' WHEN 'de' THEN 'My study' WHEN 'es' THEN 'University library' ELSE 'Please help' END || CASE WHEN {NUMBER} LIKE '%1' THEN ' 2020' WHEN {NUMBER} LIKE '%2' THEN ' 2026' WHEN {NUMBER} LIKE '%3' THEN ' 2025 closed' WHEN {NUMBER} LIKE '%4' THEN ' only takes a minute' ELSE '' END",
    "host": f"CASE WHEN {PREFIX} = 'm' THEN 'a.go.kr' WHEN {PREFIX} = 'blog' THEN NULL ELSE 'x.kr' END", "published_on": f"CASE {TLD} WHEN 'com' THEN '2026-02-20' WHEN 'net' THEN '2025-10-20' ELSE CASE WHEN {NUMBER} LIKE '5%' THEN '2024-01-01' END END", "by_date": f"{NUMBER} LIKE '6%'", "first_seen": f"{NUMBER} LIKE '%0'",
}


@query(f"""WITH x AS ({given_sql("pages", "page_id", TRIAGE)}), o AS (SELECT *, CASE WHEN starts_with(title, 'My study') THEN 'individual_or_academic:-40' WHEN coalesce(host, '') = 'a.go.kr' THEN 'public:50' WHEN starts_with(title, 'City hall') THEN 'public:35' WHEN starts_with(title, 'University') THEN 'university_official:30' WHEN (starts_with(title, 'Please help') OR contains(title, 'only takes')) AND NOT starts_with(title, 'Customer') THEN 'individual_or_academic:-25'
  WHEN starts_with(title, 'Customer') THEN 'company:28' ELSE 'unknown:0' END AS org, DATE '2026-03-05' - published_on::DATE AS age FROM x),
p AS (SELECT *, split_part(org, ':', 2)::INT AS strength, split_part(org, ':', 1) AS organization, CASE WHEN age <= 60 THEN 40 WHEN age <= 180 THEN 15 WHEN age > 365 THEN -25 ELSE 0 END + CASE WHEN by_date THEN 20 ELSE 0 END + CASE WHEN first_seen THEN 10 ELSE 0 END + CASE WHEN contains(title, '2026') THEN 15 WHEN contains(title, '2025') THEN -20 ELSE 0 END + CASE WHEN contains(title, '2020') THEN -25 ELSE 0 END + CASE WHEN contains(title, 'closed') THEN -15 ELSE 0 END AS s FROM o),
q AS (SELECT *, CASE WHEN s >= 35 THEN 'recent_high' WHEN s >= 15 THEN 'recent_possible' WHEN s <= -15 THEN 'likely_old' ELSE 'unknown' END AS recency FROM p)
SELECT id, organization, recency, CASE WHEN organization = 'individual_or_academic' OR (recency = 'likely_old' AND strength < 30) THEN 'C_ARCHIVE' WHEN organization IN ('public', 'company', 'university_official') AND strength >= 28 AND starts_with(recency, 'recent') THEN 'A_PRIORITY' WHEN organization = 'public' AND strength >= 45 THEN 'A_PRIORITY'
  WHEN organization = 'unknown' AND NOT starts_with(recency, 'recent') THEN 'C_ARCHIVE' ELSE 'B_PRIORITY' END AS queue FROM q""")
def triage_rules(spark: SparkSession, d: str) -> DataFrame:
    """Organization, recency and queue of a found form."""
    rows = given(spark, d, "pages", "page_id", TRIAGE).withColumn("source_title", F.lit("")).withColumn("description", F.lit(""))
    return freshness.triage(rows, "2026-03-05").select("id", "organization", "recency", "queue")


# --- scores --------------------------------------------------------------------------------------------------------

SCORED = {
    "tool_level": "CASE WHEN s_acctbal > 7500 THEN 'overseas_saas' WHEN s_acctbal > 5000 THEN 'domestic_saas' WHEN s_acctbal > 2500 THEN 'csap_verified' WHEN s_acctbal > 0 THEN 'self_hosted' ELSE 'generic_limited' END", "mitigated": "CASE WHEN s_nationkey > 15 THEN TRUE WHEN s_nationkey > 4 THEN FALSE END", "public_sector": "s_nationkey % 3 = 0", "partial": "s_nationkey % 4 = 1",
    "claims_anonymous": "s_nationkey % 5 = 2", "weighted_gaps": "CASE WHEN s_nationkey > 1 THEN s_nationkey % 3 END", "management_missing": "s_nationkey % 4", "management_unknown": "CASE WHEN s_nationkey > 2 THEN s_nationkey % 5 END",
}
LACKS = {"retention_period": "s_name LIKE '%1'", "public_csap_verification": "s_name LIKE '%2'", "collection_items": "s_name LIKE '%3'"}
SHORT = {"small": "이름", "red": "의견", "blue": "성별", "new": "거주지", "cold": "질병 여부", "large": "여권 번호", "hot": "이메일", "old": "나이"}
OF_LEVEL = {"D5": ("여권 번호",), "D4": ("질병 여부",), "D3": ("이름", "이메일"), "D2": ("성별", "거주지", "나이")}
LEVEL_OF = "CASE " + " ".join(f"WHEN label IN {strings(w) if len(w) > 1 else "('" + w[0] + "')"} THEN '{k}'" for k, w in OF_LEVEL.items()) + " ELSE 'D1' END"


@query(f"""WITH f AS ({given_sql("supplier", "s_suppkey", SCORED | {"gaps": listed(LACKS, "duckdb")})}), asked AS (SELECT l_suppkey AS id, {chosen("split_part(p_name, ' ', 1)", SHORT)} AS label FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 49 AND l_returnflag = 'R' AND l_linenumber = 1), m AS (SELECT id, max({LEVEL_OF}) AS level FROM asked GROUP BY 1),
j AS (SELECT f.*, coalesce(level, 'D0') AS level, coalesce(mitigated, FALSE) AS mit, coalesce(weighted_gaps, 0)::DOUBLE AS w, level IN ('D3', 'D4', 'D5') AS dd FROM f LEFT JOIN m USING (id)),
k AS (SELECT *, coalesce(dd, FALSE) AS direct, level = 'D2' AS quasi, CASE level WHEN 'D0' THEN 0 WHEN 'D1' THEN 3 WHEN 'D2' THEN 10 WHEN 'D3' THEN 20 WHEN 'D4' THEN 28 ELSE 35 END AS a, greatest(0, CASE tool_level WHEN 'csap_verified' THEN 0 WHEN 'self_hosted' THEN 3 WHEN 'domestic_saas' THEN 8 WHEN 'overseas_saas' THEN 18 ELSE 12 END - CASE WHEN mit THEN 8 ELSE 0 END) AS b FROM j),
n AS (SELECT *, CASE WHEN direct THEN 30.0 ELSE 18.0 END AS most, least(CASE WHEN quasi THEN 8.0 ELSE 15.0 END, 1.5 * management_missing + 0.75 * coalesce(management_unknown, 0)) AS g FROM k),
r AS (SELECT *, greatest(0.0, least(100.0, 100.0 - a - b - least(most, floor(w / greatest(len(gaps), w, 1.0) * most + 0.5)) - g)) AS raw FROM n),
q AS (SELECT *, CASE WHEN partial AND quasi AND NOT public_sector THEN greatest(raw, 60.0) ELSE raw END AS s1 FROM r), z AS (SELECT *, CASE WHEN quasi AND public_sector THEN greatest(70.0, least(80.0, s1)) WHEN quasi THEN least(s1, 75.0) ELSE s1 END AS score FROM q),
o AS (SELECT *, tool_level IN ('domestic_saas', 'overseas_saas') AS ext, {listed({"unique_identifier": "level = 'D5'", "public_external_sensitive": "public_sector AND ext AND level >= 'D4'", "anonymous_contradiction": "claims_anonymous AND direct", "no_retention": "direct AND list_contains(gaps, 'retention_period')", "no_items": "direct AND list_contains(gaps, 'collection_items')", "public_no_csap": "public_sector AND ext AND direct AND list_contains(gaps, 'public_csap_verification')"}, "duckdb")} AS ids FROM z),
v AS (SELECT *, greatest(CASE WHEN score >= 80 THEN 0 WHEN score >= 60 THEN 1 WHEN score >= 40 THEN 2 ELSE 3 END, CASE WHEN list_has_any(ids, ['unique_identifier', 'public_external_sensitive', 'anonymous_contradiction']) THEN 3 WHEN len(ids) > 0 THEN 2 ELSE 0 END) AS grade FROM o)
SELECT id, level, score, array_to_string(ids, ',') AS rules, (['safe', 'caution', 'risk', 'high_risk'])[grade + 1] AS final FROM v""")
def form_scores(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the questions of a form, deductions, score, overrides and final grade."""
    rows = given(spark, d, "supplier", "s_suppkey", SCORED | {"gaps": listed(LACKS, "spark")}).withColumnRenamed("id", "form_id")
    items = table(spark, d, "lineitem").where("l_quantity > 49 and l_returnflag = 'R' and l_linenumber = 1").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    asked = items.select(F.col("l_suppkey").alias("form_id"), F.expr(chosen("split_part(p_name, ' ', 1)", SHORT)).alias("label"), F.lit("radio").alias("kind"), F.lit(False).alias("has_personal"))
    scored = diagnosis.score_forms(rows, asked)
    return scored.select(F.col("form_id").alias("id"), F.col("data_level").alias("level"), "score", F.array_join("overrides", ",").alias("rules"), F.col("final_grade").alias("final"))


# --- quality -------------------------------------------------------------------------------------------------------

SAYS = {"small": "논문 설문", "red": "교육청 안내", "blue": "산학협력단", "new": "경품", "cold": "고객 만족", "large": "박사 학위", "hot": "보건소", "old": ""}
WHOSE = {"ring": "주식회사", "bolt": "문화재단", "plate": "", "rod": "입학처", "gear": "csat", "gizmo": "", "anvil": "석사", "widget": "카드사"}
ORGANIZATIONS = {"said": f"{chosen("split_part(p_name, ' ', 1)", SAYS)} || ' ' || {chosen("split_part(p_name, ' ', 2)", WHOSE)}"}


@query(f"""WITH x AS ({given_sql("part", "p_partkey", ORGANIZATIONS)}), y AS (SELECT *, regexp_matches(said, '논문|석사|박사') AS a, regexp_matches(said, '산학협력단|입학처') AS u FROM x)
SELECT id, CASE WHEN a AND NOT u THEN 'individual_or_academic' WHEN u THEN 'university_official' WHEN regexp_matches(said, '교육청|보건소|재단') THEN 'public' WHEN regexp_matches(said, '경품|고객 만족|주식회사|csat|카드사') THEN 'company' ELSE 'unknown' END AS organization FROM y""")
def org_qualities(spark: SparkSession, d: str) -> DataFrame:
    """The kind of organization behind a text made of part names."""
    return given(spark, d, "part", "p_partkey", ORGANIZATIONS).select("id", quality.org_quality(F.col("said")).alias("organization"))


LACKING = {
    "personal": "CASE WHEN c_acctbal > 5000 THEN TRUE WHEN c_acctbal > 0 THEN FALSE END", "sensitive": "c_name LIKE '%3'", "high": "c_name LIKE '%13'", "kind": "CASE WHEN c_nationkey < 8 THEN 'public' WHEN c_nationkey < 12 THEN '공공' WHEN c_nationkey < 20 THEN 'private' END",
    "decision": chosen("c_mktsegment", {"MACHINERY": "DO_NOT_RESPOND", "BUILDING": "보유 기간 고지 확인", "AUTOMOBILE": "신고 검토"}), "platform": "CASE WHEN c_nationkey % 3 = 0 THEN 'Google_Forms' WHEN c_nationkey % 3 = 1 THEN 'own' END",
}
LABELS = {"담당자 안내": "c_acctbal < 1000", "고지 항목": "c_acctbal > 8000", "국외 위탁": "c_name LIKE '%7'"}
ORDERED = ["개인정보 포함", "민감정보 포함", "고위험정보 포함"]


@query(f"""WITH x AS ({given_sql("customer", "c_custkey", LACKING | {"labels": listed(LABELS, "duckdb")})}), g AS (SELECT id, list_filter([CASE WHEN personal THEN '개인정보 포함' END, CASE WHEN sensitive THEN '민감정보 포함' END, CASE WHEN high THEN '고위험정보 포함' END, CASE WHEN decision IN ('DO_NOT_RESPOND', '신고 검토') THEN '응답 거부·신고 검토 판단' END,
  CASE WHEN decision = '보유 기간 고지 확인' THEN '고지문 미흡' END, CASE WHEN decision = '보유 기간 고지 확인' THEN '보유기간 미흡' END, CASE WHEN list_contains(labels, '담당자 안내') THEN '담당자 연락처 미흡' END, CASE WHEN list_contains(labels, '고지 항목') THEN '고지문 미흡' END, CASE WHEN list_contains(labels, '고지 항목') THEN '수집 항목 미흡' END,
  CASE WHEN list_contains(labels, '국외 위탁') THEN '외부 설문도구·위탁 안내 미흡' END, CASE WHEN list_contains(labels, '국외 위탁') THEN '국외이전 확인 필요' END, CASE WHEN kind IN ('public', '공공') AND platform = 'Google_Forms' THEN '공공부문 외부도구·CSAP 확인 필요' END], lambda v: v IS NOT NULL) AS l FROM x)
SELECT id, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ',') AS gaps FROM g""")
def improvement_labels(spark: SparkSession, d: str) -> DataFrame:
    """What a form should improve, in order and each once."""
    rows, c = given(spark, d, "customer", "c_custkey", LACKING | {"labels": listed(LABELS, "spark")}), F.col
    gaps = quality.improvement_gaps(c("personal"), c("sensitive"), c("high"), c("decision"), c("kind"), c("platform"), c("labels"))
    return rows.select("id", F.array_join(gaps, ",").alias("gaps"))


SEARCHES = {
    "intent": chosen("p_type", {"MEDIUM": "company", "STANDARD": "public", "LARGE": "mixed", "SMALL": "university_official", "PROMO": "platform_focus"}, "other"), "platform": chosen("split_part(p_name, ' ', 2)", {"ring": "forms.gle", "bolt": "moaform.com/q", "plate": "naver.me", "rod": "form.naver.com"}, "any"),
    "strategy": "CASE WHEN p_size < 12 THEN 'sim_relevance' WHEN p_size < 24 THEN 'deep_seed' WHEN p_size < 36 THEN 'date_breadth' ELSE 'all' END", "asked": "CASE WHEN p_retailprice < 920 THEN ' Part-A ' WHEN p_retailprice < 950 THEN 'B' WHEN p_retailprice < 990 THEN NULL ELSE 'x' END",
}


@query(f"""WITH x AS ({given_sql("part", "p_partkey", SEARCHES)}) SELECT id, CASE WHEN intent IN ('company', 'platform_focus') OR platform = 'moaform.com/q' OR (strategy IN ('sim_relevance', 'deep_seed') AND intent = 'mixed') THEN 'b' WHEN intent IN ('public', 'university_official') OR (strategy = 'date_breadth' AND platform IN ('forms.gle', 'naver.me', 'form.naver.com')) THEN 'a' ELSE 'b' END AS part,
  CASE WHEN asked = ' Part-A ' THEN 'a' WHEN asked = 'B' THEN 'b' ELSE 'all' END AS asked FROM x""")
def query_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Which half of the searches each query belongs to, and which one was asked for."""
    rows = given(spark, d, "part", "p_partkey", SEARCHES)
    return rows.select("id", quality.partition(F.col("intent"), F.col("platform"), F.col("strategy")).alias("part"), quality.parsed_partition(F.col("asked")).alias("asked"))


READ = {
    "final": "o_totalprice < 5000", "ok": "o_orderpriority NOT LIKE '1%'", "confidence": "CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'low' END", "more_pages": "day(o_orderdate) > 25", "branching": "CASE WHEN month(o_orderdate) = 5 THEN TRUE END", "privacy_likely": "o_totalprice > 300000",
    "notice": "CASE WHEN o_totalprice < 400000 THEN 'a notice' END", "before": "CASE WHEN day(o_orderdate) < 20 THEN day(o_orderdate) % 8 END", "personal_before": "month(o_orderdate) % 4",
}


@query(f"""WITH q AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (WHERE l_quantity < 25) AS odd, count(*) FILTER (WHERE l_returnflag = 'R') AS personal FROM lineitem GROUP BY 1), x AS ({given_sql("orders", "o_orderkey", READ)}), y AS (SELECT x.*, coalesce(n, 0) AS n, coalesce(odd, 0) AS odd, coalesce(personal, 0) AS p FROM x LEFT JOIN q USING (id)),
r AS (SELECT *, CASE WHEN final THEN [] ELSE {listed({"zero_questions": "NOT ok OR n = 0", "low_confidence": "confidence = 'low'", "multi_page_signal": "more_pages AND confidence <> 'high'", "branching_signal": "coalesce(branching, FALSE) AND confidence <> 'high'", "missing_privacy_notice": "privacy_likely AND notice IS NULL", "invalid_structure": "n > 0 AND odd * 2 >= n", "question_count_drop": "coalesce(before > 0 AND n < greatest(1, floor(before * 0.6)), FALSE)", "risk_detection_drop": "personal_before > 0 AND p < personal_before"}, "duckdb")} END AS l FROM y)
SELECT id, len(l) = 0 AS accept, l[1] AS reason, array_to_string(l, ',') AS reasons FROM r""")
def reading_gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether a quick reading of a form, with the lines of an order as its questions, may stand, and why not."""
    line = F.struct(
        F.when(F.col("l_quantity") < 25, "-").otherwise("a question").alias("label"), F.array(F.lit("a long option"), F.col("l_linestatus")).alias("options"), (F.col("l_returnflag") == "R").alias("personal"), F.array(F.lit("opinion")).alias("categories")
    )
    asked = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(line).alias("questions"))
    rows, c = given(spark, d, "orders", "o_orderkey", READ).join(asked, "id", "left"), F.col
    told = quality.reading_gate({n: c(n) for n in ("final", "ok", "confidence", "questions", "more_pages", "branching", "privacy_likely", "notice")}, {"questions": c("before"), "personal": c("personal_before")})
    return rows.withColumn("told", told).select("id", "told.accept", "told.reason", F.array_join("told.reasons", ",").alias("reasons"))
