"""Rules on addresses, questions, duties, outcomes and dates, over cases worked out by hand: test_by_hand.py runs them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, forms, text, urls
from tidemark.operators import cases as case_rules
from tidemark.operators import collecting, diagnosis, freshness, obligations, outcomes, questions

BY_HAND = {}


def cases_of(spark, cases, schema):
    """``id``, the number of the case, and its inputs."""
    return spark.createDataFrame([(k, *case) for k, case in enumerate(cases)], f"id long, {schema}")


def expected(columns, results):
    """Register a function under its name, with what it gives for each case."""

    def register(function):
        BY_HAND[function.__name__] = (function, columns.replace('"', "").split(", "), results)
        return function

    return register

# url, ok, platform, form_id, reason, kind, domain, canonical
ADDRESSES = [
    ("https://docs.google.com/forms/d/e/ab-1/viewform?usp=sf", True, "google_forms", "ab-1", None, "google_forms", True, "https://docs.google.com/forms/d/e/ab-1/viewform"),
    ("https://docs.google.com/forms/d/x9/edit", False, None, None, "editor", "unsupported", True, "https://docs.google.com/forms/d/x9/viewform"),
    ("https://docs.google.com/forms/d/x9/viewanalytics", False, None, None, "results", "unsupported", True, "https://docs.google.com/forms/d/x9/viewanalytics"),
    ("https://docs.google.com/forms/d/e/x9/formResponse", False, None, None, "submission", "unsupported", True, "https://docs.google.com/forms/d/e/x9/viewform"),
    ("https://docs.google.com/forms/d/e/x9/closedform", True, "google_forms", "x9", None, "google_forms", True, "https://docs.google.com/forms/d/e/x9/viewform"),
    ("HTTPS://Docs.Google.com/forms/d/e/x9/#top", True, "google_forms", "x9", None, "google_forms", True, "https://docs.google.com/forms/d/e/x9/viewform"),
    ("https://docs.google.com/document/d/x9", False, None, None, "no_form_path", "unsupported", False, "https://docs.google.com/document/d/x9"),
    ("https://forms.gle/q1W", False, None, None, "shortener", "shortener", True, "https://forms.gle/q1W"),
    ("http://naver.me/abc", False, None, None, "shortener", "shortener", True, "http://naver.me/abc"),
    ("http://form.naver.com/response/Zz_9/?ref=a&p=1", True, "naver_form", "Zz_9", None, "naver_form", True, "http://form.naver.com/response/Zz_9?p=1"),
    ("https://form.naver.com/forms/Zz_9", False, None, None, "no_form_path", "unsupported", True, "https://form.naver.com/forms/Zz_9"),
    ("https://www.moaform.com/q/Qq1?utm_source=x&z=2", True, "moaform", "Qq1", None, "moaform", True, "https://www.moaform.com/q/Qq1"),
    ("https://moaform.com/", False, None, None, "root", "unsupported", True, "https://moaform.com/"),
    ("https://moaform.com/pricing", False, None, None, "no_form_path", "unsupported", True, "https://moaform.com/pricing"),
    ("https://help.moaform.com/q/Qq1", False, None, None, "no_form_host", "unsupported", True, "https://help.moaform.com/q/Qq1"),
    ("https://answer.moaform.com/answers/A7/start", True, "moaform", "A7", None, "moaform", True, "https://answer.moaform.com/answers/A7/start"),
    ("https://answer.moaform.com/answers/answers", False, None, None, "no_form_path", "unsupported", True, "https://answer.moaform.com/answers/answers"),
    ("https://answer.moaform.com/", False, None, None, "root", "unsupported", True, "https://answer.moaform.com/"),
    ("https://moaform.com/survey/404", False, None, None, "no_form_path", "unsupported", True, "https://moaform.com/survey/404"),
    ("https://surveyl.ink/Ab3", True, "moaform", "Ab3", None, "moaform", True, "https://surveyl.ink/Ab3"),
    ("https://surveyl.ink/a/b", False, None, None, "no_form_path", "unsupported", True, "https://surveyl.ink/a/b"),
    ("ftp://docs.google.com/forms/d/e/x9/viewform", False, None, None, "not_http", "unsupported", True, "ftp://docs.google.com/forms/d/e/x9/viewform"),
    ("no address", False, None, None, "not_an_address", "unsupported", False, None),
    ("https://survey.wiseon.kr/x?utm_id=3&k=1", False, None, None, "unsupported", "unsupported", True, "https://survey.wiseon.kr/x?k=1"),
]


@expected("ok, platform, form_id, reason, kind, domain, canonical", [a[1:] for a in ADDRESSES])
def form_addresses(spark):
    """Which form an address belongs to, or why none; its kind; and its canonical form."""
    rows = cases_of(spark, [a[:1] for a in ADDRESSES], "url string")
    told = forms.response_address(F.col("url"))
    rows = rows.withColumn("told", told)
    return rows.select("id", "told.ok", "told.platform", "told.form_id", "told.reason", forms.address_kind(F.col("url")).alias("kind"), forms.form_domain(F.col("url")).alias("domain"), forms.canonical_address(F.col("url")).alias("canonical"))


# label, auxiliary, kind, has_personal, categories, level
QUESTIONS = [
    ("이름을 적어 주세요", None, "short_text", True, "name", "D3"), ("휴대전화 번호", None, "short_text", True, "phone", "D3"), ("메일링 리스트 가입", None, "radio", False, "", "D1"), ("이메일 주소", None, "short_text", True, "email", "D3"),
    ("귀하의 연령은?", None, "radio", False, "respondent_age", "D2"), ("자녀의 연령대", None, "radio", False, "child_age_range", "D2"), ("연령대", None, "radio", False, "age_range", "D2"), ("성별 (남/여)", None, "radio", False, "gender", "D2"),
    ("소속 부서와 직급", None, "short_text", False, "affiliation,department,position", "D2"), ("주민등록번호", None, "short_text", True, "resident_registration_number", "D5"), ("신분증 사본", None, "file", True, "id_document", "D5"), ("현재 건강 상태", None, "radio", False, "sensitive_health", "D4"),
    ("종교를 알려 주세요", None, "radio", False, "sensitive_religion", "D4"), ("직장 내 괴롭힘 경험", None, "radio", False, "sensitive_complaint", "D4"), ("서비스 만족도", None, "radio", False, "satisfaction", "D1"), ("방문 목적은 무엇입니까", None, "radio", False, "visit_purpose", "D1"),
    ("선호하는 프로그램", None, "radio", False, "program_preference", "D1"), ("정책 방향에 대한 생각", None, "long_text", False, "policy_opinion", "D1"), ("기타 의견", None, "long_text", False, "general_opinion", "D1"), ("불편 사항", None, "long_text", False, "improvement_opinion", "D1"),
    ("바라는 점", None, "long_text", False, "service_feedback", "D1"), ("What is your favourite colour?", None, "short_text", False, "", "D1"), ("첨부 id", None, "file", False, "", "D5"), ("그 밖의 사항", None, "radio", True, "", "D2"),
    ("만족도와 이름", "전화번호 입력", "short_text", True, "name,phone", "D1"), ("거주지역", "시군구", "radio", False, "residence_area", "D2"), ("계좌번호와 예금주", None, "short_text", True, "financial_account", "D5"), ("통장 사본", None, "file", False, "", "D5"),
    ("tel", None, "short_text", True, "phone", "D3"), ("건강 프로그램", None, "radio", False, "program_preference", "D1"), ("질병 여부", None, "radio", False, "", "D4"), ("이용 경험", None, "radio", False, "general_opinion", "D1"),
]


@expected("categories, level", [(q[4], q[5]) for q in QUESTIONS])
def question_categories(spark):
    """What questions ask for, and how much that risks."""
    rows = cases_of(spark, [q[:4] for q in QUESTIONS], "label string, auxiliary string, kind string, personal boolean")
    both = F.trim(F.concat_ws(" ", "label", "auxiliary"))
    return rows.select("id", F.array_join(questions.detect_categories(both), ",").alias("categories"), questions.full_question_level(F.col("label"), F.col("auxiliary"), F.col("kind"), F.col("personal")).alias("level"))


# text, public, platform, verified, level, anonymous, flags, tool, number of duties, first and last duty
FORMS = [
    ("직원 만족 설문", False, "google_forms", False, "D4", False, "employee_survey", "overseas_saas", 25, "collection_purpose", "small_group_privacy"),
    ("경품 이벤트 응모", False, "naver_form", False, "D3", False, "event_prize", "domestic_saas", 14, "collection_purpose", "prize_data_separation"),
    ("시설 안내", True, "moaform", False, "D2", True, "public_agency", "domestic_saas", 17, "collection_purpose", "result_disclosure_prevention"),
    ("그냥 설문", False, "unknown", False, "D1", False, "general_company", "generic_limited", 0, None, None),
    ("마케팅 뉴스레터 신청", False, "google_forms", True, "D2", False, "marketing", "csap_verified", 10, "collection_purpose", "marketing_opt_out"),
    ("관광 시티투어 직원 안내", False, "google_forms", False, "D2", True, "general_company", "overseas_saas", 13, "collection_purpose", "anonymity_standard"),
    ("학생 민원 접수", True, "wiseon_csap", False, "D5", False, "public_agency,complaint_report,child_possible", "csap_verified", 16, "collection_purpose", "result_disclosure_prevention"),
]


@expected("flags, tool, n_duties, first_duty, last_duty", [f[6:] for f in FORMS])
def form_duties(spark):
    """Context of a form, the level of its tool and the duties that follow."""
    rows = cases_of(spark, [f[:6] for f in FORMS], "text string, public boolean, platform string, verified boolean, level string, anonymous boolean")
    rows = rows.withColumn("flags", obligations.context_flags(F.col("text"), F.col("public"))).withColumn("tool", obligations.tool_level(F.col("platform"), F.col("verified")))
    due = obligations.duties(F.col("flags"), F.col("level"), F.col("tool"), F.col("anonymous"))
    return rows.withColumn("due", due).select("id", F.array_join("flags", ",").alias("flags"), "tool", F.size("due").alias("n_duties"), F.try_element_at("due", F.lit(1)).alias("first_duty"), F.try_element_at("due", F.lit(-1)).alias("last_duty"))


# level, tool, flags, gaps, anonymous, identifier, quasi, employee, disclosed, partial, generic, score, rules, grade, final, final_score
OVERRIDES = [
    ("D4", "overseas_saas", ["public_agency"], ["sensitive_consent", "overseas_transfer"], False, False, False, False, False, False, False, 85.0, "sensitive_no_consent,public_external_sensitive,public_google_overseas,overseas_no_notice", "high_risk", "safe", 85.0),
    ("D5", "self_hosted", [], [], False, False, False, False, False, True, True, 30.0, "unique_identifier", "high_risk", "caution", 60.0),
    ("D3", "domestic_saas", ["event_prize"], ["retention_period", "trustee", "prize_destruction"], False, False, False, False, True, True, True, 65.0, "no_retention,event_no_destruction", "risk", "caution", 65.0),
    ("D3", "domestic_saas", ["public_agency"], ["public_csap_verification", "trustee", "collection_items", "collection_purpose"], False, False, False, False, False, True, False, 45.0, "no_items,no_purpose,saas_no_trustee,public_no_csap", "risk", "risk", 45.0),
    ("D2", "overseas_saas", ["marketing"], ["marketing_optional_consent", "retention_period"], True, True, False, False, False, False, False, 70.0, "anonymous_contradiction,marketing_no_consent", "high_risk", "caution", 70.0),
    ("D4", "self_hosted", ["employee_survey"], [], False, False, True, True, False, False, False, 50.0, "employee_sensitive_identifiable", "high_risk", "risk", 50.0),
    ("D1", "generic_limited", [], None, None, None, None, None, None, None, None, 90.0, "", None, "safe", 90.0),
]


@expected("rules, grade, final, final_score", [o[12:] for o in OVERRIDES])
def grade_overrides(spark):
    """Which of the fourteen rules hold for a form, the grade they ask for, and the cap of forms that were read in part."""
    schema = "level string, tool string, flags array<string>, gaps array<string>, anonymous boolean, identifier boolean, quasi boolean, employee boolean, disclosed boolean, partial boolean, generic boolean, score double"
    rows = cases_of(spark, [o[:12] for o in OVERRIDES], schema)
    hints = {"claims_anonymous": F.col("anonymous"), "identifier_questions": F.col("identifier"), "quasi_questions": F.col("quasi"), "employee_sensitive": F.col("employee"), "trustee_disclosed": F.col("disclosed")}
    told = obligations.overrides(obligations.override_rules(F.col("level"), F.col("tool"), F.col("flags"), F.col("gaps"), hints))
    by_score = F.when(F.col("score") >= 80, "safe").when(F.col("score") >= 60, "caution").when(F.col("score") >= 40, "risk").otherwise("high_risk")
    rows = rows.withColumn("told", told).withColumn("capped", obligations.partial_cap(by_score, F.col("score"), F.col("partial"), F.col("generic")))
    return rows.select("id", F.array_join("told.ids", ",").alias("rules"), "told.grade", F.col("capped.grade").alias("final"), F.col("capped.score").alias("final_score"))


# text, key, level, status, severity
NOTICES = [
    ("수집 목적: 서비스 개선을 위함", "collection_purpose", "D3", "present", "info"), ("동의합니다.", "collection_purpose", "D3", "missing", "high"), ("이 설문은 누구나 참여할 수 있습니다", "retention_period", "D3", "unclear", "medium"),
    (None, "sensitive_consent", "D4", "missing", "critical"), ("안내문이 있으나 내용이 없습니다", "overseas_transfer", "D2", "unclear", "high"), ("", "trustee", "D2", "missing", "medium"), ("짧음", "contact_department", "D2", "missing", "low"),
    ("다른 안내문이 길게 있습니다", "contact_department", "D1", "unclear", "low"), (None, "prize_destruction", "D1", "missing", "medium"), ("보유 기간은 일 년이며 목적 달성 후 파기", "retention_period", "D2", "present", "info"), ("아무 안내도 없는 긴 글입니다", "collection_items", "D2", "unclear", "low"),
]


@expected("status, severity", [n[3:] for n in NOTICES])
def notice_gaps(spark):
    """Whether a notice meets a duty, and how bad it is if not."""
    rows = cases_of(spark, [n[:3] for n in NOTICES], "text string, key string, level string")
    rows = rows.withColumn("status", obligations.notice_status(F.col("text"), ("목적", "보유", "기간", "Period")))
    return rows.select("id", "status", obligations.gap_severity(F.col("key"), F.col("status"), F.col("level")).alias("severity"))


# blocks, certainty
FACTS = [(["머리말", "보유기간은 1년입니다"], "FOUND_CONFIRMED"), (["기간은 길지만 여기에 없음"], "FOUND_POSSIBLE"), (["기간", "짧다"], "NEEDS_REVIEW"), (["보유", "기간은"], "FOUND_CONFIRMED"), ([], "NOT_FOUND"), (["다른 글"], "NOT_FOUND")]


@expected("certainty", [(c,) for _, c in FACTS])
def notice_facts(spark):
    """How sure it is that a form tells something, from its blocks and its whole text."""
    rows = cases_of(spark, [(b,) for b, _ in FACTS], "blocks array<string>")
    return rows.select("id", obligations.notice_fact(F.col("blocks"), F.array_join("blocks", " "), r"보유\s*기간", "기간").alias("certainty"))


# official, access, raw, public, employee, names, deduction
CHECKS = [(True, None, None, True, False, "official:confirmed,access:unknown", 1.0), (False, False, False, True, True, "official:missing,access:missing,raw:missing", 5.0), (None, True, None, False, True, "access:confirmed,raw:unknown", 1.0), (None, None, None, False, False, "access:unknown", 1.0), (True, True, True, True, True, "official:confirmed,access:confirmed,raw:confirmed", 0.0)]


@expected("checks, deduction", [c[5:] for c in CHECKS])
def management_signs(spark):
    """Signs of good keeping that are confirmed, missing or unknown, those that apply alone, and what they cost."""
    rows = cases_of(spark, [c[:5] for c in CHECKS], "official boolean, access boolean, raw boolean, public boolean, employee boolean")
    told = obligations.management_checks({n: F.col(n) for n in ("official", "access", "raw")}, {"official": F.col("public"), "raw": F.col("employee")})
    rows = rows.withColumn("told", told)
    return rows.select("id", F.array_join(F.transform("told.checks", lambda x: F.concat_ws(":", x["name"], x["status"])), ",").alias("checks"), "told.deduction")


# risk, diagnosis, decision, scan status, reason, bucket, feedback, link status
OUTCOMES = [
    ("low", "ok", "", "completed", "", "normal_diagnosis", None, "completed"), ("limited", "limited", "", "limited", "The survey is closed.", "survey_closed", "closed", "skipped_closed"), ("limited", "", "", "limited", "Login required to view", "access_restricted", "restricted", "skipped_restricted"),
    ("", "limited", "", "limited", "Questions could not be read (JavaScript)", "extraction_limited", None, "limited"), ("", "", "", "failed", "unexpected exception, try again", "system_failure", None, "timeout"), ("", "", "", "failed", "survey is closed", "survey_closed", "closed", "skipped_closed"),
    ("", "", "", "failed", "", "extraction_limited", None, "failed_retryable"), ("", "", "", "pending", None, "normal_diagnosis", None, "queued"), ("", "", "", "running", None, "normal_diagnosis", None, "running"), ("", "", "", "cancelled", None, "normal_diagnosis", None, "failed_final"),
    ("", "", "", "limited", "request timeout", "system_failure", None, "timeout"), ("limited", "", "", "completed", "", "extraction_limited", None, "completed"),
]


@expected("bucket, feedback, link_status", [o[5:] for o in OUTCOMES])
def limited_outcomes(spark):
    """Why a diagnosis stayed limited, what that says about the link, and the status of the linkage."""
    rows = cases_of(spark, [o[:5] for o in OUTCOMES], "risk string, diagnosis string, decision string, scan string, reason string")
    bucket = outcomes.limited_bucket(F.col("risk"), F.col("diagnosis"), F.col("decision"), F.col("scan"), F.col("reason"))
    from_scan = outcomes.limited_bucket(F.lit(""), F.lit(""), F.lit(""), F.col("scan"), F.col("reason"))
    return rows.select("id", bucket.alias("bucket"), outcomes.link_feedback(F.col("reason")).alias("feedback"), outcomes.link_status(F.col("scan"), from_scan, F.col("reason")).alias("link_status"))


# old, target, hours since seen, applied, why
FEEDBACK = [
    ("active", None, 1.0, False, "no_target"), ("closed", "closed", 1.0, False, "already_there"), ("closed", "restricted", 1.0, False, "keeps_closed"), ("ignored", "closed", 50.0, False, "set_aside"), ("invalid", "closed", 50.0, False, "set_aside"),
    ("active", "closed", 2.0, False, "seen_recently"), ("active", "closed", 50.0, True, "applied"), ("discovered", "restricted", 6.0, True, "applied"), (None, "closed", 9.0, False, "no_link"),
]


@expected("applied, why", [f[3:] for f in FEEDBACK])
def status_feedback(spark):
    """Whether a diagnosis may change the status of a link, and why not."""
    rows = cases_of(spark, [f[:3] for f in FEEDBACK], "old string, target string, hours double")
    why = outcomes.feedback_reason(F.col("old"), F.col("target"), F.col("hours"))
    return rows.select("id", (why == "applied").alias("applied"), why.alias("why"))


# privacy, verdict, subject, external, direct, sensitive, high, gaps, consent missing, employee, safety, report
SAFETY = [
    ("limited", "OK", "public_agency", True, 1, 0, 0, 5, False, False, "JUDGMENT_UNKNOWN", False), ("direct_identifier", "OK", "unknown", False, 1, 0, 0, 0, False, False, "STOP_RESPONSE", False), ("direct_identifier", "OK", "public_agency", True, 1, 0, 0, 2, False, False, "STOP_RESPONSE", True),
    ("direct_identifier", "OK", "private_company", True, 2, 0, 0, 1, False, False, "NOTICE_CHECK", False), ("quasi_only", "OK", "private_company", False, 0, 0, 0, 4, False, False, "PII_CAUTION", False), ("minimal", "OK", "unknown", False, 0, 0, 0, 0, False, False, "SECURITY_CHECK", False),
    ("minimal", "OK", "private_company", False, 0, 0, 0, 0, False, False, "SAFE_RESPOND", False), ("sensitive_or_high_risk", "OK", "private_company", False, 0, 1, 0, 3, False, False, "STOP_RESPONSE", True), ("direct_identifier", "OK", "private_company", True, 1, 0, 1, 0, False, False, "STOP_RESPONSE", True),
    ("direct_identifier", "DO_NOT_RESPOND", "private_company", False, 1, 0, 0, 0, False, False, "STOP_RESPONSE", False), ("sensitive_or_high_risk", "OK", "private_company", False, 1, 1, 0, 0, True, False, "STOP_RESPONSE", True), ("direct_identifier", "OK", "private_company", False, 1, 0, 0, 2, False, True, "NOTICE_CHECK", True),
]


@expected("safety, report", [s[10:] for s in SAFETY])
def safety_types(spark):
    """How safe it is to answer a form, and whether to report it."""
    schema = "privacy string, verdict string, subject string, external boolean, direct int, sensitive int, high int, gaps int, consent_missing boolean, employee boolean"
    rows = cases_of(spark, [s[:10] for s in SAFETY], schema)
    c = F.col
    safety = outcomes.safety_type(c("privacy"), c("verdict"), c("subject"), c("external"), c("direct"), c("sensitive"), c("high"))
    return rows.select("id", safety.alias("safety"), outcomes.report_advised(c("privacy"), c("subject"), c("external"), c("direct"), c("sensitive"), c("high"), c("gaps"), c("consent_missing"), c("employee")).alias("report"))


# text, posted, first, last
PERIODS = [
    ("Posted: 2026-03-05, survey", "2026-03-05", None, None), ("등록일 : 2026. 3. 5 조사", "2026-03-05", None, None), ("작성일 25/12/2025", "2025-12-25", None, None), ("Date posted 03-04-2026", "2026-03-04", None, None), ("no label 2026-01-01", None, None, None),
    ("기간 2026.03.01 ~ 2026.03.20", None, "2026-03-01", "2026-03-20"), ("2026년 3월 1일 ~ 4월 2일까지", None, "2026-03-01", "2026-04-02"), ("2026-03-01 ~ 2026-03-09 and 2026-02-01 ~ 2026-02-03", None, "2026-02-01", "2026-03-09"), ("2026.3.1부터 2026.3.9까지", None, "2026-03-01", "2026-03-09"),
    ("open 3.2(월) ~ 3.9(월)", None, "2026-03-02", "2026-03-09"), ("2026.02.01 ~ 2026.02.30", None, "2026-02-01", "2026-02-30"), ("2026.13.01 ~ 2026.12.05", None, None, "2026-12-05"), ("Copyright 2020-2024, posted 2026/2/3", "2026-02-03", None, None), (None, None, None, None),
]


@expected("posted, first_day, last_day", [p[1:] for p in PERIODS])
def posted_days_and_periods(spark):
    """The day on which a page says it was posted, and the first and last day of the periods it names."""
    rows = cases_of(spark, [p[:1] for p in PERIODS], "text string")
    period = dates.periods(F.col("text"), 2026)
    return rows.withColumn("p", period).select("id", dates.posted_day(F.col("text")).alias("posted"), "p.first_day", "p.last_day")


# status, freshness, reason, should, title, official, lane, hold, auto
LANES = [
    ("active", "active", "recent_window", True, "City survey", True, "active_recent", None, True), ("active", "active", "active_unknown_date", True, "City survey", True, "date_unknown_hold", "date_unknown", False), ("active", "active_candidate", "", True, "City survey", False, "active_candidate", None, False),
    ("active", "unknown", "other", True, "City survey", True, "collect_confirmed", None, True), ("active", "unknown", "other", False, "City survey", True, "screened_out", "screened", False), ("active", "unknown", "date_unknown_hold", False, "City survey", True, "date_unknown_hold", "date_unknown", False),
    ("discovered", "unknown", "", True, "City survey", True, "collect_candidate", "not_confirmed", False), ("closed", "closed", "", False, "City survey", True, "screened_out", "screened", False), ("active", "stale_candidate", "", True, "City survey", True, "stale_candidate", "stale", False),
    ("active", "active", "recent_window", True, "My thesis survey", True, "screened_out", "screened", False), (None, None, None, None, None, None, "raw_discovered", "not_confirmed", False), ("odd", "", "", True, "City survey", True, "collect_candidate", "not_confirmed", False),
]


@expected("lane, hold, auto", [x[6:] for x in LANES])
def collect_lanes(spark):
    """The lane of a found form, why it is held back, and whether it is diagnosed without asking."""
    rows = cases_of(spark, [x[:6] for x in LANES], "status string, freshness string, reason string, should boolean, title string, official boolean")
    lane = collecting.lane(F.col("status"), F.col("freshness"), F.col("reason"), F.col("should"), F.col("title"))
    rows = rows.withColumn("lane", lane)
    return rows.select("id", "lane", collecting.hold_reason(F.col("lane")).alias("hold"), collecting.auto_target(F.col("lane"), F.col("should"), F.col("title"), F.col("official")).alias("auto"))


# posted, start, end, deadline, eligible, unknown, language, cap, confidence
CONFIDENCE = [("2026-01-01", None, None, None, True, False, False, None, "high"), ("2026-01-01", None, None, None, True, False, False, "low", "medium"), (None, None, "2026-01-09", None, False, False, False, None, "high"), (None, None, None, None, True, False, True, None, "medium"), (None, None, None, None, True, False, False, "low", "low"), (None, None, None, None, False, True, False, None, "none"), (None, None, None, None, False, False, False, None, "low"), (None, None, None, None, False, True, False, "low", "none")]


@expected("confidence", [x[8:] for x in CONFIDENCE])
def freshness_confidence(spark):
    """How sure the freshness of a form is, with the cap of its source page."""
    rows = cases_of(spark, [x[:8] for x in CONFIDENCE], "posted string, start string, last string, deadline string, eligible boolean, unknown boolean, language boolean, cap string")
    c = F.col
    return rows.select("id", collecting.confidence(c("posted"), c("start"), c("last"), c("deadline"), c("eligible"), c("unknown"), c("language"), c("cap")).alias("confidence"))


# public, personal, sensitive, high, risk, report, evidence, capture, badges, priority, evidence status, wording
OUTREACH = [
    ("public", True, False, False, "low", False, 1, "success", ["목적 고지 미흡"], "A", "증거 확보", "개선 필요"), ("public", True, False, False, "low", False, 0, None, ["목적"], "B", "증거 부족", "개선 필요"), ("private", True, False, False, "high", False, 1, "partial", ["CSAP 확인"], "A", "일부 확보", "위반 소지"),
    ("private", True, False, False, "low", False, 3, None, [], "B", "증거 확보", "개선 필요"), ("private", False, False, False, "low", False, 1, None, ["국외이전"], "C", "일부 확보", "확인 필요"), ("private", False, True, False, "low", False, 2, "pending", [], "A", "캡처 필요", "개선 필요"),
    ("private", False, False, True, "low", False, 0, "running", [], "A", "캡처 필요", "위반 소지"), ("private", False, False, False, None, True, 0, None, None, "A", "증거 부족", "개선 필요"), (None, None, None, None, None, None, None, None, None, "C", "증거 부족", "개선 필요"),
]


@expected("priority, evidence, wording", [x[9:] for x in OUTREACH])
def outreach_priorities(spark):
    """Whom to write to first, what evidence there is, and how to put it."""
    rows = cases_of(spark, [x[:9] for x in OUTREACH], "org string, personal boolean, sensitive boolean, high boolean, risk string, report boolean, evidence int, capture string, badges array<string>")
    c = F.col
    priority = case_rules.outreach_priority(c("org"), c("personal"), c("sensitive"), c("high"), c("risk"), c("report"), c("evidence"), c("badges"))
    return rows.select("id", priority.alias("priority"), case_rules.evidence_status(c("evidence"), c("capture")).alias("evidence"), case_rules.wording(c("high"), c("risk"), c("badges")).alias("wording"))


# finding, domain, label
ISSUES = [
    ("personal_info_risk", "sensitive_data", "sensitive_questions"), ("personal_info_risk", "", "personal_questions"), ("high_risk_info", "high_risk_data", "high_risk_questions"), ("notice_gap", "retention", "retention_gap"), ("consent_gap", None, "consent_gap"), ("x", "overseas_transfer", "overseas_check"),
    ("public_sector_cloud", "", "public_cloud_check"), ("tool_governance", "", "external_tool_check"), ("operator_unclear", "", "operator_check"), ("limited_diagnosis", "", "limited"), ("management_gap", "", "notice_gap"), ("notice_gap", "contact", "notice_gap"), (None, None, "other"), ("x", "destruction", "retention_gap"),
]


@expected("label", [x[2:] for x in ISSUES])
def public_issue_labels(spark):
    """The public label of a finding, by twelve ordered rules."""
    rows = cases_of(spark, [x[:2] for x in ISSUES], "finding string, domain string")
    return rows.distinct().select("id", case_rules.issue_label(F.col("finding"), F.col("domain")).alias("label"))


# code, label, bucket, notice item, decision id, decision label, decision
BUCKETS = [
    ("name", "", "identity", "수집 목적 안내", "", "", "OTHER", "purpose"), ("", "휴대전화", "contact", "보유 및 이용기간", "JUDGMENT_UNKNOWN", "", "JUDGMENT_UNKNOWN", "retention"), ("satisfaction", "", None, "수집 항목", "", "문항 분석 불가", "JUDGMENT_UNKNOWN", "items"), ("zzz", "?", "other", "기타", "STOP_RESPONSE", "", "STOP_RESPONSE", None),
    ("sensitive_health", "", "sensitive", "동의 거부권", "", "응답 주의", "PII_CAUTION", "refusal"), ("gender", "", "demographic", "목적", "x", "y", "OTHER", "purpose"), (None, None, "other", None, None, None, "OTHER", None),
]


@expected("bucket, decision, notice_item", [(x[2], x[6], x[7]) for x in BUCKETS])
def label_buckets(spark):
    """Buckets of data categories, decisions by id or alias, and notice items by their first pattern."""
    rows = cases_of(spark, [(x[0], x[1], x[3], x[4], x[5]) for x in BUCKETS], "code string, label string, item string, decision_id string, decision_label string")
    return rows.select("id", case_rules.category_bucket(F.col("code"), F.col("label")).alias("bucket"), case_rules.decision(F.col("decision_id"), F.col("decision_label")).alias("decision"), case_rules.notice_item(F.col("item")).alias("notice_item"))


# name, key, aliases, latin
NAMES = [("서울시청", "서울시청", "서울시청,서울특별시청", "seoulsicheong"), ("(주)한빛 연구소", "한빛연구소", "(주)한빛 연구소,한빛 연구소", "juhanbityeonguso"), ("부산광역시 (부산시)", "부산광역시", "부산광역시 (부산시),부산광역시,부산시", "busangwangyeoksibusansi"), ("Ａｂｃ 재단법인", "abc", "Ａｂｃ 재단법인,Ａｂｃ", "jaedanbeopin"), (None, None, "", None)]


@expected('"key", aliases, latin', [x[1:] for x in NAMES])
def institution_names(spark):
    """Keys of institution names, their aliases and their Latin letters."""
    rows = cases_of(spark, [x[:1] for x in NAMES], "name string")
    return rows.select("id", text.name_key(F.col("name")).alias("key"), F.array_join(text.name_aliases(F.col("name")), ",").alias("aliases"), text.romanized(F.col("name")).alias("latin"))


# page, home, real
SOURCES = [("https://city.kr/notice/5", "https://www.city.kr/", True), ("https://city.kr/", "https://city.kr", False), ("https://other.kr/notice/5", "https://city.kr", False), ("https://docs.google.com/forms/d/e/x/viewform", "https://city.kr", False), ("https://city.kr/index.html", None, False), ("https://city.kr/board/1", None, True), ("ftp://city.kr/board/1", "https://city.kr", False), (None, "https://city.kr", False), ("http://city.kr:80/a", "https://city.kr", True)]


@expected("real, public", [(x[2], (x[0] or "").startswith("http")) for x in SOURCES])
def source_pages(spark):
    """Whether a page is a real source: on its institution's host, not its start page and no form platform; and whether its address may be fetched."""
    rows = cases_of(spark, [x[:2] for x in SOURCES], "page string, home string")
    return rows.select("id", collecting.real_source(F.col("page"), F.col("home")).alias("real"), urls.public_address(F.col("page")).alias("public"))


# title, snippet, page text, url, published, status, reason
FRESH = [
    ("A", "", "", "https://x.kr/closedform", None, "closed", "closed_url"), ("Survey has ended", "", "", "https://x.kr/a", None, "closed", "closed_phrase"), ("A", "Sign in to continue", "", "https://x.kr/a", None, "restricted", "restricted_phrase"), ("My thesis", "", "", "https://x.kr/a", None, "ignored", "personal_research"),
    ("Last year's survey", "", "", "https://x.kr/a", None, "stale", "previous_year_phrase"), ("A", "2026.01.01 ~ 2026.01.20", "", "https://x.kr/a", None, "closed", "end_date_passed"), ("A", "2026.05.01 ~ 2026.05.20", "", "https://x.kr/a", None, "discovered", "start_date_future"), ("Results of 2023", "", "", "https://x.kr/a", None, "stale", "stale_topic_year"),
    ("In 2024", "", "", "https://x.kr/a", None, "stale", "stale_year"), ("A", "", "", "https://x.kr/a", "2025-06-01", "stale", "published_too_old"), ("A", "", "", "https://x.kr/a", "2026-02-20", "discovered", "published_recent"), ("Now open", "", "", "https://x.kr/a", None, "discovered", "in_progress_phrase"),
    ("A", "2026.02.01 ~ 2026.04.20", "", "https://x.kr/a", None, "discovered", "recent_window"), ("A", "", "", "https://x.kr/a", None, "discovered", "date_unknown_hold"), ("© 2019 A", "", "", "https://x.kr/a", None, "discovered", "date_unknown_hold"),
]


@expected("status, reason", [x[5:] for x in FRESH])
def freshness_outcomes(spark):
    """Whether a found form is still open on a given day, by ordered rules."""
    rows = cases_of(spark, [x[:5] for x in FRESH], "title string, snippet string, page_text string, url string, published_on string")
    told = freshness.evaluate_freshness(rows, "2026-03-05")
    return told.select("id", "freshness.status", "freshness.reason")


# title, host, published, by_date, first_seen, organization, recency, queue
TRIAGE = [
    ("City hall survey", "x.kr", "2026-02-20", True, True, "public", "recent_high", "A_PRIORITY"), ("A", "a.go.kr", None, False, False, "public", "unknown", "A_PRIORITY"), ("My study, thesis", "x.kr", "2026-02-20", True, True, "individual_or_academic", "recent_high", "C_ARCHIVE"),
    ("Customer satisfaction", "x.kr", "2025-10-20", False, False, "company", "recent_possible", "A_PRIORITY"), ("Customer satisfaction 2020", "x.kr", "2024-01-01", False, False, "company", "likely_old", "C_ARCHIVE"), ("A", "x.kr", None, False, False, "unknown", "unknown", "C_ARCHIVE"), ("Please help", "x.kr", None, False, True, "individual_or_academic", "unknown", "C_ARCHIVE"),
    ("A 2026", "x.kr", None, False, False, "unknown", "recent_possible", "B_PRIORITY"), ("University library closed", "x.kr", "2026-02-20", False, False, "university_official", "recent_possible", "A_PRIORITY"),
]


@expected("organization, recency, queue", [x[5:] for x in TRIAGE])
def triage_rules(spark):
    """Organization, recency and queue of a found form."""
    rows = cases_of(spark, [x[:5] for x in TRIAGE], "title string, host string, published_on string, by_date boolean, first_seen boolean")
    told = freshness.triage(rows.withColumn("source_title", F.lit("")).withColumn("description", F.lit("")), "2026-03-05")
    return told.select("id", "organization", "recency", "queue")


# labels, tool, mitigated, public, partial, anonymous, gaps, weighted, missing, unknown, flags, level, score, rules, final
SCORES = [
    (["이름", "의견"], "overseas_saas", False, False, False, False, ["retention_period"], 1.0, 2, 0, [], "D3", 29.0, "no_retention", "high_risk"), (["성별"], "domestic_saas", True, False, False, False, [], 0.0, 0, 0, [], "D2", 75.0, "", "caution"),
    ([], "csap_verified", False, False, False, False, None, None, None, None, None, "D0", 100.0, "", "safe"), (["여권 번호"], "self_hosted", None, None, None, None, [], 0.0, 0, 0, [], "D5", 62.0, "unique_identifier", "high_risk"),
    (["이메일"], "domestic_saas", False, True, False, True, ["public_csap_verification"], 0.0, 0, 4, ["marketing"], "D3", 69.0, "anonymous_contradiction,public_no_csap", "high_risk"), (["성별"], "overseas_saas", False, True, True, False, ["collection_items", "trustee"], 1.0, 0, 0, [], "D2", 70.0, "", "caution"),
]


@expected("level, score, rules, final", [x[11:] for x in SCORES])
def form_scores(spark):
    """Levels of the questions of a form, deductions, score, overrides and final grade."""
    schema = "labels array<string>, tool_level string, mitigated boolean, public_sector boolean, partial boolean, claims_anonymous boolean, gaps array<string>, weighted_gaps double, management_missing int, management_unknown int, flags array<string>"
    rows = cases_of(spark, [x[:11] for x in SCORES], schema).withColumnRenamed("id", "form_id")
    asked = rows.select("form_id", F.explode("labels").alias("label"), F.lit("radio").alias("kind"), F.lit(False).alias("has_personal"))
    scored = diagnosis.score_forms(rows, asked)
    return scored.select(F.col("form_id").alias("id"), F.col("data_level").alias("level"), "score", F.array_join("overrides", ",").alias("rules"), F.col("final_grade").alias("final"))
