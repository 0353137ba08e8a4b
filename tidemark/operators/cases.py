"""Cases of a review: priorities, evidence, views, filters, labels and orders."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match, rank_in

RISKS = ("critical", "high", "medium", "low", "limited")
READY, SOME, FEW, TO_DO = "증거 확보", "일부 확보", "증거 부족", "캡처 필요"  # fixed values
# Patterns of badges, buckets of categories, notice items and decisions with their aliases.
NOTICE_BADGE, TOOL_BADGE, CHECK_GAP = "고지|안내 미흡|목적|항목|보유", "외부도구|위탁|CSAP|클라우드", "확인 필요|CSAP|국외"
BUCKETS: Mapping[str, tuple[tuple[str, ...], str]] = {
    "identity": (("name", "birthdate", "resident_registration_number", "id_document"), "이름|성명|생년월일"), "contact": (("phone", "email", "address"), "휴대|연락처|이메일|주소"),
    "sensitive": (("sensitive_health", "sensitive_religion", "sensitive_political", "sensitive_complaint", "sensitive_belief_union"), "건강|종교"), "demographic": (("gender", "age_range", "respondent_age", "residence_area"), "성별|연령"),
}
OPINION_CODES = ("general_opinion", "satisfaction", "preference", "policy_opinion", "service_feedback", "improvement_opinion", "program_preference", "visit_purpose")
NOTICE_ITEMS = {"purpose": "목적", "items": "항목", "retention": "보유|기간", "refusal": "거부"}
DECISIONS = {"STOP_RESPONSE": ("응답 중단",), "NOTICE_CHECK": ("고지 확인",), "SECURITY_CHECK": ("보안 확인",), "PII_CAUTION": ("응답 주의",), "SAFE_RESPOND": ("응답 가능",)}
UNDECIDED = ("문항 분석 불가", "문항 분석 제한")


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def severe(risk: Column) -> Column:
    return yes(F.lower(risk).isin("critical", "high"))


def outreach_priority(org: Column, personal: Column, sensitive: Column, high: Column, risk: Column, report: Column, evidence: Column, badges: Column) -> Column:
    """A, B or C: whom to write to first."""
    public, gap, proof = yes(org == "public"), yes(F.size(badges) > 0), yes(evidence > 0)
    urgent = yes(report) | yes(sensitive) | yes(high) | (yes(personal) & gap & ((public & proof) | (~public & severe(risk))))
    return first_match([(urgent, "A"), (yes(personal), "B")], "C")


def evidence_status(count: Column, capture: Column) -> Column:
    """One of four states of the evidence, from its count and the state of the last capture."""
    state, n = F.lower(F.coalesce(capture, F.lit(""))), F.coalesce(count, F.lit(0))
    return first_match([(state.isin("pending", "running"), TO_DO), (n <= 0, FEW), (state == "partial", SOME), ((state == "success") | (n >= 2), READY)], SOME)


def wording(high: Column, risk: Column, gaps: Column) -> Column:
    """How a finding is put to its owner."""
    return first_match([(yes(high) | severe(risk), "위반 소지"), (yes(F.exists(gaps, lambda g: g.rlike(CHECK_GAP))), "확인 필요")], "개선 필요")


def views(ui_status: Column, evidence: Column, risk: Column, report: Column, public: Column, personal: Column, priority: Column, case_status: Column) -> dict[str, Column]:
    """Named predicates of the review's dashboard; ``reportReady`` and unknown names hold for every case."""
    lacking = evidence.isin(FEW, TO_DO)
    waiting = ui_status.isin("unreviewed", "send", "candidate")
    return {
        "unreviewed": ui_status == "unreviewed", "highOrReport": severe(risk) | yes(report), "outreach": ui_status.isin("send", "candidate"), "publicSector": yes(public), "evidenceReady": evidence.isin(READY, SOME),
        "evidenceMissing": lacking, "captureNeeded": evidence == TO_DO, "priorityEvidence": (priority == "A") & severe(risk) & yes(public) & yes(personal) & lacking & waiting, "reportReady": F.lit(True), "all": F.lit(True),
        "unpublished": case_status.isin("private", "archived"), "reviewing": case_status == "reviewing", "published": case_status == "published", "paused": case_status == "paused",
    }


def public_filters(subject: Column, risk: Column, gaps: Column, badges: Column) -> dict[str, Column]:
    """Named predicates of the public list of cases."""
    badge = lambda pattern: yes(F.exists(badges, lambda b: b.rlike(pattern)))
    return {"all": F.lit(True), "public": subject == "public", "private": subject == "private", "high-risk": severe(risk), "notice-gap": yes(F.size(gaps) > 0) | badge(NOTICE_BADGE), "external-tool": badge(TOOL_BADGE)}


def review_order(priority: Column, risk: Column, report: Column, evidence: Column, reviewed: Column, at: Column, unique: Column) -> list[Column]:
    """The seven keys by which cases are reviewed: priority, risk, advice to report, lacking evidence, not yet reviewed, newest, id."""
    return [
        rank_in(priority, ("A", "B", "C")), rank_in(F.lower(risk), RISKS), F.when(yes(report), 0).otherwise(1), rank_in(evidence, (TO_DO, FEW, SOME, READY)), F.when(yes(reviewed), 1).otherwise(0), at.desc_nulls_last(), unique,
    ]


def issue_label(finding: Column, domain: Column) -> Column:
    """The public label of a finding; what its domain says comes first where both could decide."""
    kind, area = F.lower(F.coalesce(finding, F.lit("other"))), F.lower(F.coalesce(domain, F.lit("")))
    return first_match([
        (area.isin("retention", "destruction"), "retention_gap"), ((area == "consent") | (kind == "consent_gap"), "consent_gap"), ((area == "overseas_transfer") | (kind == "overseas_transfer"), "overseas_check"),
        ((area == "public_sector") | (kind == "public_sector_cloud"), "public_cloud_check"), (area.isin("outsourcing", "tool_governance") | kind.isin("outsourcing", "tool_governance"), "external_tool_check"),
        (kind == "operator_unclear", "operator_check"), (kind == "limited_diagnosis", "limited"), ((kind == "sensitive_info_risk") | (area == "sensitive_data"), "sensitive_questions"),
        ((kind == "high_risk_info") | (area == "high_risk_data"), "high_risk_questions"), (kind == "personal_info_risk", "personal_questions"), (kind.isin("notice_gap", "management_gap") | area.isin("notice", "contact"), "notice_gap"),
    ], "other")


def category_bucket(code: Column, label: Column) -> Column:
    """The bucket of a data category by its code or by a hint in its label; null for mere opinions."""
    low, shown = F.lower(F.coalesce(code, F.lit(""))), F.coalesce(label, F.lit(""))
    return first_match([*[(low.isin(*codes) | shown.rlike(hint), F.lit(name)) for name, (codes, hint) in BUCKETS.items()], (low.isin(*OPINION_CODES), F.lit(None).cast("string"))], F.lit("other"))


def notice_item(item: Column) -> Column:
    return first_match([(item.rlike(pattern), name) for name, pattern in NOTICE_ITEMS.items()])


def decision(type_id: Column, label: Column) -> Column:
    """A decision by its id, else by one of its aliases."""
    known, shown = F.trim(F.coalesce(type_id, F.lit(""))), F.trim(F.coalesce(label, F.lit("")))
    unknown = known.isin("JUDGMENT_UNKNOWN", "LIMITED_DIAGNOSIS") | shown.isin(*UNDECIDED)
    return first_match([(unknown, "JUDGMENT_UNKNOWN"), *[((known == name) | shown.isin(*aliases), name) for name, aliases in DECISIONS.items()]], "OTHER")
