"""What a form has to tell: flags of its context, duties that follow, how its notices meet them, how bad a gap is, and what overrides its grade."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import half_up
from tidemark.functions.rules import any_contains, first_match, matched_names

# Words and patterns of the contexts.
EVENT_WORDS, MARKETING_WORDS, COMPLAINT_WORDS = ("이벤트", "경품", "응모", "추첨", "쿠폰", "당첨"), ("마케팅", "광고", "뉴스레터", "프로모션", "홍보"), ("민원", "피해", "고발", "제보")
CHILD_WORDS = ("아동", "청소년", "학생", "미성년", "어린이", "자녀", "유아")
EMPLOYEES, NO_EMPLOYEES = r"직원|근로자|재직자|조직\s*진단|인사\s*평가|상사\s*평가|직장\s*내\s*고충|근속\s*연수", r"시티투어|관광|이용\s*목적|방문\s*목적|주된\s*목적|서비스\s*이용\s*경험|고객\s*설문|이용자\s*설문|만족도\s*조사"
# Duties by what they follow from.
PERSONAL = ("collection_purpose", "collection_items", "retention_period", "consent_refusal_right", "refusal_disadvantage", "destruction_timing", "processor_contact", "purpose_destruction")
TRUSTEE = ("trustee", "trustee_task", "trustee_oversight")
OVERSEAS = ("overseas_transfer", "overseas_items", "overseas_country", "overseas_recipient", "overseas_purpose", "overseas_retention", "overseas_refusal")
SENSITIVE = ("sensitive_consent", "sensitive_legal_basis", "sensitive_access_control")
EMPLOYEE = ("anonymity_standard", "raw_data_scope", "no_disadvantage", "small_group_privacy")
PRIZE, MARKETING = ("prize_limited_collection", "prize_destruction", "prize_data_separation"), ("marketing_optional_consent", "marketing_opt_out")
PUBLIC = ("public_csap_verification", "public_official_account", "privacy_policy_link", "contact_department", "result_disclosure_prevention", "purpose_destruction")
CORE = ("collection_purpose", "collection_items", "retention_period", "consent_refusal_right")
TOOLS = {"wiseon_csap": "csap_verified", "google_forms": "overseas_saas", "naver_form": "domestic_saas", "moaform": "domestic_saas", "self_hosted": "self_hosted"}
HIGH, RISK = "high_risk", "risk"


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def at_least(level: Column, low: str) -> Column:
    return F.coalesce(level >= low, F.lit(False))


def context_flags(text: Column, public: Column, employee_hint: Column | None = None, company: Column | None = None) -> Column:
    """The flags of a form's context, in order, from its whole text; one that has none is a general company's."""
    employee = ~text.rlike(NO_EMPLOYEES) & (text.rlike(EMPLOYEES) | (yes(employee_hint) if employee_hint is not None else F.lit(False)))
    named = yes(company) if company is not None else F.lit(False)
    flags = matched_names({
        "public_agency": yes(public), "event_prize": any_contains(text, EVENT_WORDS), "employee_survey": employee, "marketing": any_contains(text, MARKETING_WORDS),
        "complaint_report": any_contains(text, COMPLAINT_WORDS), "child_possible": any_contains(text, CHILD_WORDS), "general_company": named & ~yes(public) & ~employee,
    })
    return F.when(F.size(flags) > 0, flags).otherwise(F.array(F.lit("general_company")))


def tool_level(platform: Column, verified: Column) -> Column:
    """The level of the tool a form is made with; a verified one is verified whatever its platform."""
    known = first_match([(platform == name, level) for name, level in TOOLS.items()], "generic_limited")
    return F.when(yes(verified), "csap_verified").otherwise(known)


def duties(flags: Column, level: Column, tool: Column, claims_anonymous: Column) -> Column:
    """The obligations of a form, each once, in the order of what they follow from."""
    flagged = lambda name: yes(F.array_contains(flags, name))
    external, overseas = tool.isin("domestic_saas", "overseas_saas"), tool == "overseas_saas"
    direct, personal = at_least(level, "D3"), at_least(level, "D2")
    sets: list[tuple[Column, Sequence[str]]] = [
        (personal, PERSONAL), (personal & external, TRUSTEE), (direct & overseas, OVERSEAS), (personal & ~direct & overseas, OVERSEAS[:1]), (at_least(level, "D4"), SENSITIVE), (flagged("employee_survey"), EMPLOYEE),
        (~flagged("employee_survey") & yes(claims_anonymous), EMPLOYEE[:1]), (flagged("event_prize"), PRIZE), (flagged("marketing"), MARKETING), (flagged("public_agency"), PUBLIC),
    ]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*[F.when(c, F.array(*[F.lit(x) for x in keys])).otherwise(none) for c, keys in sets])))


WEAK_CONSENT = r"^(동의|동의함|동의합니다|예|네|확인)[.!]?$"


def notice_status(text: Column, words: Sequence[str], least: int = 8) -> Column:
    """``missing`` without a meaningful text, ``unclear`` without one of the words, else ``present``."""
    bare = F.trim(F.coalesce(text, F.lit("")))
    return first_match([((F.length(bare) < least) | bare.rlike(WEAK_CONSENT), "missing"), (~any_contains(F.lower(bare), [w.lower() for w in words]), "unclear")], "present")


def gap_severity(key: Column, status: Column, level: Column) -> Column:
    """How bad it is that a duty isn't met."""
    missing, core = status == "missing", key.isin(*CORE)
    far = F.startswith(key, F.lit("trustee")) | F.startswith(key, F.lit("overseas"))
    by = lambda a, b: F.when(missing, a).otherwise(b)
    return first_match([
        (status == "present", F.lit("info")), (F.startswith(key, F.lit("sensitive_")) | (key == "overseas_transfer"), by("critical", "high")), (at_least(level, "D3") & (core | far), by("high", "medium")),
        ((level == "D2") & core, by("medium", "low")), ((level == "D2") & far, F.lit("medium")), (level == "D2", F.lit("low")),
    ], by("medium", "low"))


def notice_fact(blocks: Column, full: Column, confirmed: str, possible: str, least: int = 10) -> Column:
    """How sure it is that a form tells something: a block says it, a longer block may, the whole text says it, it may, or nothing."""
    return first_match([
        (F.exists(blocks, lambda b: b.rlike(confirmed)), "FOUND_CONFIRMED"), (F.exists(blocks, lambda b: b.rlike(possible) & (F.length(b) >= least)), "FOUND_POSSIBLE"),
        (full.rlike(confirmed), "FOUND_CONFIRMED"), (full.rlike(possible), "NEEDS_REVIEW"),
    ], "NOT_FOUND")


def management_checks(values: Mapping[str, Column], enabled: Mapping[str, Column], weight: float = 1.5, most: int = 15) -> Column:
    """checks (name, status) of the enabled signs, and the deduction: a false one costs ``weight``, an unknown one half of it, ``most`` in all."""
    status = lambda v: F.when(v, "confirmed").when(~v, "missing").otherwise("unknown")
    listed = F.array_compact(F.array(*[F.when(yes(enabled.get(n, F.lit(True))), F.struct(F.lit(n).alias("name"), status(v).alias("status"))) for n, v in values.items()]))
    costs = F.aggregate(listed, F.lit(0.0), lambda s, x: s + F.when(x["status"] == "missing", weight).when(x["status"] == "unknown", weight / 2).otherwise(0.0))
    return F.struct(listed.alias("checks"), F.least(F.lit(float(most)), half_up(costs)).alias("deduction"))


def override_rules(level: Column, tool: Column, flags: Column, gaps: Column, hints: Mapping[str, Column]) -> dict[str, tuple[str, Column]]:
    """Each of the fourteen rules by name: the grade a form gets at least, and when.

    ``gaps`` are the duties not met; ``hints`` may name claims_anonymous, identifier_questions,
    employee_sensitive, quasi_questions, identity_file, trustee_disclosed, domestic_storage and
    publicly_verified.
    """
    hint = lambda name: yes(hints[name]) if name in hints else F.lit(False)
    gap = lambda name: yes(F.array_contains(gaps, name))
    flagged = lambda name: yes(F.array_contains(flags, name))
    direct, sensitive = at_least(level, "D3"), at_least(level, "D4")
    external, overseas, public = yes(tool.isin("domestic_saas", "overseas_saas")), yes(tool == "overseas_saas"), flagged("public_agency")
    return {
        "sensitive_no_consent": (HIGH, sensitive & gap("sensitive_consent")), "unique_identifier": (HIGH, yes(level == "D5") | hint("identity_file")), "public_external_sensitive": (HIGH, public & external & sensitive),
        "public_google_overseas": (HIGH, public & overseas & direct & gap("overseas_transfer")), "employee_sensitive_identifiable": (HIGH, flagged("employee_survey") & hint("employee_sensitive") & hint("quasi_questions")),
        "anonymous_contradiction": (HIGH, hint("claims_anonymous") & hint("identifier_questions")), "no_retention": (RISK, direct & gap("retention_period")), "no_items": (RISK, direct & gap("collection_items")),
        "no_purpose": (RISK, direct & gap("collection_purpose")), "saas_no_trustee": (RISK, direct & external & gap("trustee") & ~hint("trustee_disclosed")),
        "overseas_no_notice": (RISK, direct & overseas & gap("overseas_transfer") & ~hint("domestic_storage")), "event_no_destruction": (RISK, flagged("event_prize") & direct & gap("prize_destruction")),
        "public_no_csap": (RISK, public & external & direct & gap("public_csap_verification") & ~hint("publicly_verified")), "marketing_no_consent": (RISK, flagged("marketing") & gap("marketing_optional_consent")),
    }


def overrides(rules: Mapping[str, tuple[str, Column]]) -> Column:
    """ids of the rules that hold, and the worst grade they ask for, null for none."""
    ids = matched_names({name: c for name, (_, c) in rules.items()})
    any_of = lambda grade: F.exists(F.array(*[c for g, c in rules.values() if g == grade]), lambda x: x)
    return F.struct(ids.alias("ids"), first_match([(any_of(HIGH), HIGH), (any_of(RISK), RISK)]).alias("grade"))


def partial_cap(grade: Column, score: Column, partial: Column, generic: Column) -> Column:
    """grade and score of a form that was read in part on an unknown platform: never worse than caution, never below 60."""
    capped = yes(partial) & yes(generic) & grade.isin(RISK, HIGH)
    return F.struct(F.when(capped, "caution").otherwise(grade).alias("grade"), F.when(capped, F.greatest(score, F.lit(60.0))).otherwise(score).alias("score"))
