"""How a form's notices meet each of its duties: a registry of where a duty is told and by which words, then facts, hints and care taken elsewhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import any_contains, first_match
from tidemark.operators.obligations import WEAK_CONSENT, yes


@dataclass(frozen=True)
class Told:
    """The fields in which a duty is told, the first that is there, with the whole of the form's texts or alone; words of which one must be there."""

    fields: Sequence[str]
    everywhere: bool
    words: Sequence[str]
    least: int = 8


# For each duty where it is told and by which words.
REGISTRY = {
    "collection_purpose": Told(("purpose", "privacy_notice"), True, ("수집 목적", "수집·이용 목적", "이용 목적", "활용 목적", "처리 목적", "조사 목적", "경품 지급", "목적")),
    "collection_items": Told(("items", "privacy_notice"), True, ("수집 항목", "개인정보 항목", "처리 항목", "성명", "이름", "휴대폰", "연락처", "이메일", "항목")),
    "retention_period": Told(("retention",), True, ("보유기간", "보유·이용 기간", "이용기간", "보관기간", "행사 종료", "조사 종료", "경품 발송 완료", "목적 달성", "보유", "기간")),
    "consent_refusal_right": Told(("refusal_right",), True, ("동의 거부", "거부권", "거부할 권리", "거부 시", "거부", "거절", "동의하지 않을", "동의하지 않으실", "미동의")),
    "refusal_disadvantage": Told(("refusal_disadvantage",), True, ("불이익", "제한", "경품지급 제한", "경품 지급 제한", "서비스 이용 제한")), "destruction_timing": Told(("destruction",), True, ("파기", "삭제", "폐기", "지체없이", "즉시 파기")),
    "processor_contact": Told(("contact_department", "processor"), True, ("담당부서", "담당자", "문의처", "개인정보 보호책임자", "개인정보 담당자", "처리자")), "trustee": Told(("trustee",), True, ("수탁자", "위탁업무", "처리위탁", "위탁")),
    "trustee_task": Told(("trustee_task", "trustee"), True, ("위탁 업무", "처리 업무", "위탁업무", "보관", "파기")), "trustee_oversight": Told(("trustee", "privacy_notice"), True, ("관리", "감독", "계약", "수탁")),
    "overseas_transfer": Told(("overseas_transfer",), True, ("국외이전", "국외 보관", "해외 이전", "해외 보관", "이전 국가")), "overseas_items": Told(("overseas_transfer",), False, ("항목", "이전", "개인정보")),
    "overseas_country": Told(("overseas_country", "overseas_transfer"), False, ("국가", "미국", "해외")), "overseas_recipient": Told(("overseas_recipient", "overseas_transfer"), False, ("이전받", "수령", "google", "구글")), "overseas_purpose": Told(("overseas_transfer",), False, ("목적", "이용")),
    "overseas_retention": Told(("overseas_transfer", "retention"), False, ("보유", "기간")), "overseas_refusal": Told(("overseas_transfer", "refusal_right"), False, ("거부", "동의", "근거")), "sensitive_consent": Told(("sensitive_consent", "consent_text"), False, ("민감", "별도", "동의")),
    "sensitive_legal_basis": Told(("privacy_notice",), False, ("근거", "법령", "필요")), "sensitive_access_control": Told(("privacy_notice",), False, ("접근", "권한", "제한")), "anonymity_standard": Told(("anonymity",), False, ("익명", "특정", "식별")), "raw_data_scope": Told(("raw_data_scope",), False, ("원자료", "제공", "범위")),
    "no_disadvantage": Told(("anonymity", "privacy_notice"), False, ("불이익", "인사", "징계")), "small_group_privacy": Told(("small_group_privacy",), False, ("소수", "통계", "비공개")), "prize_limited_collection": Told(("purpose", "privacy_notice"), False, ("당첨", "경품", "한정")),
    "prize_destruction": Told(("prize_destruction", "destruction"), False, ("파기", "경품", "발송 후")), "prize_data_separation": Told(("prize_separation",), False, ("분리", "경품", "응답")), "marketing_optional_consent": Told(("marketing_consent",), False, ("마케팅", "선택", "동의")),
    "marketing_opt_out": Told(("marketing_opt_out",), False, ("수신거부", "거부", "광고")), "public_csap_verification": Told(("privacy_notice", "description"), False, ("csap", "보안검증", "인증")), "public_official_account": Told(("description",), False, ("공식", "기관", "계정")),
    "privacy_policy_link": Told(("privacy_policy_url",), False, ("http", "privacy", "처리방침"), 5), "contact_department": Told(("contact_department",), True, ("담당부서", "문의처", "개인정보 보호책임자", "담당자")), "result_disclosure_prevention": Told(("privacy_notice",), True, ("공개", "방지", "비공개")),
    "purpose_destruction": Told(("destruction", "retention"), True, ("파기", "목적 달성", "지체없이")),
}
PURPOSE_HINT = r"보다\s*나은\s*서비스\s*제공|관람객\s*의견\s*수렴|기초자료|서비스\s*개선|전시\s*개선|시설\s*개선|통계(적인)?\s*분석|만족도\s*조사"
CONSENTED, TRUSTEE = ("collection_purpose", "collection_items", "retention_period"), ("trustee", "trustee_task", "trustee_oversight")


def meaningful(text: Column, least: int = 8) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(bare) >= least) & ~bare.rlike(WEAK_CONSENT)


def by_words(notices: Column, corpus: Column, told: Told) -> Column:
    """missing, unclear or present, by the duty's fields and words alone."""
    of = lambda name: F.try_element_at(notices, F.lit(name))
    own = F.coalesce(*[of(f) for f in told.fields]) if len(told.fields) > 1 else of(told.fields[0])
    text = own
    if told.everywhere:
        text = first_match([(meaningful(own), F.concat(own, F.lit("\n"), F.coalesce(corpus, F.lit("")))), (meaningful(corpus), corpus)], own)
    return first_match([(~meaningful(text, told.least), "missing"), (any_contains(F.lower(text), [w.lower() for w in told.words]), "present")], "unclear")


def evaluate_notices(forms: DataFrame, key: str) -> DataFrame:
    """key, duty and status: present, unclear or missing for each duty of each form.

    ``forms`` has duties (an array of names), notices (a map of field to text), corpus (all that
    the form says), facts (a map of duty to how sure it is that the form tells it), has_consent, n_questions,
    domestic_storage, csap_verified and trustee_disclosed.  A fact that is confirmed makes a duty
    present, a possible one unclear; consent by a mere button leaves the first duties missing
    unless a fact is there; a hint at the purpose, or questions themselves, make missing ones unclear;
    domestic storage on a verified tool settles what concerns other countries, a named trustee what concerns trustees.

    Null maps and texts tell nothing; forms without duties have no rows; unknown duties are missing.
    """
    rows = forms.withColumn("duty", F.explode("duties"))
    duty, of = F.col("duty"), lambda name: F.try_element_at("notices", F.lit(name))
    plain = first_match([(duty == name, by_words(F.col("notices"), F.col("corpus"), told)) for name, told in REGISTRY.items()], F.lit("missing"))
    rows = rows.withColumn("_s", plain).withColumn("_f", F.try_element_at("facts", duty))
    s, fact = F.col("_s"), F.col("_f")
    rows = rows.withColumn("_s", first_match([(fact == "FOUND_CONFIRMED", F.lit("present")), (((fact == "FOUND_POSSIBLE") & (s != "present")) | ((fact == "NEEDS_REVIEW") & (s == "missing")), F.lit("unclear"))], s))
    button = meaningful(of("consent_text"), 2) & ~meaningful(of("privacy_notice"), 15) & ~yes(F.col("has_consent"))
    rows = rows.withColumn("_s", F.when(button & duty.isin(*CONSENTED) & ~yes(fact.isin("FOUND_CONFIRMED", "FOUND_POSSIBLE")), "missing").otherwise(s))
    softer = ((duty == "collection_purpose") & yes(F.col("corpus").rlike(PURPOSE_HINT))) | ((duty == "collection_items") & yes(F.col("n_questions") > 0))
    status = first_match([
        (duty.startswith("overseas_") & yes(F.col("domestic_storage")) & yes(F.col("csap_verified")), F.lit("present")), (duty.isin(*TRUSTEE) & yes(F.col("trustee_disclosed")), F.lit("present")), ((s == "missing") & softer, F.lit("unclear")),
    ], s)
    return rows.select(key, "duty", status.alias("status"))
