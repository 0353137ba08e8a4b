"""How good what was found is: the kind of an organization, what a form lacks, whose turn a query is, and whether a quick reading will do."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match, matched_names

# Words by which organizations are told apart.
ACADEMIC = "논문|석사|박사|학위|졸업작품|연구\\s*참여자|연구대상자|대학원생|개인\\s*연구|과제\\s*설문|졸업\\s*논문|지도교수"
UNIVERSITY = "산학협력단|대학\\s*본부|학생지원|입학처|경력개발|교무처|연구처|공식\\s*센터|사업단|평생교육원"
PUBLIC = "공공기관|공기업|지방공기업|지자체|시청|군청|구청|도청|교육청|공단|공사|진흥원|재단|위원회|보건소|복지관|체육회|관광재단|문화재단|산하기관|정부|행정복지"
COMPANY = "(?i)기업|주식회사|㈜|\\(주\\)|브랜드|프랜차이즈|쇼핑몰|이벤트\\s*응모|경품|고객\\s*만족|CSAT|금융|은행|카드사|회원\\s*모집"


def org_quality(text: Column) -> Column:
    """public, company, university_official, individual_or_academic or unknown, from all that is said of a form; private research comes first unless a university's own office is named."""
    university = text.rlike(UNIVERSITY)
    return first_match([(text.rlike(ACADEMIC) & ~university, "individual_or_academic"), (university, "university_official"), (text.rlike(PUBLIC), "public"), (text.rlike(COMPANY), "company")], "unknown")


# What a form can lack, by the words that say so, in order.
GAP_HINTS: Mapping[str, str] = {
    "고지문 미흡": "고지", "수집 목적 미흡": "목적", "수집 항목 미흡": "항목", "보유기간 미흡": "보유", "파기 기준 미흡": "파기", "담당자 연락처 미흡": "연락처|담당자", "외부 설문도구·위탁 안내 미흡": "위탁|외부", "국외이전 확인 필요": "국외",
    "공공부문 외부도구·CSAP 확인 필요": "CSAP|클라우드",
}
REFUSED, PUBLIC_TOOL = "응답 거부·신고 검토 판단", "공공부문 외부도구·CSAP 확인 필요"
INCLUDED = {"personal": "개인정보 포함", "sensitive": "민감정보 포함", "high": "고위험정보 포함"}
PUBLIC_TYPES, TOOLS = ("public", "공공", "public_agency"), "google|naver|moa|microsoft"


def improvement_gaps(personal: Column, sensitive: Column, high: Column, decision: Column, kind: Column, platform: Column, labels: Column) -> Column:
    """What a form should improve, each once: what it collects, a decision against answering, what the decision's words lack, then each label's, then a public body's outside tool."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    said = F.coalesce(decision, F.lit(""))
    included = matched_names({name: yes(c) for name, c in zip(INCLUDED.values(), (personal, sensitive, high), strict=True)} | {REFUSED: said.rlike("응답 거부|신고 검토|REPORT_OR_INQUIRE|DO_NOT_RESPOND")})
    hinted = lambda t: matched_names({label: t.rlike(p) for label, p in GAP_HINTS.items()})
    by_label = F.flatten(F.transform(F.coalesce(labels, F.array().cast("array<string>")), hinted))
    outside = matched_names({PUBLIC_TOOL: yes(kind.isin(*PUBLIC_TYPES)) & yes(F.lower(platform).rlike(TOOLS))})
    return F.array_distinct(F.concat(included, hinted(said), by_label, outside))


# Platforms that the first half of the searches looks for by date.
DATED_PLATFORMS = ("forms.gle", "docs.google.com/forms", "form.naver.com", "naver.me")


def partition(intent: Column, platform: Column, strategy: Column) -> Column:
    """a or b: which half of the searches a query belongs to; companies, one platform and mixed relevance go to b first."""
    return first_match([
        (intent.isin("company", "platform_focus") | (platform == "moaform.com/q") | (strategy.isin("sim_relevance", "deep_seed") & (intent == "mixed")), "b"),
        (intent.isin("public", "university_official") | ((strategy == "date_breadth") & platform.isin(*DATED_PLATFORMS)), "a"),
    ], "b")


def parsed_partition(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit("all"))))
    return first_match([(low.isin("a", "partition_a", "part-a"), "a"), (low.isin("b", "partition_b", "part-b"), "b")], "all")


HIGH_RISK = "resident_registration|passport|driver_license|foreign_registration|financial_account|authentication_secret|unique_identifier|id_document"


def reading_gate(fast: Mapping[str, Column], baseline: Mapping[str, Column]) -> Column:
    """accept, reason and reasons: whether a quick reading of a form may stand, or a browser must read it again, and why.

    ``fast`` has final (closed or private, which no browser changes), ok, confidence, questions (an array of
    structs with label, options, personal and categories), more_pages, branching, privacy_likely and
    notice; ``baseline`` may have the questions, personal, sensitive and high that were found before.
    """
    asked = F.coalesce(fast["questions"], F.array().cast(QUESTION))
    n, sure = F.size(asked), F.coalesce(fast["confidence"] == "high", F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    of = lambda p: F.size(F.filter(asked, p))
    odd = of(lambda q: (F.length(F.trim(F.coalesce(q["label"], F.lit("")))) < 2) & (F.length(F.array_join(q["options"], "")) > 10))
    has = lambda pattern: of(lambda q: F.exists(q["categories"], lambda c: c.rlike(pattern)))
    now = {"personal": of(lambda q: yes(q["personal"])), "sensitive": has("^sensitive_"), "high": has(HIGH_RISK)}
    fewer = F.lit(False)
    for name, found in now.items():
        if name in baseline:
            fewer = fewer | (yes(baseline[name] > 0) & yes(found < baseline[name]))
    before = baseline.get("questions", F.lit(None).cast("int"))
    reasons = matched_names({
        "zero_questions": ~yes(fast["ok"]) | (n == 0), "low_confidence": yes(fast["confidence"].isin("low", "none")), "multi_page_signal": yes(fast["more_pages"]) & ~sure, "branching_signal": yes(fast["branching"]) & ~sure,
        "missing_privacy_notice": yes(fast["privacy_likely"]) & fast["notice"].isNull(), "invalid_structure": (n > 0) & (odd * 2 >= n), "question_count_drop": yes(before > 0) & yes(n < F.greatest(F.lit(1), F.floor(before * 0.6))), "risk_detection_drop": fewer,
    })
    told = F.when(yes(fast["final"]), F.array().cast("array<string>")).otherwise(reasons)
    return F.struct((F.size(told) == 0).alias("accept"), F.get(told, F.lit(0)).alias("reason"), told.alias("reasons"))


QUESTION = "array<struct<label:string,options:array<string>,personal:boolean,categories:array<string>>>"
