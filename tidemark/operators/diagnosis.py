"""Diagnosis of forms: level of each question, of the form and its tool, deductions, overrides and the final grade."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp, grade, half_up, lookup
from tidemark.functions.rules import any_contains, first_match, worst
from tidemark.operators.obligations import override_rules, overrides

# Words of a question that tell the level of what it asks for, highest level first.
LEVEL_WORDS: Mapping[str, Sequence[str]] = {
    "D5": ("주민등록번호", "여권", "운전면허", "외국인등록", "신분증", "학생증", "사원증", "계좌", "통장", "비밀번호", "인증번호"),
    "D4": ("질병", "질환명", "병력", "진료 이력", "치료 이력", "복용약", "장애 여부", "장애유형", "장애등급", "정신건강 상태", "우울", "불안", "자살 생각", "건강검진 결과", "의료기관 이용 이력", "정치", "종교", "노조", "성희롱", "괴롭힘", "갑질", "징계", "인사평가", "상사평가", "직장 내 고충"),
    "D3": ("이름", "성명", "휴대", "전화", "이메일", "상세주소", "도로명", "지번주소", "배송지", "우편번호", "생년", "연락처"),
    "D2": ("성별", "연령", "나이", "연령대", "거주지", "거주지역", "시군", "시/군", "지역"),
}
# Points lost by level of data and of tool, and the greatest loss by notices and management.
DATA_POINTS = {"D0": 0, "D1": 3, "D2": 10, "D3": 20, "D4": 28, "D5": 35}
TOOL_POINTS = {"csap_verified": 0, "self_hosted": 3, "domestic_saas": 8, "overseas_saas": 18, "generic_limited": 12}
MITIGATION, NOTICE_MOST, NOTICE_MOST_QUASI, MANAGEMENT_MOST, MANAGEMENT_MOST_QUASI = 8, 30, 18, 15, 8
GRADES = ("safe", "caution", "risk", "high_risk")


def question_level(label: Column, kind: Column, has_personal: Column, words: Mapping[str, Sequence[str]] = LEVEL_WORDS) -> Column:
    """Level D1 to D5 of one question by the first set of words that it holds; free text without personal data is D1."""
    text = F.lower(F.coalesce(label, F.lit("")))
    named = [(any_contains(text, values), level) for level, values in words.items()]
    free = kind.isin("long_text", "short_text") & ~F.coalesce(has_personal, F.lit(False))
    return first_match([*named, (free, "D1"), (has_personal, "D2")], "D1")


def form_levels(questions: DataFrame) -> DataFrame:
    """form_id, data_level and the number of questions by kind of risk, of ``questions`` (form_id, label, kind, has_personal)."""
    rows = questions.select("form_id", question_level(F.col("label"), F.col("kind"), F.col("has_personal")).alias("level"))
    many = lambda *levels: F.count_if(F.col("level").isin(*levels))
    return rows.groupBy("form_id").agg(F.max("level").alias("data_level"), F.count("*").alias("n_questions"), many("D2", "D3").alias("n_personal"), many("D4").alias("n_sensitive"), many("D5").alias("n_high_risk"))


def score_forms(forms: DataFrame, questions: DataFrame) -> DataFrame:
    """``forms`` with deductions, score, score_grade, overrides and final_grade.

    ``forms`` has form_id, tool_level, mitigated, public_sector, partial, claims_anonymous,
    gaps (an array of obligations not met), weighted_gaps, management_missing,
    management_unknown and, if it likes, flags of its context.  Forms without questions have level D0.  Nulls count as false, as no
    gap or as 0; an unknown tool level loses nothing.
    """
    rows = forms.join(form_levels(questions), "form_id", "left").withColumn("data_level", F.coalesce("data_level", F.lit("D0")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    level, tool = F.col("data_level"), F.col("tool_level")
    direct, quasi = level.isin("D3", "D4", "D5"), level == "D2"
    gaps = F.coalesce("gaps", F.array().cast("array<string>"))
    weighted = F.coalesce(F.col("weighted_gaps").cast("double"), F.lit(0.0))
    most = F.when(direct, float(NOTICE_MOST)).otherwise(float(NOTICE_MOST_QUASI))
    base = F.greatest(F.size(gaps).cast("double"), weighted, F.lit(1.0))
    managed = 1.5 * F.coalesce(F.col("management_missing"), F.lit(0)) + 0.75 * F.coalesce(F.col("management_unknown"), F.lit(0))
    rows = rows.withColumns({
        "data_deduction": lookup(level, DATA_POINTS, 0),
        "tool_deduction": F.greatest(F.lit(0), lookup(tool, TOOL_POINTS, 0) - F.when(yes("mitigated"), MITIGATION).otherwise(0)),
        "notice_deduction": F.least(most, half_up(weighted / base * most)),
        "management_deduction": F.least(F.when(quasi, float(MANAGEMENT_MOST_QUASI)).otherwise(float(MANAGEMENT_MOST)), managed.cast("double")),
    })
    raw = 100.0 - F.col("data_deduction") - F.col("tool_deduction") - F.col("notice_deduction") - F.col("management_deduction")
    score = clamp(raw, 0.0, 100.0)
    score = F.when(yes("partial") & quasi & ~yes("public_sector"), F.greatest(score, F.lit(60.0))).otherwise(score)
    score = first_match([(quasi & yes("public_sector"), clamp(score, 70.0, 80.0)), (quasi, F.least(score, F.lit(75.0)))], score)
    rows = rows.withColumn("score", score).withColumn("score_grade", grade(F.col("score")))
    flags = F.coalesce(F.col("flags"), F.array().cast("array<string>")) if "flags" in forms.columns else F.array().cast("array<string>")
    flags = F.when(yes("public_sector"), F.array_append(flags, F.lit("public_agency"))).otherwise(flags)
    told = overrides(override_rules(level, tool, flags, gaps, {"claims_anonymous": F.col("claims_anonymous"), "identifier_questions": direct}))
    rows = rows.withColumn("_told", told)
    final = worst([F.col("score_grade"), F.col("_told.grade")], GRADES)
    return rows.withColumn("overrides", F.col("_told.ids")).withColumn("final_grade", final).drop("_told")
