"""What a question asks for: categories by ordered pattern sets, their suppression, and the level that follows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rules import any_contains, bound, first_match, pattern_names
from tidemark.functions.text import collapse_spaces
from tidemark.operators.diagnosis import LEVEL_WORDS

# Patterns of health questions, and of each category in order.
HEALTH = r"현재\s*건강\s*상태|건강\s*상태|앓고\s*있는\s*질병|질환명|병력|진료\s*이력|치료\s*이력|복용\s*약|장애\s*(?:여부|유형|등급)|정신\s*건강\s*상태|우울|불안|자살\s*생각|상담\s*치료\s*이력|건강검진\s*결과|의료기관\s*이용\s*이력"
CATEGORIES: Mapping[str, str] = {
    "name": r"이름|성명|성함|신청자명|담당자명", "phone": r"휴대\s*전화|휴대폰|핸드폰|전화번호|연락처|(?i:\btel\b)", "email": r"이메일|(?i:e-?mail)|(?<!메일\s)메일(?!링)",
    "address": r"(?<!이메일\s)(?<!(?i:mail)\s)주소(?!지)|상세주소|도로명주소|지번주소|배송지|우편번호", "birthdate": r"생년월일|생일|출생연도", "affiliation": r"회사명|기관명|학교명|소속",
    "department": r"부서|팀", "position": r"직급|직책|직군", "tenure": r"근속\s*연수|근속\s*기간|근무\s*연수|재직\s*기간", "organization_identifier": r"사번",
    "gender": r"성별|(?:^|[^가-힣])남자(?:[^가-힣]|$)|(?:^|[^가-힣])여자(?:[^가-힣]|$)|남성|여성|남\s*[·∙･/]\s*여", "child_age_range": r"자녀.*연령|자녀.*나이|아이.*연령|아이.*나이|(?:영아|유아|아동)\s*(?:선택|해당|구분|연령|나이)|어린이\s*연령대",
    "respondent_age": r"귀하.*연령|귀하.*나이|만\s*나이|^\(?\d+\)?\s*연령|^연령\s*$", "age_range": r"연령대|나이대|연령|나이", "residence_area": r"거주\s*권역|거주지|거주지역|관내|인접\s*시군|타지역|시\s*/\s*군|시군구",
    "sensitive_health": HEALTH, "sensitive_belief_union": r"노조\s*가입|노동조합\s*가입|사상|신념", "sensitive_political": r"정당\s*가입|정치적\s*견해|정치\s*성향", "sensitive_religion": r"종교|신앙",
    "sensitive_complaint": r"성희롱|성폭력|괴롭힘|갑질|직장\s*내\s*고충|고충|징계|인사평가|상사평가", "resident_registration_number": r"주민등록번호|주민번호", "passport_number": r"여권번호", "driver_license_number": r"운전면허번호",
    "foreign_registration_number": r"외국인등록번호", "id_document": r"신분증|학생증|사원증", "financial_account": r"계좌번호|예금주|은행", "authentication_secret": r"비밀번호|인증번호",
}
# Categories of direct identifiers, the levels of categories, and the kinds of opinion in order.
DIRECT = ("name", "phone", "email", "address", "birthdate", "resident_registration_number", "passport_number", "driver_license_number", "foreign_registration_number", "id_document", "financial_account", "authentication_secret")
LEVELS: Mapping[str, Sequence[str]] = {
    "D5": ("resident_registration_number", "passport_number", "driver_license_number", "foreign_registration_number", "id_document", "financial_account", "authentication_secret"),
    "D4": ("sensitive_health", "sensitive_belief_union", "sensitive_complaint", "sensitive_political", "sensitive_religion"), "D3": ("name", "phone", "email", "address", "birthdate"),
    "D2": ("affiliation", "organization_identifier", "gender", "respondent_age", "age_range", "child_age_range", "residence_area", "department", "position", "tenure"),
}
OPINIONS: Mapping[str, str] = {
    "program_preference": r"선호.*프로그램.*주제|바라.*프로그램.*주제|선호(?:하는)?\s*(?:프로그램|주제|분야|강좌)|바라(?:는)?\s*(?:프로그램|주제|분야|강좌)|관심(?:\s*있는)?\s*(?:프로그램|주제|분야|강좌)|(?:프로그램|강좌).*(?:관심|선호|희망)|희망(?:하는)?\s*(?:프로그램|주제|분야|강좌)|희망.*(?:교육|강좌).*주제|(?:교육|강좌|도서관|문화|관광|여가|복지|건강|심리|상담|독서|취미|가족|육아|운동|체육)\s*(?:프로그램|주제|분야|강좌)|프로그램\s*(?:주제|선호|관심|희망)|향후\s*전시\s*주제|향후\s*기획.*주제|전시\s*주제",
    "policy_opinion": r"정책\s*방향|추진해야\s*할\s*방향|역할\s*확대\s*방향|지역\s*사회.*문제|가장\s*시급한.*문제|공공\s*데이터.*활용|활용성이\s*높은", "general_opinion": r"관람객\s*의견\s*수렴|자유\s*의견|기타\s*의견",
    "service_feedback": r"서비스\s*개선\s*방향|서비스\s*개선|바라는\s*점|의견|제안|건의", "visit_purpose": r"이용\s*목적|방문\s*목적|이용\s*횟수|방문\s*횟수|방문\s*경로|관람\s*방식", "satisfaction": r"만족도|추천\s*의향|만족(?:한)?\s*점",
    "improvement_opinion": r"불편\s*사항|개선\s*사항|개선되어야\s*할\s*점", "preference": r"기억에\s*남는\s*전시물|전시\s*이해.*도움",
}
EXCLUDED = r"(?:이용|방문|주된|서비스)\s*목적|만족도|추천\s*의향|이용\s*경험|불편\s*사항|개선\s*사항"
SOLICITED = r"(이름|성명|성함|연락처|주소|전화번호|이메일|휴대폰|핸드폰).*(적어|입력|기재|작성|남겨)"
#: Categories that give way where another one is found.
GIVE_WAY = {"respondent_age": ("child_age_range",), "age_range": ("child_age_range", "respondent_age")}


def detect_categories(text: Column) -> Column:
    """The categories of a question: those whose patterns match, less the ones that give way; without a direct identifier the first kind of opinion takes their place.

    Texts, what is found and the opinion are bound, so each pattern is tried once for a row.
    """
    names = lambda xs: F.array(*[F.lit(x) for x in xs])

    def of(text: Column, plain: Column) -> Column:
        gone = lambda found: F.array_compact(F.array(*[F.when(F.arrays_overlap(found, names(over)), F.lit(name)) for name, over in GIVE_WAY.items()]))
        opinion = first_match([(plain.rlike(pattern), F.lit(name)) for name, pattern in OPINIONS.items()], F.when(plain.rlike(EXCLUDED) & ~plain.rlike(SOLICITED), F.lit("general_opinion")))
        direct = lambda left: F.arrays_overlap(left, names(DIRECT)) | plain.rlike(SOLICITED)
        chosen = lambda left: bound(opinion, lambda o: F.when(direct(left) | o.isNull(), left).otherwise(F.array(o)))
        return bound(pattern_names(text, CATEGORIES), lambda found: bound(F.array_except(found, gone(found)), chosen))

    return bound(text, lambda t: bound(collapse_spaces(t), lambda plain: of(t, plain)))


def level_of(categories: Column) -> Column:
    """The highest level that one of the categories has, D1 for none."""
    return bound(categories, lambda own: first_match([(F.arrays_overlap(own, F.array(*[F.lit(x) for x in names])), level) for level, names in LEVELS.items()], "D1"))


def opinion_question(text: Column) -> Column:
    return collapse_spaces(text).rlike("|".join(OPINIONS.values()))


def full_question_level(label: Column, auxiliary: Column, kind: Column, has_personal: Column) -> Column:
    """Level of a question from its opinions, categories, files, requests and words, in that order."""
    personal = F.coalesce(has_personal, F.lit(False))

    def of(label: Column, both: Column, plain: Column, found: Column) -> Column:
        low, own = F.lower(both), collapse_spaces(label)
        excluded = own.rlike(EXCLUDED) & ~own.rlike(SOLICITED)
        opinion = plain.rlike("|".join(OPINIONS.values()))
        health = ~opinion & plain.rlike(HEALTH)
        return first_match([
            (excluded | opinion, F.lit("D1")), (F.size(found) > 0, level_of(found)), (kind.isin("file", "file_upload") & both.rlike("신분증|id|주민"), F.lit("D5")), (plain.rlike(SOLICITED), F.lit("D3")),
            (any_contains(low, LEVEL_WORDS["D5"]), F.lit("D5")), (health | any_contains(low, LEVEL_WORDS["D4"]), F.lit("D4")), (any_contains(low, LEVEL_WORDS["D3"]), F.lit("D3")), (any_contains(low, LEVEL_WORDS["D2"]), F.lit("D2")),
            (kind.isin("long_text", "short_text") & ~personal, F.lit("D1")), (personal, F.lit("D2")),
        ], F.lit("D1"))

    with_both = lambda l: F.trim(F.concat_ws(" ", l, F.coalesce(auxiliary, F.lit(""))))
    return bound(F.coalesce(label, F.lit("")), lambda l: bound(with_both(l), lambda both: bound(collapse_spaces(both), lambda plain: bound(detect_categories(both), lambda found: of(l, both, plain, found)))))
