from tidemark.operators.diagnosis import form_levels, score_forms

QUESTIONS = "form_id long, label string, kind string, has_personal boolean"
FORMS = "form_id long, tool_level string, mitigated boolean, public_sector boolean, partial boolean, claims_anonymous boolean, gaps array<string>, weighted_gaps double, management_missing int, management_unknown int"


def test_levels_scores_and_overrides(spark):
    questions = spark.createDataFrame(
        [(1, "성명", "short_text", False), (1, "의견", "long_text", False), (2, "연령대", "choice", None), (3, "주민등록번호 앞자리", "short_text", True), (4, "의견", "long_text", None), (5, "종교", "choice", True), (6, None, None, True)],
        QUESTIONS,
    )
    levels = {r.form_id: (r.data_level, r.n_personal) for r in form_levels(questions).collect()}
    assert levels == {1: ("D3", 1), 2: ("D2", 1), 3: ("D5", 0), 4: ("D1", 0), 5: ("D4", 0), 6: ("D2", 1)}
    forms = spark.createDataFrame(
        [
            (1, "overseas_saas", None, None, None, None, ["retention_period"], 1.0, 2, 1), (2, "domestic_saas", True, True, None, None, [], 0.0, 0, 0), (3, "domestic_saas", None, None, None, None, None, None, None, None),
            (4, "csap_verified", None, None, None, None, [], 0.0, 0, 0), (5, "overseas_saas", None, True, None, None, ["sensitive_consent", "x"], 1.5, 20, 0), (7, "unheard", None, None, None, True, None, None, None, None),
        ],
        FORMS,
    )
    got = {r.form_id: r for r in score_forms(forms, questions).collect()}
    assert got[1].score == 100 - 20 - 18 - 30 - 3.75 and got[1].score_grade == "high_risk" and got[1].overrides == ["no_retention"] and got[1].final_grade == "high_risk"
    assert got[2].score == 80.0 and got[2].final_grade == "safe" and got[2].tool_deduction == 0
    assert got[3].score == 57.0 and got[3].score_grade == "risk" and got[3].overrides == ["unique_identifier"] and got[3].final_grade == "high_risk"
    assert got[4].score == 97.0 and got[4].final_grade == "safe"
    assert got[5].notice_deduction == 23.0 and got[5].management_deduction == 15.0 and got[5].overrides == ["sensitive_no_consent", "public_external_sensitive"]
    assert got[7].data_level == "D0" and got[7].score == 100.0 and got[7].final_grade == "safe"
