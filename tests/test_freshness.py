import datetime as dt

from tidemark.operators.freshness import evaluate_freshness, triage

TODAY = "2026-06-15"
FORMS = "id long, title string, snippet string, page_text string, url string, published_on date, live boolean"


def test_ordered_outcomes(spark):
    day = dt.date(2026, 6, 1)
    cases = [
        ("closed_url", "Open 2026-07-01", None, None, "https://f.example/closedform", day, True), ("closed_phrase", "This survey has ended", None, None, "https://f.example/1", day, True),
        ("restricted_phrase", "Form", "members only", None, None, day, None), ("personal_research", "My thesis 2026-07-01", None, None, None, day, None), ("previous_year_phrase", "last year's survey", None, None, None, day, None),
        ("end_date_passed", "2026.5.1 ~ 2026.6.14", None, None, None, day, None), ("start_date_future", "from 2026-08-01 to 2026-09-31", None, None, None, None, None), ("stale_topic_year", "results of 2024", None, None, None, None, None),
        ("stale_year", "survey 2024", None, None, None, None, None), ("published_too_old", "survey", None, None, None, dt.date(2025, 1, 1), None), ("published_recent", "survey", None, "(c) 2019 Someone", None, day, True),
        ("in_progress_phrase", "now open", None, None, None, None, None), ("recent_window", "until 2026-06-30", None, None, None, None, False), ("date_unknown_hold", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(k, *c[1:]) for k, c in enumerate(cases)], FORMS)
    got = {r.id: r.freshness for r in evaluate_freshness(df, TODAY, live="live").collect()}
    want = [c[0] for c in cases]
    assert [got[k].reason for k in range(len(cases))] == want
    assert got[10].status == "active" and got[10].diagnose and got[13].status == "discovered" and not got[13].diagnose


def test_triage_queues(spark):
    day = dt.date(2026, 6, 1)
    rows = [
        (1, "City hall survey 2026", None, None, "x.example", day, True, True), (2, "My study, only takes 2 minutes", None, None, None, day, False, False), (3, "Survey", None, None, "stat.gov.uk", None, None, None),
        (4, "Survey 2021 closed", None, None, None, dt.date(2021, 1, 1), None, None), (5, "Acme Inc customer satisfaction", None, None, None, dt.date(2025, 1, 1), None, None), (6, None, None, None, None, day, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, title string, source_title string, description string, host string, published_on date, by_date boolean, first_seen boolean")
    got = {r.id: (r.organization, r.recency, r.queue) for r in triage(df, TODAY).collect()}
    assert got == {
        1: ("public", "recent_high", "A_PRIORITY"), 2: ("individual_or_academic", "recent_high", "C_ARCHIVE"), 3: ("public", "unknown", "A_PRIORITY"),
        4: ("unknown", "likely_old", "C_ARCHIVE"), 5: ("company", "likely_old", "C_ARCHIVE"), 6: ("unknown", "recent_high", "B_PRIORITY"),
    }
