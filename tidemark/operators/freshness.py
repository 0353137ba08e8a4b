"""Whether a found form is still open: ordered rules over its texts, days and sources; what is now is a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions.rules import first_match


@dataclass(frozen=True)
class Phrases:
    """Patterns of the rules; the defaults are English, other languages bring their own."""

    closed: str = r"(?i)\b(closed|no longer accepting|survey has ended)\b"
    closed_url: str = r"(?i)/closedform|/closed($|[/?#])"
    restricted: str = r"(?i)\b(sign in to continue|members only|permission required)\b"
    personal: str = r"(?i)\b(thesis|dissertation|student project)\b"
    last_year: str = r"(?i)\blast year'?s\b"
    in_progress: str = r"(?i)\b(now open|in progress|accepting responses)\b"
    topic: str = r"(?i)\b(census|results of|review of)\b"


OUTCOME = "status string, availability string, reason string, diagnose boolean"


def outcome(status: str, availability: str, reason: str, diagnose: bool = False) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(availability).alias("availability"), F.lit(reason).alias("reason"), F.lit(diagnose).alias("diagnose"))


def evaluate_freshness(df: DataFrame, today: str, window_days: int = 120, phrases: Phrases = Phrases(), live: str | None = None) -> DataFrame:
    """``df`` (title, snippet, page_text, url, published_on) with ``freshness``, the first of sixteen outcomes that holds.

    ``today`` is an ISO day.  Days in texts stay ISO strings and are compared as such, so that
    an impossible one such as 2026-02-30 keeps its place.  ``live`` names a boolean column
    that says a page was seen to be open.  Nulls never make a rule hold.
    """
    blob = F.concat_ws("\n", "title", "snippet", "page_text", "url")
    blob = dates.without_copyright_years(blob)
    rows = df.withColumn("_blob", blob).withColumn("_days", dates.first_and_last_day(F.col("_blob"))).withColumn("_years", F.transform(dates.years_in(F.col("_blob")), lambda y: y.cast("int")))
    text, end, year = F.col("_blob"), F.col("_days.last_day"), int(today[:4])
    start = F.nullif(F.col("_days.first_day"), end)  # a single day is an end
    past = F.array_max(F.filter("_years", lambda y: y < year))
    old = past.isNotNull() & ~F.array_contains("_years", year)
    age = F.datediff(F.lit(today).cast("date"), F.col("published_on").cast("date"))
    open_now = F.coalesce(end >= today, F.lit(False))
    seen = F.coalesce(F.col(live), F.lit(False)) if live else F.lit(False)

    def running(availability: str, reason: str, diagnose: bool) -> Column:
        return F.when(seen, outcome("active", availability, reason, diagnose)).otherwise(outcome("discovered", availability, reason, diagnose))

    rules = [
        (F.col("url").rlike(phrases.closed_url), outcome("closed", "closed", "closed_url")),
        (text.rlike(phrases.closed), outcome("closed", "closed", "closed_phrase")),
        (text.rlike(phrases.restricted), outcome("restricted", "restricted", "restricted_phrase")),
        (text.rlike(phrases.personal), outcome("ignored", "unknown", "personal_research")),
        (text.rlike(phrases.last_year), outcome("stale", "stale", "previous_year_phrase")),
        (end < today, outcome("closed", "closed", "end_date_passed")),
        (start > today, outcome("discovered", "unknown", "start_date_future")),
        (old & text.rlike(phrases.topic), outcome("stale", "stale", "stale_topic_year")),
        (old, outcome("stale", "stale", "stale_year")),
        ((age > window_days) & ~open_now, outcome("stale", "stale", "published_too_old")),
        (age <= window_days, running("active", "published_recent", True)),
        (F.concat_ws("\n", "title", "snippet").rlike(phrases.in_progress), running("active", "in_progress_phrase", True)),
        (open_now, running("active", "recent_window", True)),
    ]
    return rows.withColumn("freshness", first_match(rules, running("unknown", "date_unknown_hold", False))).drop("_blob", "_days", "_years")


@dataclass(frozen=True)
class Signals:
    """Patterns by which an organization is told from titles and hosts."""

    academic: str = r"(?i)\b(thesis|dissertation|my study)\b"
    official_school: str = r"(?i)\b(university|college) (office|administration|library)\b"
    public_host: str = r"\.(gov|go)(\.[a-z]{2})?$"
    public: str = r"(?i)\b(city hall|ministry|county|public library|municipal)\b"
    company: str = r"(?i)\b(inc|ltd|gmbh|corp|customer satisfaction)\b"
    plea: str = r"(?i)\b(please help|gift card|only takes)\b"
    closed: str = r"(?i)\bclosed\b"


def triage(df: DataFrame, today: str, signals: Signals = Signals()) -> DataFrame:
    """``df`` (title, source_title, description, host, published_on, by_date, first_seen) with organization, scores, recency and queue."""
    title = F.concat_ws(" ", "title", "source_title", "description")
    host = F.coalesce(F.col("host"), F.lit(""))
    school = title.rlike(signals.official_school)
    kinds = [
        (title.rlike(signals.academic) & ~school, ("individual_or_academic", -40)), (host.rlike(signals.public_host), ("public", 50)),
        (title.rlike(signals.public), ("public", 35)), (school, ("university_official", 30)),
        (title.rlike(signals.plea) & ~title.rlike(signals.company), ("individual_or_academic", -25)), (title.rlike(signals.company), ("company", 28)),
    ]
    told = lambda k: F.struct(F.lit(k[0]).alias("organization"), F.lit(k[1]).alias("points"))
    rows = df.withColumn("_org", first_match([(c, told(k)) for c, k in kinds], told(("unknown", 0))))
    age, year = F.datediff(F.lit(today).cast("date"), F.col("published_on").cast("date")), int(today[:4])
    years = F.transform(dates.years_in(title), lambda y: y.cast("int"))
    named, before, long_ago = F.array_contains(years, year), F.array_contains(years, year - 1), F.exists(years, lambda y: y.between(year - 6, year - 2))
    points = (
        F.when(age <= 60, 40).when(age <= 180, 15).when(age > 365, -25).otherwise(0) + F.when(F.col("by_date"), 20).otherwise(0) + F.when(F.col("first_seen"), 10).otherwise(0)
        + F.when(named, 15).when(before, -20).otherwise(0) + F.when(long_ago & ~named, -25).otherwise(0) + F.when(title.rlike(signals.closed), -15).otherwise(0)
    )
    rows = rows.withColumn("recency_score", points.cast("int")).select("*", F.col("_org.organization").alias("organization"), F.col("_org.points").alias("organization_score")).drop("_org")
    score, org, strength = F.col("recency_score"), F.col("organization"), F.col("organization_score")
    rows = rows.withColumn("recency", first_match([(score >= 35, "recent_high"), (score >= 15, "recent_possible"), (score <= -15, "likely_old")], "unknown"))
    recent, official = F.col("recency").isin("recent_high", "recent_possible"), org.isin("public", "company", "university_official")
    queue = first_match(
        [
            (org == "individual_or_academic", "C_ARCHIVE"), ((F.col("recency") == "likely_old") & (strength < 30), "C_ARCHIVE"),
            (official & (strength >= 28) & recent, "A_PRIORITY"), ((org == "public") & (strength >= 45), "A_PRIORITY"),
            ((org == "unknown") & (strength < 12) & ~recent, "C_ARCHIVE"),
        ],
        "B_PRIORITY",
    )
    return rows.withColumn("queue", queue)
