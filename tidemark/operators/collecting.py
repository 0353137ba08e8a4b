"""Found forms on their way to diagnosis: lanes, holds, targets, confidence, source pages and who is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.forms import form_domain
from tidemark.functions.rules import first_match
from tidemark.functions.urls import homepage_like, host

CONFIRMED = ("active_recent", "active_candidate", "collect_confirmed")
SCREENED = ("closed", "restricted", "invalid", "ignored", "unreachable", "stale")
PERSONAL = r"(?i)\b(thesis|dissertation|student project)\b"
UNDATED = ("date_unknown_hold", "active_unknown_date")


def lane(status: Column, freshness: Column, reason: Column, should_diagnose: Column, title: Column, personal: str = PERSONAL) -> Column:
    """One of eight lanes, by ordered rules; nulls are as empty, and not to be diagnosed."""
    state, fresh, why = (F.lower(F.coalesce(c, F.lit(""))) for c in (status, freshness, reason))
    active, should, undated = state == "active", F.coalesce(should_diagnose, F.lit(False)), why.isin(*UNDATED)
    return first_match([
        (title.rlike(personal), "screened_out"), (fresh == "stale_candidate", "stale_candidate"), (state.isin(*SCREENED), "screened_out"), (state == "discovered", "collect_candidate"), (state.isin("", "raw_discovered"), "raw_discovered"),
        (~active, "collect_candidate"), (undated, "date_unknown_hold"), (~should, "screened_out"), ((fresh == "active_candidate") | (why == "active_candidate"), "active_candidate"),
        (why.isin("recent_window", "published_recent") | (fresh == "active"), "active_recent"),
    ], "collect_confirmed")


def hold_reason(of: Column) -> Column:
    """Why a form of a lane isn't diagnosed; null where nothing holds it."""
    return first_match([(of == "date_unknown_hold", "date_unknown"), (of == "stale_candidate", "stale"), (of == "screened_out", "screened"), (~of.isin(*CONFIRMED), "not_confirmed")])


def auto_target(of: Column, should_diagnose: Column, title: Column, official: Column, personal: str = PERSONAL) -> Column:
    """Whether a form is diagnosed without asking: confirmed, fresh, official and nobody's private research."""
    return of.isin(*CONFIRMED) & ~F.coalesce(title.rlike(personal), F.lit(False)) & F.coalesce(should_diagnose, F.lit(False)) & F.coalesce(official, F.lit(False))


def confidence(posted: Column, start: Column, end: Column, deadline: Column, eligible: Column, unknown: Column, in_period: Column, cap: Column) -> Column:
    """high, medium, low or none: how sure a form's freshness is; a poor source page takes a step off."""
    dated = posted.isNotNull() | end.isNotNull() | deadline.isNotNull()
    low_cap = F.coalesce(cap == "low", F.lit(False))
    plain = first_match([(dated, "high"), (eligible, "medium"), (unknown, "none")], "low")
    return F.when(low_cap & dated, "medium").when(low_cap, F.when(unknown, "none").otherwise("low")).otherwise(plain)


def real_source(page: Column, home: Column) -> Column:
    """A web page on its institution's host that is neither a start page nor a form platform."""
    there = F.coalesce(page, F.lit(""))
    same = home.isNull() | (host(there) == host(home))
    return F.coalesce(there.rlike("^https?://") & ~form_domain(there) & same & ~homepage_like(there), F.lit(False))


def due_sites(sites: DataFrame, as_of: Column, most: int, unique: str) -> DataFrame:
    """The first ``most`` sites whose crawl is due, that are not running and whose seeds are in order, by priority, then the longest due."""
    due = (F.col("next_crawl_at") <= as_of) & (F.col("crawl_status") != "running") & ((F.col("review") == "ok") | F.col("review").isNull())
    return sites.where(due).orderBy("priority", "next_crawl_at", unique).limit(most)


def boosted(priority: Column, found_at: Column, as_of: Column, days: int = 60) -> Column:
    """A for a site that had a form within so many days, else its own priority."""
    age = (F.unix_micros(as_of) - F.unix_micros(found_at)) / F.lit(86_400_000_000.0)
    return F.when(F.coalesce(age <= days, F.lit(False)), "A").otherwise(priority)
