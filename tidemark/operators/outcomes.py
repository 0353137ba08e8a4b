"""What a diagnosis came to: why it stayed limited, what that means for the link, and how safe it is to answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match


@dataclass(frozen=True)
class Reasons:
    """Patterns of what went wrong; the defaults are English, other languages bring their own."""

    closed: str = r"(?i)\b(is|was) closed\b|survey has ended|no longer accepting"
    access: str = r"(?i)\blog ?in required|sign in|permission required"
    extract: str = r"(?i)javascript|could not be read|dynamic"
    system: str = r"(?i)timeout|timed out|unexpected|exception|try again"
    retry: str = r"(?i)timeout|timed out|unexpected|exception|try again"
    again: str = r"(?i)try again"
    decision: str = r"(?i)not analysable"


def limited_bucket(risk: Column, diagnosis: Column, decision: Column, scan: Column, reason: Column, words: Reasons = Reasons()) -> Column:
    """normal_diagnosis, or why a diagnosis was limited; clear closings and restrictions come before what a failed scan says about itself."""
    told = F.concat_ws(" ", reason, decision)
    state = F.coalesce(scan, F.lit(""))
    limited = F.coalesce(risk == "limited", F.lit(False)) | F.coalesce(diagnosis == "limited", F.lit(False)) | F.coalesce(decision.rlike(words.decision), F.lit(False)) | state.isin("limited", "failed")
    closed, extract = told.rlike(words.closed), told.rlike(words.extract)
    access = told.rlike(words.access) & ~extract
    failing = (state == "failed") | told.rlike(words.system)
    return first_match([
        (~limited, "normal_diagnosis"), (failing & closed & ~told.rlike(words.again), "survey_closed"), (failing & access, "access_restricted"), (failing & told.rlike(words.retry), "system_failure"),
        (closed, "survey_closed"), (access, "access_restricted"), (extract, "extraction_limited"), (told.rlike(words.system), "system_failure"),
    ], "extraction_limited")


def link_feedback(reason: Column, words: Reasons = Reasons()) -> Column:
    """closed, restricted, or null where the reason may be one of reading alone."""
    return first_match([(reason.rlike(words.extract) | reason.rlike(words.retry), None), (reason.rlike(words.closed), "closed"), (reason.rlike(words.access), "restricted")])


def link_status(scan: Column, bucket: Column, reason: Column, words: Reasons = Reasons()) -> Column:
    """The status of a link's diagnosis from that of its scan and from why it was limited."""
    late = F.coalesce(reason.rlike("(?i)timed? ?out"), F.lit(False))
    return first_match([
        (scan.isin("pending", "idle"), "queued"), (scan == "running", "running"), ((scan == "completed") & (bucket == "normal_diagnosis"), "completed"), (bucket == "survey_closed", "skipped_closed"),
        (bucket == "access_restricted", "skipped_restricted"), ((bucket == "system_failure") | late, "timeout"), (scan == "cancelled", "failed_final"), (scan == "failed", "failed_retryable"),
        ((scan == "limited") | (bucket == "extraction_limited"), "limited"), (scan == "completed", "completed"),
    ], "failed_retryable")


def feedback_reason(old: Column, target: Column, hours_since_seen: Column, guard_hours: float = 6.0) -> Column:
    """``applied`` where a status may become ``target``, else why it stays."""
    return first_match([
        (old.isNull(), "no_link"), (target.isNull(), "no_target"), (old == target, "already_there"), ((old == "closed") & (target == "restricted"), "keeps_closed"), (old.isin("ignored", "invalid"), "set_aside"),
        (hours_since_seen < guard_hours, "seen_recently"),
    ], "applied")


def safety_type(privacy: Column, verdict: Column, subject: Column, external: Column, direct: Column, sensitive: Column, high: Column) -> Column:
    """One of seven kinds of safety; the counts are of direct identifiers, sensitive and high-risk items."""
    has_direct = (privacy == "direct_identifier") | (direct > 0)
    stop = (privacy == "sensitive_or_high_risk") | (sensitive > 0) | (high > 0) | verdict.isin("DO_NOT_RESPOND", "REPORT_OR_INQUIRE")
    public = subject.isin("public_agency", "public_commissioned_private", "school_local")
    return first_match([
        ((privacy == "limited") | (verdict == "LIMITED_DIAGNOSIS"), "JUDGMENT_UNKNOWN"), (stop, "STOP_RESPONSE"), ((subject == "unknown") & has_direct, "STOP_RESPONSE"), (has_direct & public & external, "STOP_RESPONSE"),
        (subject == "unknown", "SECURITY_CHECK"), (has_direct, "NOTICE_CHECK"), ((privacy == "quasi_only") | (verdict == "RESPOND_WITH_CAUTION"), "PII_CAUTION"),
    ], "SAFE_RESPOND")


def report_advised(privacy: Column, subject: Column, external: Column, direct: Column, sensitive: Column, high: Column, gaps: Column, consent_missing: Column, employee: Column) -> Column:
    """Whether one of the rules holds by which a form should be reported or asked about; forms that collect little never are."""
    risky = (sensitive > 0) | (high > 0)
    rules = [
        risky & (gaps >= 3), (high > 0) & external, (sensitive > 0) & consent_missing, (subject == "unknown") & (direct >= 2) & (risky | (direct >= 3)),
        (subject == "public_agency") & ((direct > 0) | risky) & external & (gaps >= 2), employee & (direct > 0) & (gaps >= 2),
    ]
    any_of = F.exists(F.array(*rules), lambda x: F.coalesce(x, F.lit(False)))
    return ~F.coalesce(privacy.isin("minimal", "quasi_only", "limited"), F.lit(False)) & any_of
