"""What a request asks for, resolved on the driver: day ranges, flags, status presets, schedules."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that each named range looks back, besides today.
PRESETS = {"today": 0, "7d": 6, "30d": 29}


@dataclass(frozen=True)
class Days:
    """A closed range of local days; an end that is None is open."""

    name: str
    first: str | None
    last: str | None

    def holds(self, day: Column) -> Column:
        return (F.lit(True) if self.first is None else day >= F.lit(self.first).cast("date")) & (F.lit(True) if self.last is None else day <= F.lit(self.last).cast("date"))


def iso_day(text: str | None) -> str | None:
    """``text`` if it is a day of the calendar in ISO form."""
    if not text or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text.strip()):
        return None
    try:
        return dt.date.fromisoformat(text.strip()).isoformat()
    except ValueError:
        return None


def preset(today: str, name: str) -> Days:
    back = dt.date.fromisoformat(today) - dt.timedelta(days=PRESETS[name])
    return Days(name, back.isoformat(), today)


def resolve_days(today: str, name: str | None = None, first: str | None = None, last: str | None = None) -> Days:
    """Two given days in either order, else the named range, else the last seven days."""
    ends = sorted(x for x in (iso_day(first), iso_day(last)) if x)
    if len(ends) == 2:
        return Days("custom", *ends)
    wanted = (name or "").lower()
    return preset(today, wanted if wanted in PRESETS else "7d")


def resolve_days_strictly(today: str, name: str | None = None, first: str | None = None, last: str | None = None) -> Days:
    """As `resolve_days`, with ``all``; days in the wrong order, or ``custom`` without both, are errors."""
    a, b = iso_day(first), iso_day(last)
    if a and b:
        if a > b:
            raise ValueError(f"{a} comes after {b}")
        return Days("custom", a, b)
    wanted = (name or "").lower()
    if wanted == "custom":
        raise ValueError("a custom range needs two days")
    return Days("all", None, None) if wanted == "all" else preset(today, wanted if wanted in PRESETS else "7d")


def flag(text: str | None) -> bool | None:
    """True, False, or None where a request doesn't say."""
    return {"true": True, "1": True, "false": False, "0": False}.get((text or "").strip().lower())


def when_flag(condition: Column, wanted: bool | None) -> Column | None:
    """A predicate for a flag that is given, None for one that isn't; a null condition counts as false."""
    holds = F.coalesce(condition, F.lit(False))
    return None if wanted is None else holds if wanted else ~holds


def status_preset(status: Column, name: str | None, usual: Sequence[str] = ("active", "discovered")) -> Column:
    """The usual statuses, all but invalid ones, all, or the one named."""
    if not name or name == "default":
        return status.isin(*usual)
    if name == "non_invalid":
        return status != "invalid"
    return F.lit(True) if name == "all" else status == name


def fires_a_day(schedule: str) -> int:
    """How often a five-field schedule fires on a day, from its minutes and hours."""
    fields = schedule.split()
    if len(fields) < 5:
        return 0

    def hits(field: str, size: int) -> int:
        if field == "*":
            return size
        if field.startswith("*/"):
            step = int(field[2:]) if field[2:].isdigit() else 0
            return -(-size // step) if step else 0
        return sum(1 for part in field.split(",") if part.strip())

    return hits(fields[0], 60) * hits(fields[1], 24)
