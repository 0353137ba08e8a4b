"""Rounding, ratios and scores as column expressions.  Halves round up, on doubles."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    k = float(10**places)
    return F.floor(x.cast("double") * k + 0.5) / k


def percent(count: Column, total: Column) -> Column:
    """Percentage with one place; 0 where there is nothing to divide by."""
    share = F.try_divide(count.cast("double"), total.cast("double"))
    return F.when(total > 0, F.floor(share * 1000 + 0.5) / 10).otherwise(F.lit(0.0))


def percent_or_null(count: Column, total: Column) -> Column:
    return F.when(total > 0, percent(count, total))


def mean(total: Column, count: Column, places: int = 2) -> Column:
    """Mean of non-null values with ``places``; 0 where there are none."""
    return F.when(count > 0, half_up(F.try_divide(total.cast("double"), count.cast("double")), places)).otherwise(F.lit(0.0))


def unit_ratio(part: Column, whole: Column) -> Column:
    """part / whole, null unless it lies between 0 and 1."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.when((whole > 0) & ratio.between(0.0, 1.0), ratio)


def coverage(done: Column, wanted: Column) -> Column:
    """done / wanted, 1 where nothing is wanted."""
    return F.when(wanted <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(done.cast("double"), wanted.cast("double"))))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def lookup(key: Column, values: Mapping[str, float | str], default=None) -> Column:
    """A value for each key of a small fixed mapping."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def grade(score: Column, bounds: tuple[tuple[float, str], ...] = ((80, "safe"), (60, "caution"), (40, "risk")), lowest: str = "high_risk") -> Column:
    """The first grade whose bound the score reaches."""
    (first, name), *rest = bounds
    out = F.when(score >= first, name)
    for bound, name in rest:
        out = out.when(score >= bound, name)
    return out.otherwise(lowest)
