"""Ordered rules, ranks and additive scores as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """The value of the first rule that holds; a null condition doesn't hold."""
    (condition, value), *rest = rules
    out = F.when(condition, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out.otherwise(default)


def first_pattern(text: Column, rules: Sequence[tuple[str, str]], default=None) -> Column:
    return first_match([(text.rlike(pattern), value) for pattern, value in rules], default)


def rank_in(value: Column, order: Sequence[str]) -> Column:
    """Place of ``value`` in ``order``, from 0; unknown and null values come after all."""
    return first_match([(value == x, F.lit(k)) for k, x in enumerate(order)], F.lit(len(order)))


def worst(values: Sequence[Column], order: Sequence[str]) -> Column:
    """The value that comes last in ``order``; nulls don't count."""
    ranks = [F.when(v.isin(*order), rank_in(v, order)) for v in values]
    top = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    return F.get(F.array(*[F.lit(x) for x in order]), top)


def matched_names(conditions: Mapping[str, Column]) -> Column:
    """Names of all conditions that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))


def pattern_names(text: Column, patterns: Mapping[str, str]) -> Column:
    return matched_names({name: text.rlike(p) for name, p in patterns.items()})


def additive(base: float, parts: Sequence[tuple[Column, float]]) -> Column:
    """``base`` and the points of every condition that holds."""
    return reduce(lambda s, x: s + F.when(x[0], F.lit(x[1])).otherwise(F.lit(type(x[1])(0))), parts, F.lit(base))


def any_contains(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda s, w: s | F.contains(text, F.lit(w)), words, F.lit(False))


def matches(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` is found in ``text``; where it is a choice of plain words, they are looked for as such."""
    words = pattern.split("|")
    return any_contains(text, words) if all(re.fullmatch(r"[\w ]+", w) for w in words) else text.rlike(pattern)


def all_of(predicates: Sequence[Column | None]) -> Column:
    """Conjunction of the predicates that are given."""
    return reduce(lambda s, p: s & p, [p for p in predicates if p is not None], F.lit(True))
