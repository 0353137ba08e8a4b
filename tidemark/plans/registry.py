"""Every named query of the engine and the SQL it is checked against."""

from __future__ import annotations

from tidemark.plans import cases, collection, dashboards, forms, records, rulings, selection, streams, texts  # noqa: F401  they register their queries
from tidemark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
