"""All registered queries with their DuckDB equivalents."""

from __future__ import annotations

from tallywright.plans import evaluation, events, forecasts, models, preparation, profiles, scalars  # noqa: F401
from tallywright.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
