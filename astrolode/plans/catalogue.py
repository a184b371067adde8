"""All queries of the core and their SQL."""

from __future__ import annotations

from . import biology, derive, galaxy, model, near, orphans, reads, relational, skewed, state, stream

MODULES = [relational, galaxy, derive, reads, model, state, stream, biology, near, orphans, skewed]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}


flagship = relational.expected_by_region
