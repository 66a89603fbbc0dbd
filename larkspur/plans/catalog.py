"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from larkspur.plans import activity, evaluation, files, memory, search, sessions, texts  # noqa: F401  each module registers its queries
from larkspur.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
