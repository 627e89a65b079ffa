"""All queries of the engine by name, with the SQL they are held against."""

from __future__ import annotations

from . import documents, evaluation, graph, records, search
from .registry import Query

MODULES = (search, documents, graph, evaluation, records)


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.R.sql.items()}
