"""Names of the engine's queries, each with its plan and, where SQL can say it, its oracle."""

from __future__ import annotations

from . import graph_queries, measure_queries, scalar_queries, source_queries, window_queries

_MODULES = (scalar_queries, graph_queries, window_queries, measure_queries, source_queries)


def queries() -> dict:
    return {name: plan for m in _MODULES for name, (plan, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
