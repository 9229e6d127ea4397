"""Registered queries of the operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from . import evidence, flows, observation, outreach, registry, settlement, text

_GROUPS = (settlement, evidence, observation, outreach, registry, text, flows)


def queries() -> dict:
    return {name: query for group in _GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.SQL.items()}
