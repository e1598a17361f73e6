"""All queries over the market tables, with the SQL that gives the same rows."""

from __future__ import annotations

from . import flow, market

_GROUPS = (market.QUERIES, flow.QUERIES)


def queries() -> dict:
    return {name: run for group in _GROUPS for name, (run, _) in group.items()}


def oracle_sql() -> dict:
    return {name: sql for group in _GROUPS for name, (_, sql) in group.items() if sql}
