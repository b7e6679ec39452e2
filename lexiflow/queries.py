"""All registered queries, but for those of optional subpackages, and their SQL."""

from __future__ import annotations

from .plans import catalog, editing, events, geometry, patterns, reading, scans, streams

_MODULES = (catalog, reading, editing, events, geometry, patterns, scans, streams)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
