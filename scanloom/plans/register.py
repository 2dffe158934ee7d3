"""Where queries and their SQL are registered."""

from __future__ import annotations

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Register a query under its function's name, beside the SQL that gives its rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
