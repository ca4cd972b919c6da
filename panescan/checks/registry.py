"""Tiny registration helper shared by the query modules."""

from __future__ import annotations

from panescan.checks.derived import with_sql


def registry():
    """(queries, sql, decorator) for one module."""
    queries: dict = {}
    sql: dict = {}

    def query(name: str, needs: str | None = None, twin: str | None = None):
        def keep(fn):
            queries[name] = fn
            if twin is not None:
                sql[name] = with_sql(needs, twin) if needs else twin
            return fn

        return keep

    return queries, sql, query
