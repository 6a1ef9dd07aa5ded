"""Registration of queries with their SQL."""

from __future__ import annotations


def registry():
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return register

    return queries, oracle, query
