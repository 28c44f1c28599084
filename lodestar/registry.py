"""Registry of the queries over the given tables: ``name -> (function, DuckDB SQL or None)``."""

from __future__ import annotations

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = (f, sql)
        return f

    return keep
