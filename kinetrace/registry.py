"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name; covers: operator ids of the survey."""

    def add(f):
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = covers
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
