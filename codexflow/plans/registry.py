"""Where the named queries and their SQL are gathered."""

from __future__ import annotations

from codexflow.plans.corpus import with_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` by its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return add
