"""Where queries and their SQL twins are collected."""

from checks.tables import Tables

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Register a Spark query under a name, with the DuckDB text that must give the same rows."""

    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add
