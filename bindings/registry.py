"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bindings import roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The roles of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, role: str) -> DataFrame:
        return roles.frame(self.spark, self.sf_dir, role)

    def raw(self, name: str) -> DataFrame:
        return roles.table(self.spark, self.sf_dir, name)


def query(name: str, *used: str, sql: str | None = None):
    """Register a function of ``Tables``; ``used`` roles become CTEs of the SQL."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            prefix = roles.cte(*used) if used else ""
            if prefix and body[:4].lower() == "with":
                ORACLE[name] = prefix + ",\n" + body[4:].strip()
            else:
                ORACLE[name] = (prefix + "\n" + body).strip()
        return fn
    return wrap
