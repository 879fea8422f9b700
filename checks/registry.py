"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.fixtures import Fixtures, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(build: Callable[[Fixtures], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: build(Fixtures(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return build

    return register
