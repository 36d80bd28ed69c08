"""Where operators' queries are registered with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans.fixtures import fixture, with_fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class _OnFixtures(Protocol):
    def __call__(self, *tables: DataFrame) -> DataFrame: ...


def query(*names: str, sql: str | None = None, name: str | None = None) -> Callable[[_OnFixtures], _OnFixtures]:
    """Registers a function of fixtures as a query, with the SQL that gives the same rows."""

    def add(function: _OnFixtures) -> _OnFixtures:
        own = name or function.__name__.removeprefix("q_")
        QUERIES[own] = lambda spark, sf_dir: function(*(fixture(spark, sf_dir, n) for n in names))
        if sql is not None:
            ORACLES[own] = with_fixtures(names, sql)
        return function

    return add
