"""Registry of the queries run over the supplied tables, each with its oracle statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from offerlens.plans.derived import Frames, oracle

_QUERIES: dict[str, Callable[[Frames], DataFrame]] = {}
_ORACLE: dict[str, str] = {}
_MODULES = ("read_models", "collection", "texts", "evaluation", "daily")


def query(name: str, sql: str | None = None):
    def register(function: Callable[[Frames], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = function
        if sql is not None:
            _ORACLE[name] = sql
        return function

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"offerlens.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=function: f(Frames(spark, sf_dir))) for name, function in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: oracle(sql) for name, sql in _ORACLE.items()}
