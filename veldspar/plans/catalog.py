"""All queries by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "agg_group"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES: tuple[str, ...] = ("q_records", "q_tools", "q_graph", "q_sparql", "q_sources")


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its own name, with its SQL."""

    def register(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return register


def _load() -> None:
    import importlib

    for name in _MODULES:
        importlib.import_module(f"veldspar.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
