"""All queries of the analytics engine, with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Registers a query (spark, sf_dir) -> DataFrame, and the SQL of the same rows where there is one."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["flagship_overlap"](spark, sf_dir)


def _register_all() -> None:
    from . import io_queries, more_queries, safety_queries, store_queries, text_queries, vector_queries  # noqa: F401


_register_all()
