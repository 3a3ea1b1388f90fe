"""Where queries are registered, and the table reader they share."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = [
    "slice",
    "table_queries",
    "text_queries",
    "row_queries",
    "corpus_queries",
    "sentence_queries",
    "group_queries",
    "join_queries",
    "io_queries",

]


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` computes the same rows in ANSI SQL."""

    def register(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__ = name
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load():
    for module in _MODULES:
        importlib.import_module(f"{__package__}.{module}")


def queries():
    _load()
    return dict(_QUERIES)


def oracle_sql():
    _load()
    return dict(_SQL)
