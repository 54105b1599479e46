"""Every registered query: name -> function of the domain tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import Domain

_QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}


def query(name: str):
    def add(fn):
        _QUERIES[name] = fn
        return fn
    return add


def add_all(mapping: dict[str, Callable[[Domain], DataFrame]]) -> None:
    _QUERIES.update(mapping)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog  # noqa: F401  (fills the table)

    def bind(fn):
        return lambda spark, sf_dir: fn(Domain.of(spark, sf_dir))
    return {name: bind(fn) for name, fn in _QUERIES.items()}


def checks() -> dict[str, str]:
    from . import oracle
    from .oracle import all_sql
    return {name: oracle.compose(sql) for name, sql in all_sql().items()}
