"""Named queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    from evalframe.llm import queries as _  # noqa: F401  (registers on import)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from evalframe.llm import queries as _  # noqa: F401

    return dict(_ORACLE)
