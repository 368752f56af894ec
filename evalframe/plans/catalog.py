"""Registry of named queries and their DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``. ``register`` wraps it with
``finalize`` (stable result types) and stores the oracle SQL with the
fixture views inlined as CTEs.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalframe.functions.numeric import finalize
from evalframe.plans.oracle_views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}

_MODULES = [
    "evalframe.plans.accuracy_reports",
    "evalframe.plans.gain_reports",
    "evalframe.plans.scoring_reports",
    "evalframe.plans.filters_joins",
    "evalframe.plans.agreement_reports",
    "evalframe.plans.text_reports",
    "evalframe.plans.curation_reports",
    "evalframe.plans.stats_reports",
    "evalframe.plans.source_reports",
    "evalframe.plans.ml_reports",
]
_loaded = False


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str, _fn=fn) -> DataFrame:
            return finalize(_fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        run.__wrapped__ = fn
        _QUERIES[name] = run
        if oracle is not None:
            _ORACLE[name] = with_views(oracle)
        return fn

    return deco


def _load() -> None:
    global _loaded
    if _loaded:
        return
    for m in _MODULES:
        importlib.import_module(m)
    _loaded = True


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
