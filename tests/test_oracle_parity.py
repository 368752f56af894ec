"""Every registered query against its DuckDB oracle on the smallest scale (the driver's gate, locally)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from evalframe.plans import catalog
from evalframe.sources.tables import TABLES

from conftest import SF_SMALL

QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()
#: Queries whose result is empty on the smallest tables because what they look for is not there.
MAY_BE_EMPTY: set[str] = set()
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE))


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _sorted(rows):
    return sorted((tuple(_norm(x) for x in r) for r in rows), key=lambda r: tuple(repr(x) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_is_registered_with_an_oracle_or_is_rows_only():
    assert len(QUERIES) >= 120
    assert set(ORACLE) <= set(QUERIES)
    assert ROWS_ONLY == ["permutation_importance", "permutation_importance_published", "predictor_report", "predictor_report_published", "predictor_report_quality", "predictor_report_with_quality", "rf_fit_predict"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(ORACLE[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sdf.columns]
    drows = [tuple(r[i] for i in order) for r in rel.fetchall()]
    assert len(srows) == len(drows)
    assert srows or name in MAY_BE_EMPTY, "nothing is compared"
    assert _sorted(srows) == _sorted(drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["model", "benchmark", "eval_lang", "n_correct", "n_total", "accuracy", "acc_tenths"]
