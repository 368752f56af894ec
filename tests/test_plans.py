"""Physical-plan checks: no Python evaluation in any query, pruned scans, dimension joins broadcast."""

import re

import pytest

from evalframe.plans import catalog

from conftest import SF_SMALL

PYTHON_NODES = ["BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF",
                "FlatMapCoGroupsInPandas", "MapInArrow"]
QUERIES = catalog.queries()
SKIP = {"rf_fit_predict", "predictor_report", "permutation_importance", "predictor_report_quality",
        "predictor_report_with_quality"}  # fit a forest while planning


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_python_in_plan(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for node in PYTHON_NODES:
        assert node not in plan, f"{name}: {node}"


def test_flagship_scan_is_pruned_and_filter_pushed(spark):
    plan = _plan(QUERIES["acc_by_model_bench_lang"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double,props:string>" in plan
    assert "ts:" not in plan.split("ReadSchema")[1].split("\n")[0]
    # its predicates are on derived columns, so they run as a filter directly on the scan, below the first exchange
    below = plan[plan.rindex("Exchange"):]
    assert "Filter" in below and "FileScan" in below


def test_plain_predicates_reach_the_parquet_reader(spark):
    from pyspark.sql import functions as F

    from evalframe.sources.tables import read_table

    plan = _plan(read_table(spark, SF_SMALL, "documents").filter(F.col("lang") == "de").select("doc_id"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(lang,de\)", plan)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_dimension_joins_are_broadcast(spark):
    plan = _plan(QUERIES["dim_model_label"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_rouge_has_one_hash_exchange_and_no_join(spark):
    """The id partitioning serves both aggregates: nothing is exchanged above the explode of the words."""
    plan = _plan(QUERIES["rouge1_pairs"](spark, SF_SMALL))
    assert "Generate explode" in plan and "Join" not in plan
    above = plan[:plan.index("Generate explode")]
    assert "HashAggregate" in above and "Exchange" not in above
