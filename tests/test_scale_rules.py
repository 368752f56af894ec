"""Rules for scale: nothing is lost as data grows, intermediates are shared and removable."""

import os

import pytest
from pyspark.sql import functions as F

from evalframe import session
from evalframe.operators import lift
from evalframe.plans import catalog
from evalframe.sources.tables import v_items, v_responses, v_surveys

from conftest import SF_SMALL

SF01 = "/root/testdata/sf0.01"


def _assessed(spark, sf):
    r = v_responses(spark, sf)
    runs = lift.item_runs(r)
    answers = lift._wino_answers(r).count()
    return runs.select("item_id").distinct().count(), runs.count() / answers, v_surveys(spark, sf)


def test_assessed_items_grow_with_the_answers(spark):
    n_small, kept_small, _ = _assessed(spark, SF01)
    n, kept, surveys = _assessed(spark, "/root/testdata/sf0.1")
    assert n >= 8 * n_small and abs(kept - kept_small) < 0.03
    items = lift.assessed_items(lift.item_runs(v_responses(spark, "/root/testdata/sf0.1")))
    assert surveys.select(F.col("answer_item").alias("item_id")).join(items, "item_id", "left_semi").count() >= 0.9 * surveys.count()


def test_runs_are_aligned_and_lift_is_not_constant(spark):
    runs = catalog.queries()["align_runs"](spark, SF01)
    assert runs.filter("n_runs = 3").count() >= 0.3 * runs.count()
    did = [r.did for r in catalog.queries()["lift_did"](spark, SF01).collect()]
    assert len(set(did)) > 3
    ranks = [r["rank"] for r in catalog.queries()["rank_by_lift"](spark, SF01).collect()]
    assert len(set(ranks)) > 1


@pytest.mark.parametrize("name", ["render_prompt_mc", "render_prompt_cloze"])
def test_every_test_item_gets_a_request(spark, name):
    got = catalog.queries()[name](spark, SF_SMALL)
    assert got.count() == v_items(spark, SF_SMALL).filter("split = 'test'").count()
    assert got.filter("content is null or status is null").count() == 0
    assert {r.status for r in got.select("status").distinct().collect()} <= {"ok", "short"}


def test_cleanup_empties_the_shared_folder(spark):
    session.cleanup(spark)
    df = session.materialize(spark.range(5).toDF("x"), "probe")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and df.count() == 5
    assert session.cleanup(spark) == 1 and not os.path.exists(path)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_lift_sends_no_survey_rows_to_the_driver(spark):
    """Stored surveys take a few bytes a row and would be broadcast by their file size, whatever their number."""
    typical = "No, the sentence is typical"
    kinds = [("af", typical), ("af", "Maybe"), ("zu", typical), ("zu", None), ("en", typical)]
    surveys = spark.createDataFrame([(k % 3, lang, a, typical, None, None) for k in range(300) for lang, a in kinds],
                                    "answer_item long, lang string, approp_1 string, approp_2 string, quality_1 string, quality_2 string")
    right = {(0, "af"): (1, 1, 0), (0, "en"): (1, 1, 1), (1, "af"): (1, 0, 0), (1, "en"): (0, 1, 0), (0, "zu"): (1, 0)}
    answers = [("m", i, lang, t, 10 * t, c, False, "winogrande", "Human") for (i, lang), cs in right.items() for t, c in enumerate(cs, 1)]
    responses = spark.createDataFrame(answers, "model string, item_id long, eval_lang string, trial int, response_id long, correct int, "
                                               "was_ft boolean, benchmark string, approach string")
    out = lift.lift_report(surveys, responses, "all")
    got = {r.lang: (r.n_app, r.n_inapp, round(r.app_acc, 6), round(r.inapp_acc, 6), round(r.en_app_acc, 6)) for r in out.collect()}
    assert got == {"af": (200, 200, 50.0, 50.0, 66.666667), "zu": (200, 200, 0.0, 0.0, 66.666667)}
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin [item_id" not in plan and "SortMergeJoin [item_id" in plan
