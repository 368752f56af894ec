"""Appropriateness lift on Winogrande items (J7, J8, ST11, A-LIFT).

Item key between surveys (``answer_item``) and answers (``item_id``) is (item, language); the answer
side is first reduced to one row per (model, item, language, run) — last
answer wins, as a dict would — then the three runs are aligned by a
group-by instead of index arithmetic on three frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.functions import predicates as P
from evalframe.session import materialize as materialize_table


def _wino_answers(responses: DataFrame) -> DataFrame:
    r = responses.filter(~F.col("was_ft") & (F.col("benchmark") == "winogrande") & P.is_human())
    return r.select("model", "item_id", F.col("eval_lang").alias("lang"), "trial", "response_id", "correct")


def item_runs(responses: DataFrame, materialize: bool = False) -> DataFrame:
    """One row per (model, item, language, run): the last answer's correctness (dict overwrite).

    ``materialize`` writes it once as a table in the shared checkpoint folder
    when several branches read it (item filter and run alignment), so the answers fact is
    scanned once.
    """
    runs = _wino_answers(responses).groupBy("model", "item_id", "lang", "trial").agg(
        F.max_by("correct", "response_id").alias("c"))
    if materialize:
        runs = materialize_table(runs, "item-runs")
    return runs


def assessed_items(runs: DataFrame) -> DataFrame:
    return runs.select("item_id").distinct()


def aligned_runs(runs: DataFrame) -> DataFrame:
    """Per (model, item, language): runs present, sum, mean over 3 only when all 3 exist."""
    return runs.groupBy("model", "item_id", "lang").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("c").alias("sum_correct")).withColumn(
        "mean_correct", F.when(F.col("n_runs") == 3, F.col("sum_correct") / 3.0))


def policy_filter(surveys: DataFrame, policy: str) -> DataFrame:
    if policy == "all":
        return surveys
    if policy == "either":
        return surveys.filter(P.either_not_wrong())
    if policy == "both":
        return surveys.filter(P.neither_wrong())
    raise ValueError(policy)


def with_differences(r: DataFrame) -> DataFrame:
    """ST11: gaps between appropriate and inappropriate items, in the language and in English, and their difference."""
    return (r.withColumn("diff", F.col("app_acc") - F.col("inapp_acc")).withColumn("en_diff", F.col("en_app_acc") - F.col("en_inapp_acc"))
            .withColumn("did", F.col("diff") - F.col("en_diff")))


def lift_report(surveys: DataFrame, responses: DataFrame, policy: str) -> DataFrame:
    """Per (model, language): item totals by stratum, accuracy on appropriate / inappropriate items in the
    language and in English on the same items, their gaps and the difference-in-differences.

    Denominators count every item of the stratum (S12: a missing run mean
    adds nothing to the sum but keeps its item in the denominator).

    Surveys are counted per (item, language, stratum) before they meet the
    answers, whose runs are summed as integers. Both sides grow with the data and
    their stored tables are much smaller than their rows in memory, so the joins are merges: none is sent to the driver.
    """
    runs = item_runs(responses, materialize=True)
    app = P.both_typical().cast("int")
    strata = (policy_filter(surveys, policy).filter(F.col("lang") != "en").groupBy(F.col("answer_item").alias("item_id"), "lang")
              .agg(F.sum(app).alias("n_app"), F.sum(1 - app).alias("n_inapp")))
    strata = strata.join(assessed_items(runs).hint("merge"), "item_id", "left_semi")
    strata = materialize_table(strata, "survey-strata").hint("merge")  # read by three branches: one survey scan
    acc = aligned_runs(runs).select("model", "item_id", "lang", F.when(F.col("n_runs") == 3, F.col("sum_correct")).alias("m"))
    tot = strata.groupBy("lang").agg(F.sum("n_app").alias("n_app"), F.sum("n_inapp").alias("n_inapp"))

    def sums(joined: DataFrame, app_name: str, inapp_name: str) -> DataFrame:
        return joined.groupBy("model", "lang").agg((F.sum(F.col("n_app") * F.col("m")) / 3.0).alias(app_name),
                                                   (F.sum(F.col("n_inapp") * F.col("m")) / 3.0).alias(inapp_name))

    s_lang = sums(strata.join(acc, ["item_id", "lang"]), "s_app", "s_inapp")
    acc_en = acc.filter(F.col("lang") == "en").drop("lang")
    s_en = sums(strata.join(acc_en, "item_id"), "e_app", "e_inapp")
    r = s_lang.join(s_en, ["model", "lang"], "full").join(tot, "lang")

    def pct(s, n):
        return F.try_divide(F.coalesce(F.col(s), F.lit(0.0)) * 100.0, F.col(n).cast("double"))

    r = r.select("model", "lang", "n_app", "n_inapp",
                 pct("s_app", "n_app").alias("app_acc"), pct("s_inapp", "n_inapp").alias("inapp_acc"),
                 pct("e_app", "n_app").alias("en_app_acc"), pct("e_inapp", "n_inapp").alias("en_inapp_acc"))
    return with_differences(r)
