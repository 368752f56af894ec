"""Accuracy aggregates over the answers fact (AG1–AG4, AG15, PF14, J6, J10).

All of these are hash aggregates with partial (map-side) aggregation: the
shuffle carries one row per (task, group), never raw answers. Groups are
dimension combinations (model × benchmark × language × trial), so their
number is bounded by the study design even when the fact table is 100 TB;
a hot group only makes its partial sums bigger, not its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.numeric import mean_tenths, pct_tenths, safe_ratio
from evalframe.functions.predicates import is_human
from evalframe.operators import checks
from evalframe.session import materialize as materialize_table


FACT_KEYS = ["model", "was_ft", "approach", "train_data", "train_lang", "quality", "pct_used",
             "benchmark", "eval_lang", "trial"]


def fact_cells(responses: DataFrame, materialize: bool = True) -> DataFrame:
    """One pass over the answers fact: (n_correct, n_total) per trial-level cell of the study grid.

    The cell count is bounded by the dimensions (models × approaches × train
    sets × languages × qualities × quantities × benchmarks × trials), not by
    the data. Reports with several branches read this table instead of the
    fact: Catalyst pushes each branch's filters below its own aggregate, so
    branches over the raw fact could not share one scan. ``materialize``
    writes the cells once as a table in the shared checkpoint folder (tiny;
    deterministic; cuts the lineage back to the fact for executor loss).
    """
    cells = responses.groupBy(*FACT_KEYS).agg(
        F.sum(F.col("correct").cast("bigint")).alias("n_correct"), F.count(F.lit(1)).alias("n_total"))
    if materialize:
        cells = materialize_table(cells, "fact-cells")
    return cells


def _counts(df: DataFrame, correct: str) -> tuple[Column, Column]:
    """(correct, total) aggregates for raw answer rows or for pre-aggregated cells."""
    if "n_total" in df.columns:
        return F.sum("n_correct"), F.sum("n_total")
    return F.sum(F.col(correct).cast("bigint")), F.count(F.lit(1))


def accuracy(df: DataFrame, keys: Sequence[str], correct: str = "correct") -> DataFrame:
    """AG1: sum(correct) / count(*) per key set, plus exact 0.1-point percentage.

    Accepts raw answer rows or ``fact_cells`` (sums of the cell counts)."""
    num, den = _counts(df, correct)
    agg = df.groupBy(*keys).agg(num.alias("n_correct"), den.alias("n_total"))
    return agg.select(
        *keys, "n_correct", "n_total",
        safe_ratio("n_correct", "n_total").alias("accuracy"),
        pct_tenths("n_correct", "n_total").alias("acc_tenths"),
    )


def out_of_box(responses: DataFrame) -> DataFrame:
    """PF1: un-tuned models on human translations."""
    return responses.filter(~F.col("was_ft") & is_human())


def baseline_rows(responses: DataFrame, base_model: str) -> DataFrame:
    """PF1 baseline: the un-tuned base model on human translations, fine-tuning eval benchmarks."""
    return responses.filter(
        ~F.col("was_ft") & (F.col("model") == base_model) & is_human()
        & ~F.col("benchmark").eqNullSafe("mmlu-college_medicine"))


def baselines(responses: DataFrame, base_model: str) -> DataFrame:
    """Baseline accuracy per (benchmark, language) — the reference's ``baselines_ft``."""
    b = accuracy(baseline_rows(responses, base_model), ["benchmark", "eval_lang"])
    return b.select("benchmark", "eval_lang", F.col("accuracy").alias("base_acc"),
                    F.col("acc_tenths").alias("base_tenths"))


def full_data_runs(responses: DataFrame) -> DataFrame:
    """PF3: fine-tuned on the full training set (no quality partition)."""
    return responses.filter(F.col("was_ft") & F.col("quality").isNull())


def trial_accuracy(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy per trial (first stage of AG2/AG3)."""
    return accuracy(df, [*keys, "trial"])


def mean_over_trials(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG2: mean over trials of the *unrounded* per-trial accuracy."""
    t = trial_accuracy(df, keys)
    return t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.avg("accuracy").alias("mean_acc"),
    )


def mean_std_over_trials(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG3: per-trial accuracy rounded to 0.1 first, then mean (rounded) and sample std."""
    t = trial_accuracy(df, keys)
    return t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"),
        mean_tenths(F.sum("acc_tenths"), F.count("acc_tenths")).alias("mean_tenths"),
        F.stddev_samp(F.col("acc_tenths") / 10.0).alias("std_pct"),
    ).select(*keys, "n_trials", (F.col("mean_tenths") / 10.0).alias("mean_pct"), "std_pct")


def macro_average(df: DataFrame, keys: Sequence[str], over: str = "eval_lang") -> DataFrame:
    """AG4: accuracy per (keys, language) rounded first, then averaged over languages."""
    per = accuracy(df, [*keys, over])
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_langs"),
        mean_tenths(F.sum("acc_tenths"), F.count("acc_tenths")).alias("avg_tenths"),
    ).select(*keys, "n_langs", (F.col("avg_tenths") / 10.0).alias("avg_pct"))


def pivot_languages(long: DataFrame, keys: Sequence[str], value: str, langs: Sequence[str],
                    lang_col: str = "eval_lang") -> DataFrame:
    """AG15: long -> wide with an explicit value list (no extra distinct job, C1).

    A repeated (keys, language) cell raises (S10), counted by the aggregate
    that makes the row. Written as conditional aggregates (one per language) —
    the same plan a pivot with a value list produces, without its PivotFirst bookkeeping.
    """
    kind = dict(long.dtypes)[value]
    row = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return long.groupBy(*keys).agg(*[
        checks.the_only(F.col(lang_col).eqNullSafe(x), F.col(value), kind, F.concat(row, F.lit(f", {x}"))).alias(x) for x in langs])


def dense_cells(df: DataFrame, row_keys: Sequence[str], benchmarks: Sequence[str], langs: Sequence[str],
                correct: str = "correct") -> DataFrame:
    """PF14 without a grid join: one aggregate per ``row_keys`` holding, for every (benchmark, language)
    of the fixed lists, the answer count and correct count; exploded back to one row per cell.
    Empty cells come out with n_total = 0 (accuracy null), as the dense grid requires."""
    pre = "n_total" in df.columns
    cells = []
    for b in benchmarks:
        for lang in langs:
            hit = (F.col("benchmark") == b) & (F.col("eval_lang") == lang)
            total = F.coalesce(F.sum(F.when(hit, F.col("n_total"))), F.lit(0)) if pre else F.count(F.when(hit, 1))
            good = F.sum(F.when(hit, F.col("n_correct"))) if pre else F.sum(F.when(hit, F.col(correct).cast("bigint")))
            cells.append(F.struct(F.lit(b).alias("benchmark"), F.lit(lang).alias("eval_lang"),
                                  total.alias("n_total"), good.alias("n_correct")))
    per = df.groupBy(*row_keys).agg(F.array(*cells).alias("cells"))
    out = per.select(*row_keys, F.explode("cells").alias("x"))
    return out.select(*row_keys, "x.benchmark", "x.eval_lang", "x.n_total",
                      F.coalesce("x.n_correct", F.lit(0)).alias("n_correct"),
                      pct_tenths("x.n_correct", "x.n_total").alias("acc_tenths"))


def gain_over_baseline(acc: DataFrame, base: DataFrame, value: str = "mean_acc") -> DataFrame:
    """Subtract the baseline of (benchmark, eval language).

    No broadcast hint: the baseline is data-derived, so AQE decides from the
    measured size of its (already aggregated) stage output.
    """
    return acc.join(base, ["benchmark", "eval_lang"], "inner").withColumn(
        "gain", F.col(value) - F.col("base_acc"))
