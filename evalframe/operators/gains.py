"""Fine-tuning gains over the un-tuned baseline (J6, J10, AG10, A-XL/QQ/GAIN/DIST/QD).

Everything starts from per-trial accuracy cells (one hash aggregate over
the fact table); later steps work on those cells only, whose number is
bounded by the experiment grid (train data × train lang × eval data ×
eval lang × trial), so joins between them are tiny and AQE broadcasts them
from measured sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.operators import checks

from evalframe import dims
from evalframe.operators import accuracy as acc

FT_KEYS = ["train_data", "train_lang", "benchmark", "eval_lang"]


def ft_mean_acc(responses: DataFrame, quality_runs: bool = False,
                extra_keys: Sequence[str] = ()) -> DataFrame:
    """Mean over trials of unrounded accuracy for fine-tuned runs."""
    r = responses.filter(F.col("was_ft"))
    r = r.filter(F.col("quality").isNotNull() if quality_runs else F.col("quality").isNull())
    return acc.mean_over_trials(r, [*FT_KEYS, *extra_keys])


def gains(responses: DataFrame, base_model: str) -> DataFrame:
    """Full-data gain per (train data, train lang, eval data, eval lang): mean acc − baseline."""
    m = ft_mean_acc(responses)
    return acc.gain_over_baseline(m, acc.baselines(responses, base_model))


def linguality(train_lang: Column, eval_lang: Column) -> Column:
    return F.when(train_lang == eval_lang, "mono-lingual").otherwise("cross-lingual")


def eligible_combos(responses: DataFrame, base_model: str, threshold_pct: int = dims.LIFT_THRESHOLD_PCT) -> DataFrame:
    """(train data, eval data, language) whose mono-lingual lift ≥ threshold.

    Lift is computed on the published rounding: rounded mean of rounded
    per-trial percentages minus the rounded baseline, in exact tenths.
    """
    cells = acc.mean_std_over_trials(acc.full_data_runs(responses), FT_KEYS)
    base = acc.baselines(responses, base_model)
    mono = cells.filter(F.col("train_lang") == F.col("eval_lang"))
    j = mono.join(base, ["benchmark", "eval_lang"])
    lift = F.round(F.col("mean_pct") * 10).cast("bigint") - F.col("base_tenths")
    return (j.filter(lift >= threshold_pct * 10)
            .select("train_data", "benchmark", F.col("eval_lang").alias("lang"),
                    (lift / 10.0).alias("lift_pct")))


def five_numbers(value: Column) -> list[Column]:
    """ST5 box plot with whiskers at 0/100 %: exact linear-interpolated percentiles."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ["p_min", "p_q1", "p_median", "p_q3", "p_max"]
    return [p.getItem(i).alias(n) for i, n in enumerate(names)]


def step_gains(cells: DataFrame, keys: list[str], axis: str, upper: str, lower: str, value: str = "m") -> DataFrame:
    """``(*keys, gain)``: by how much the cell at ``upper`` of an axis exceeds that at ``lower``, where both exist.

    One aggregate per key instead of a self-join; a repeated cell raises.
    """
    what = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    of = lambda x: checks.the_only(F.col(axis).eqNullSafe(x), F.col(value), "double", F.concat(what, F.lit(f", {x}")))
    steps = cells.groupBy(*keys).agg((of(upper) - of(lower)).alias("gain"))
    return steps.filter(F.col("gain").isNotNull())
