"""Data curation jobs: request tables, rating scores, quality tertiles, samples (W1–W4, SP1–SP6, ST6–ST8).

Orderings that decide *which* rows are taken (few-shot examples, samples,
tertiles) are total (a unique id closes every tie) and computed with the
skew-safe ``ranking.positions`` when groups are large, or with a
WindowGroupLimit top-k when only k rows per group are needed. Random
sampling is replaced by md5 order of (seed, id) — deterministic,
reproducible in SQL, and independent of partitioning (S22).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions import scoring as sc
from evalframe.operators import ranking


def md5_key(seed, *ids) -> Column:
    """Deterministic pseudo-random order key: md5 of "seed-id[-id...]"."""
    parts = [F.lit(str(seed))] + [F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]
    return F.md5(F.concat_ws("-", *parts))


def few_shot_blocks(rows: DataFrame, group_cols: Sequence[str], order_cols: Sequence, shot: Column, k: int = 5) -> DataFrame:
    """The first k rows per group rendered and concatenated in order: ``(group_cols, block, n_shots)``.

    ``shot`` may reference the column ``shot_no`` (1..k). Groups with fewer than
    k rows get the shots they have and say so in ``n_shots`` (see
    ``with_block``). ``collect_list`` here holds at most k rows per group.
    """
    top = ranking.top_k(rows, group_cols, order_cols, k, rank_col="shot_no")
    rendered = top.select(*group_cols, "shot_no", shot.alias("shot_text"))
    agg = rendered.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_shots"),
        F.array_sort(F.collect_list(F.struct("shot_no", "shot_text"))).alias("shots"))
    return agg.select(*group_cols, F.array_join(F.transform("shots", lambda s: s["shot_text"]), "").alias("block"), "n_shots")


def with_block(rows: DataFrame, blocks: DataFrame, on: Sequence[str], k: int = 5) -> DataFrame:
    """Every row with its group's block; ``status`` is 'ok', or 'short' where fewer than k shots exist (none: empty block)."""
    j = rows.join(blocks, list(on), "left")
    n = F.coalesce("n_shots", F.lit(0))
    return j.withColumn("block", F.coalesce("block", F.lit(""))).withColumn(
        "status", F.when(n < k, "short").otherwise("ok")).withColumn("n_shots", n)


def rating_scores(ratings: DataFrame) -> DataFrame:
    """ST8 / F12: one row per rated sample with the three runs, mean and sample std.

    The order key ``(score_sum, spread)`` is exact integer arithmetic that
    sorts like (mean, std) — 3·Σx² − (Σx)² = 6·variance — so ties never
    depend on floating-point summation order.
    """
    p = sc.parse_rating_id("custom_id")
    r = ratings.select(p["lang"].alias("lang"), p["train"].alias("train"), p["eval"].alias("eval"),
                       p["row_id"].alias("row_id"), p["trial"].alias("trial"),
                       F.col("content").try_cast("int").alias("score"))  # a non-numeric answer is a missing run
    g = r.groupBy("lang", "train", "eval", "row_id").agg(
        F.max(F.when(F.col("trial") == 0, F.col("score"))).alias("run_1"),
        F.max(F.when(F.col("trial") == 1, F.col("score"))).alias("run_2"),
        F.max(F.when(F.col("trial") == 2, F.col("score"))).alias("run_3"),
        F.count("score").alias("n_runs"),  # valid (numeric) answers only
        F.sum("score").alias("score_sum"),
        F.sum(F.col("score") * F.col("score")).alias("score_sumsq"),
        F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("std"))
    return g.withColumn("spread", F.col("n_runs") * F.col("score_sumsq") - F.col("score_sum") * F.col("score_sum"))


def histogram_bin(score_sum: Column, n_bins: int = 27) -> Column:
    """ST6 / S21: bin of a three-run mean on 27 bins of width 1/3 over [1, 10], last bin closed.

    (mean − 1)·3 = score_sum − 3 exactly, so no floating-point edge tests."""
    return F.least(score_sum - 3, F.lit(n_bins - 1))


def tertiles(scores: DataFrame) -> DataFrame:
    """ntile(3) over (mean, std, id) within (lang, train, eval) — first n % 3 buckets one larger."""
    ranked = ranking.positions(scores, ["lang", "train", "eval"], ["score_sum", "spread", "row_id"])
    tile = ranking.ntile_from_position(F.col("pos"), F.col("group_n"), 3)
    return ranked.withColumn("tile", tile).withColumn(
        "bucket", F.when(F.col("tile") == 1, "low").when(F.col("tile") == 2, "med").otherwise("high"))


def fraction_samples(rows: DataFrame, group_cols: Sequence[str], id_col: str, fractions: Sequence[int],
                     seed: int = 42) -> DataFrame:
    """SP2: nested samples of each group at the given percentages.

    Rows are ordered by md5(seed, id) once; the p % sample is the first
    round_half_even(n · p / 100) rows, so smaller samples are prefixes of
    larger ones (as same-seed samples are).
    """
    keyed = rows.withColumn("_h", md5_key(seed, id_col))
    pct = F.explode(F.array(*[F.lit(p) for p in fractions]))
    take = F.bround(F.col("group_n") * F.col("pct") / 100.0, 0)
    cut = ranking.cuts(keyed, group_cols, ["_h", id_col], take, {"pct": pct})
    out = ranking.with_cuts(keyed, cut, group_cols).filter(F.struct("_h", id_col) <= F.col("_cut"))
    return out.drop("_h", "_cut")
