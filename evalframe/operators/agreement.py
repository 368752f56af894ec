"""Rater agreement (AG5–AG7, ST1–ST3, J3 re-aimed).

Category lists are fixed by the survey design, so every statistic here is a
set of *conditional sums* evaluated in one hash aggregate (partial
aggregation map-side, one row per group through the shuffle). No contingency
table is materialised by joins, and no item is paired with itself per
language pair: pairwise statistics come from a per-item wide row and one
global aggregate with a fixed number of expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(r1: Column, r2: Column) -> Column:
    return r1.isNotNull() & r2.isNotNull()


def contingency(df: DataFrame, group_cols: Sequence[str], r1: str, r2: str,
                categories: Sequence[tuple[str, str]]) -> DataFrame:
    """AG6 / S14: dense (rater 1 × rater 2) counts over an explicit category list, zero-filled.

    ``categories`` is a list of (value, short label). Rows with a missing
    rating have no cell and are not counted.
    """
    exprs, items = [], []
    for i, (v1, l1) in enumerate(categories):
        for j, (v2, l2) in enumerate(categories):
            name = f"c_{i}_{j}"
            exprs.append(F.count(F.when((F.col(r1) == v1) & (F.col(r2) == v2), 1)).alias(name))
            items.append(f"'{l1}', '{l2}', {i}, {j}, {name}")
    wide = df.groupBy(*group_cols).agg(*exprs)
    stack = f"stack({len(items)}, {', '.join(items)}) as (rater_1, rater_2, i_1, i_2, n)"
    return wide.select(*group_cols, F.expr(stack))


def kappa_stats(df: DataFrame, group_cols: Sequence[str], r1: str, r2: str,
                categories: Sequence[str]) -> DataFrame:
    """ST1 / ST2: Cohen's and Fleiss' kappa for two raters per group.

    Cohen: pe = Σ_k (row_k / n)(col_k / n). Fleiss with two raters: each
    item agrees (P_i = 1) or not (0), category share p_k = (row_k + col_k) / 2n,
    pe = Σ p_k². kappa = (po − pe) / (1 − pe); null when pe = 1 (constant raters).
    Rows with a missing rating are left out.
    """
    return kappa_stats_many(df, group_cols, [("", r1, r2, categories)])


def kappa_stats_many(df: DataFrame, group_cols: Sequence[str], questions) -> DataFrame:
    """Several rater pairs in ONE aggregate: ``questions`` = [(prefix, r1, r2, categories), ...].
    Output per question: ``{prefix}n``, ``{prefix}p_o``, ``{prefix}cohen_kappa``, ``{prefix}fleiss_kappa``."""
    aggs, outs = [], []
    for q, (prefix, r1, r2, cats) in enumerate(questions):
        a, b = F.col(r1), F.col(r2)
        both = _both(a, b)
        aggs += [F.count(F.when(both, 1)).alias(f"n_{q}"), F.count(F.when(both & (a == b), 1)).alias(f"agree_{q}")]
        for k, c in enumerate(cats):
            aggs += [F.count(F.when(both & (a == c), 1)).alias(f"r_{q}_{k}"),
                     F.count(F.when(both & (b == c), 1)).alias(f"c_{q}_{k}")]
        n = F.col(f"n_{q}").cast("double")
        po = F.col(f"agree_{q}") / n
        pe_c = sum((F.col(f"r_{q}_{k}") * F.col(f"c_{q}_{k}") for k in range(len(cats))), F.lit(0)) / (n * n)
        pe_f = sum(((F.col(f"r_{q}_{k}") + F.col(f"c_{q}_{k}")) * (F.col(f"r_{q}_{k}") + F.col(f"c_{q}_{k}"))
                    for k in range(len(cats))), F.lit(0)) / (4 * n * n)
        outs += [F.col(f"n_{q}").alias(f"{prefix}n"), po.alias(f"{prefix}p_o"),
                 F.try_divide(po - pe_c, 1 - pe_c).alias(f"{prefix}cohen_kappa"),
                 F.try_divide(po - pe_f, 1 - pe_f).alias(f"{prefix}fleiss_kappa")]
    return df.groupBy(*group_cols).agg(*aggs).select(*group_cols, *outs)


def pairwise_binary(wide: DataFrame, cols: Sequence[str], include_diagonal: bool = True) -> DataFrame:
    """ST3 / J3 re-aimed: per ordered pair of binary columns, agreement counts and Cohen's kappa.

    ``wide`` has one row per item and one 0/1 (or null = absent) column per
    language. Each pair needs n (both present), n11, and the two marginals on
    the common items — all conditional sums in ONE global aggregate; the
    number of expressions is |cols|², independent of data size.
    """
    pairs = [(x, y) for x in cols for y in cols if include_diagonal or x != y]
    aggs = []
    for i, (x, y) in enumerate(pairs):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        aggs += [F.count(F.when(both, 1)).alias(f"n_{i}"),
                 F.sum(F.when(both, F.col(x) * F.col(y))).alias(f"n11_{i}"),
                 F.sum(F.when(both, F.col(x))).alias(f"nx_{i}"),
                 F.sum(F.when(both, F.col(y))).alias(f"ny_{i}")]
    s = wide.agg(*aggs)
    items = ", ".join(f"'{x}', '{y}', n_{i}, n11_{i}, nx_{i}, ny_{i}" for i, (x, y) in enumerate(pairs))
    long = s.select(F.expr(f"stack({len(pairs)}, {items}) as (lang_a, lang_b, n, n11, nx, ny)"))
    n = F.col("n").cast("double")
    n00 = F.col("n") - F.col("nx") - F.col("ny") + F.col("n11")
    po = (F.col("n11") + n00) / n
    pe = (F.col("nx") * F.col("ny") + (F.col("n") - F.col("nx")) * (F.col("n") - F.col("ny"))) / (n * n)
    return long.filter(F.col("n") > 0).select(
        "lang_a", "lang_b", "n", (F.col("n11") + n00).alias("n_agree"),
        F.try_divide(po - pe, 1 - pe).alias("kappa"))
