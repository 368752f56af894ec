"""Pairing rows of one table by a rewritten key — without self-joins (J4, conversation turns).

A self-join reads the table once per role and shuffles the texts of every
side. Here every row computes the key of the pair (or group) it belongs to,
and ONE aggregate gathers the roles: one scan, one shuffle, and groups are
bounded by construction (two turns; one row per language and role of an
item). The
result stays clustered by the group key, so a following per-pair job (ROUGE)
needs no further exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.operators import checks


def _first(cond: Column, value: Column) -> Column:
    return F.first(F.when(cond, value), ignorenulls=True)


def consecutive_turns(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b): each user turn with the assistant reply at turn + 1.

    Equivalent to joining user rows to assistant rows on (conv_id, turn + 1)
    when (conv_id, turn) is unique; pairs missing either side are dropped.
    """
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    keyed = conv.filter(user | reply).withColumn(
        "turn_key", F.when(user, F.col("turn")).otherwise(F.col("turn") - 1))
    g = keyed.groupBy("conv_id", "turn_key").agg(
        _first(user, F.col("text")).alias("a"), _first(reply, F.col("text")).alias("b"),
        F.count(F.when(user, 1)).alias("n_user"), F.count(F.when(reply, 1)).alias("n_reply"))
    return g.filter((F.col("n_user") > 0) & (F.col("n_reply") > 0)).select(
        "conv_id", F.col("turn_key").alias("turn"), "a", "b")


def translation_triples(t: DataFrame, langs: Sequence[str] | None = None, raise_on: Sequence[str] = ()) -> DataFrame:
    """Each human translation with its English original and its machine translation.

    The source finds partners by rewriting the human id (``-{lang}-`` →
    ``-en-`` and → ``-gt-{lang}-``). Equivalently every row maps to a
    canonical key with its language / MT marker replaced by ``-~-``; rows of
    one item share it. One aggregate per canonical key gathers the item's
    rows (at most 1 + 2·|languages|: bounded by the language list, not by
    data); higher-order functions then pick, for every human row, the English
    row and the MT row of its language. ``langs`` optionally restricts the human languages.

    Exactly one row must match on either side. ``n_en`` and ``n_mt`` count them
    and ``status`` names the outcome (``ok``, ``missing``, ``repeated``: the worse
    side); only a single match is a partner, so no choice depends on the order
    of rows. A status in ``raise_on`` raises where a row has it.
    """
    human = F.col("approach").contains("Human")
    is_en = human & (F.col("target_lang") == "en")
    is_h = human & (F.col("target_lang") != "en")
    is_mt = F.col("question_id").contains("-gt-") & (F.col("target_lang") != "en")
    if langs is not None:
        is_h = is_h & F.col("target_lang").isin(list(langs))
    tag = F.concat(F.lit("-"), F.col("target_lang"), F.lit("-"))
    gt_tag = F.concat(F.lit("-gt-"), F.col("target_lang"), F.lit("-"))
    role = F.when(is_mt, "mt").when(is_en, "en").when(is_h, "h")
    canon = F.when(is_mt, F.replace("question_id", gt_tag, F.lit("-~-"))) \
        .otherwise(F.replace("question_id", tag, F.lit("-~-")))
    keyed = t.select(canon.alias("canon"), F.struct(
        role.alias("role"), "target_lang", "question_id", "benchmark", F.col("question").alias("text")).alias("r"))
    keyed = keyed.filter(F.col("r.role").isNotNull())
    g = keyed.groupBy("canon").agg(F.collect_list("r").alias("rows"))

    def pick(h):
        ens = F.filter("rows", lambda r: r["role"] == "en")
        mts = F.filter("rows", lambda r: (r["role"] == "mt") & (r["target_lang"] == h["target_lang"]))
        return F.struct(h.alias("h"), ens.alias("ens"), mts.alias("mts"))

    triples = g.select("canon", F.explode(F.transform(F.filter("rows", lambda r: r["role"] == "h"), pick)).alias("x"))
    n_en, n_mt = F.size("x.ens").cast("bigint"), F.size("x.mts").cast("bigint")

    def only(side: str, n: Column, field: str) -> Column:
        return F.when(n == 1, F.get(f"x.{side}", F.lit(0))[field])

    sides = [checks.status_of(n_en), checks.status_of(n_mt)]
    status = F.when(F.array_contains(F.array(*sides), checks.REPEATED), checks.REPEATED).otherwise(
        F.when(F.array_contains(F.array(*sides), checks.MISSING), checks.MISSING).otherwise(checks.OK))
    if raise_on:
        message = F.concat(F.lit("partners of "), F.col("x.h.question_id"), F.lit(": "), n_en.cast("string"), F.lit(" English, "), n_mt.cast("string"), F.lit(" machine"))
        status = checks.guarded(status, status.isin(*raise_on), message, "string")
    return triples.select(
        "canon", F.col("x.h.target_lang").alias("target_lang"), F.col("x.h.question_id").alias("question_id"),
        F.col("x.h.benchmark").alias("benchmark"), F.col("x.h.text").alias("question"),
        only("ens", n_en, "question_id").alias("en_id"), only("ens", n_en, "text").alias("en_text"), n_en.alias("n_en"),
        only("mts", n_mt, "question_id").alias("mt_id"), only("mts", n_mt, "text").alias("mt_text"), n_mt.alias("n_mt"), status.alias("status"))
