"""ROUGE-1 F1 between text pairs (F6) as a Spark job.

Multiset overlap (S18): for each word, min(count in a, count in b), summed.
F1 = 2PR / (P + R) with P = overlap/|a|, R = overlap/|b|; zero tokens on
either side or no overlap → 0.

Plan: texts are gathered by the pair id (one exchange of texts, or none if they
arrive clustered by it), and scored inside their row: the words of a text are
sorted and numbered among their equals ("the 0", "the 1", ...), so that the
overlap of two texts is the size of the intersection of two arrays. No words
are exploded, counted or joined across rows: a task's memory follows its longest
texts, whatever the number of rows. ``rouge1_pairs_of`` scores any pairs of a row's texts in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.text import tokens


def _f1(overlap: Column, len_a: Column, len_b: Column) -> Column:
    prec = F.try_divide(overlap.cast("double"), len_a.cast("double"))
    rec = F.try_divide(overlap.cast("double"), len_b.cast("double"))
    return F.when((len_a == 0) | (len_b == 0) | (overlap == 0), F.lit(0.0)).otherwise(2 * (prec * rec) / (prec + rec))


def _numbered(words: Column) -> Column:
    """Each word with its number among the equal ones; a word holds no space. ``words`` is sorted."""
    n = F.size(words)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))
    runs = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.transform(
        F.sequence(F.lit(0), r["e"] - r["s"] - 1), lambda j: F.concat(F.get(words, r["s"]), F.lit(" "), j.cast("string"))))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.flatten(runs))


def rouge1_pairs_of(rows: DataFrame, id_col, pairs: list[tuple[str, str]], num_partitions: int | None = None, partition: bool = True) -> DataFrame:
    """(ids, per pair k: len_a_k, len_b_k, overlap_k, rouge1_k) of pairs of text columns. Rows of the same id are one."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    texts = list(dict.fromkeys(t for pair in pairs for t in pair))
    p = rows.select(*ids, *[F.col(t).alias(f"_t{i}") for i, t in enumerate(texts)])
    if partition:  # by column only, so AQE sizes (coalesces / splits) the exchange from the data
        p = p.repartition(num_partitions, *ids) if num_partitions else p.repartition(*ids)
    p = p.groupBy(*ids).agg(*[F.collect_list(f"_t{i}").alias(f"_t{i}") for i in range(len(texts))])
    # one element of an array is bound to a lambda's variable, and so computed once
    words = F.array(*[F.array_sort(F.flatten(F.transform(f"_t{i}", tokens))) for i in range(len(texts))])
    at = {t: i for i, t in enumerate(texts)}

    def measured(w: Column) -> Column:
        return F.struct(*[c for k, (a, b) in enumerate(pairs) for c in (
            F.size(w[at[a]]).cast("bigint").alias(f"len_a_{k}"), F.size(w[at[b]]).cast("bigint").alias(f"len_b_{k}"),
            F.size(F.array_intersect(w[at[a]], w[at[b]])).cast("bigint").alias(f"overlap_{k}"))])

    p = p.select(*ids, F.explode(F.transform(F.array(F.transform(words, _numbered)), measured)).alias("m")).select(*ids, "m.*")
    return p.select("*", *[_f1(F.col(f"overlap_{k}"), F.col(f"len_a_{k}"), F.col(f"len_b_{k}")).alias(f"rouge1_{k}") for k in range(len(pairs))])


def rouge1_many(rows: DataFrame, id_col, ref: str, candidates: list[str],
                num_partitions: int | None = None, partition: bool = True) -> DataFrame:
    """ROUGE-1 of ``ref`` against each candidate column.

    ``id_col`` is one column or a list of columns identifying a row. With
    ``partition=False`` the caller guarantees rows are already clustered by
    (a subset of) the id columns — e.g. they come out of a group-by on them —
    and no exchange is added. Returns (ids, len_ref, and per candidate c:
    len_c, overlap_c, rouge1_c).
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    r = rouge1_pairs_of(rows, ids, [(ref, c) for c in candidates], num_partitions, partition)
    return r.select(*ids, F.col("len_a_0").alias("len_ref"), *[x for k, c in enumerate(candidates) for x in (
        F.col(f"len_b_{k}").alias(f"len_{c}"), F.col(f"overlap_{k}").alias(f"overlap_{c}"), F.col(f"rouge1_{k}").alias(f"rouge1_{c}"))])


def rouge1(pairs: DataFrame, pair_id, text_a: str, text_b: str, num_partitions: int | None = None,
           partition: bool = True) -> DataFrame:
    """Return (pair id column(s), len_a, len_b, overlap, rouge1) for every pair (empty text scores 0)."""
    ids = [pair_id] if isinstance(pair_id, str) else list(pair_id)
    r = rouge1_many(pairs, ids, text_a, [text_b], num_partitions, partition)
    return r.select(*ids, F.col("len_ref").alias("len_a"), F.col(f"len_{text_b}").alias("len_b"),
                    F.col(f"overlap_{text_b}").alias("overlap"), F.col(f"rouge1_{text_b}").alias("rouge1"))
