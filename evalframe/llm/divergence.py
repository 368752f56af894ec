"""Source divergence audit: how far the word shares of each source lie from the other sources' and its language's.

Counting: Arrow kernels split the texts, every task adds up (language, source,
term) counts and document counts before they are shuffled. Kept are the terms of
a language found in at least ``least_docs`` of its documents. A share is the
integer ``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``; all arithmetic
is in integers.

Pairs of sources: the kept terms of a language are dealt into blocks of about
``TERMS``, its sources into blocks of about ``GROUPS``; one task holds one block
of terms by two blocks of sources. There every (source, count level) is an
indicator column over the terms, level 0 included, and the product of the
columns with their transpose gives, for each pair of sources, the table of how
many terms have which two levels. Entries are counts of at most the block's terms,
so single precision is exact. A table is priced by the differences of the
levels' shares; a distance is linear in the table, so blocks are priced where
they are made and only sums leave the task.

Defined results: null text, language and source are ''; every occurring
(language, source) has its pairs, also without a term (value 0 where the language
keeps none); equal values are ranked by the item's bytes; an empty table gives
no rows; extra columns are ignored, copies of a document count each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.kernels import slices, words
from evalframe.llm.streams import arrow_schema
from evalframe.session import materialize

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, PRIOR = 1_000_000_000, 5
TERMS, GROUPS = 1024, 64
#: Indicator columns that are multiplied at once, and about how many partial counts a task holds before it hands them on.
COLUMNS, HELD = 2048, 250_000
#: Text that is split at once in a task (a longer single text is taken whole).
SLICE = 1 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, term, source, n, docs)`` of ``docs (lang, source, text)``: occurrences, and documents that hold the term."""
    out = "lang string, source string, term string, n long, docs long"
    schema = arrow_schema(out)
    keys = ["lang", "source", "term"]

    def added(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                row, index, dictionary = words(part.column("text"), SEPARATORS)
                if not len(row):
                    continue
                both = pc.value_counts(pa.array(row * len(dictionary) + index))  # one entry per (document, term)
                at = both.field("values").to_numpy(zero_copy_only=False)
                doc, term = pa.array(at // len(dictionary)), pa.array(at % len(dictionary))
                held.append(added([pa.table({
                    "lang": part.column("lang").take(doc), "source": part.column("source").take(doc),
                    "term": dictionary.take(term).cast(pa.string()), "n": both.field("counts"), "docs": pa.array(np.ones(len(at), np.int64))})]))
                rows += held[-1].num_rows
                if rows > HELD:
                    held = [added(held)]
                    rows = held[0].num_rows
                    if rows > HELD // 2:  # little left to add up: hand on
                        yield from held[0].cast(schema).to_batches(max_chunksize=50_000)
                        held, rows = [], 0
        if held:
            yield from added(held).cast(schema).to_batches(max_chunksize=50_000)

    return docs.select("lang", "source", "text").mapInArrow(run, out).groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The integer share; wide decimals, so that no product overflows. 0 where the language keeps no term."""
    whole = lambda c: c.cast("decimal(18,0)")
    top = (whole(count) + F.lit(PRIOR)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    base = (whole(total) + whole(terms) * F.lit(PRIOR)).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", top, base) + 1).otherwise(0).cast("long")


def one_hot(counts: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indicator columns of all (group, level), share of each column, first column of each group) of a terms x groups block."""
    columns, price, starts, n = [], [], [], 0
    for g in range(counts.shape[1]):
        levels, first, which = np.unique(counts[:, g], return_index=True, return_inverse=True)
        columns.append(which[:, None] == np.arange(len(levels)))
        price.append(shares[first, g])
        starts.append(n)
        n += len(levels)
    return np.hstack(columns).astype(np.float32), np.concatenate(price), np.array(starts)


def _chunks(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Ranges of groups whose columns come to about ``COLUMNS``."""
    out, a = [], 0
    ends = np.append(starts[1:], width)
    for g in range(len(starts)):
        if g > a and ends[g] - starts[a] > COLUMNS:
            out.append((a, g))
            a = g
    return [*out, (a, len(starts))]


def distances(counts: np.ndarray, shares: np.ndarray, times: np.ndarray, left: int) -> np.ndarray:
    """Sums of share differences between the first ``left`` groups and the others (all with all if ``left`` is all of them).

    ``counts`` and ``shares`` are terms x groups, ``times`` says how many terms a row stands for.
    """
    if left == counts.shape[1]:
        a = b = (0, left)
    else:
        a, b = (0, left), (left, counts.shape[1])
    x, px, sx = one_hot(counts[:, a[0]:a[1]], shares[:, a[0]:a[1]])
    y, py, sy = (x, px, sx) if a == b else one_hot(counts[:, b[0]:b[1]], shares[:, b[0]:b[1]])
    weighted = y * times[:, None].astype(np.float32)
    out = np.zeros((len(sx), len(sy)), np.int64)
    ex, ey = np.append(sx, x.shape[1]), np.append(sy, y.shape[1])
    for i0, i1 in _chunks(sx, x.shape[1]):
        for j0, j1 in _chunks(sy, y.shape[1]):
            ci, cj = slice(ex[i0], ex[i1]), slice(ey[j0], ey[j1])
            joint = np.rint(x[:, ci].T @ weighted[:, cj]).astype(np.int64)  # the joint tables of these groups
            cost = joint * np.abs(px[ci, None] - py[None, cj])
            cost = np.add.reduceat(cost, sx[i0:i1] - ex[i0], axis=0)
            out[i0:i1, j0:j1] = np.add.reduceat(cost, sy[j0:j1] - ey[j0], axis=1)
    return out


def _pairs(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"lang": object, "a": object, "b": object, "value": np.int64}
    return pd.DataFrame({c: np.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})


def _unit(rows: pd.DataFrame) -> pd.DataFrame:
    """One block of terms by two blocks of sources: ``(lang, a, b, value)`` for a < b."""
    head, body = rows[rows["term"].isna()], rows[rows["term"].notna()]
    two = rows["bi"].iat[0] != rows["bj"].iat[0]
    head = head.sort_values(["block", "source"], key=lambda c: c if c.name == "block" else c.map(str.encode))
    names = list(head["source"])
    left = int((head["block"] == rows["bi"].iat[0]).sum()) if two else len(names)
    if two and left in (0, len(names)):  # a block without sources
        return _pairs([])
    at = {s: k for k, s in enumerate(names)}
    codes, terms = pd.factorize(body["term"])
    counts = np.zeros((len(terms) + 1, len(names)), np.int64)  # the last row stands for terms that none of these sources has
    shares = np.tile(head["p"].to_numpy(np.int64), (len(terms) + 1, 1))
    cols = body["source"].map(at).to_numpy(np.int64)
    counts[codes, cols], shares[codes, cols] = body["n"].to_numpy(np.int64), body["p"].to_numpy(np.int64)
    times = np.append(np.ones(len(terms), np.int64), int(head["n"].iat[0]) - len(terms))
    value = distances(counts, shares, times, left)
    others = names[left:] if two else names
    out = [(rows["lang"].iat[0], a, b, int(value[i, j])) if a.encode() < b.encode() else (rows["lang"].iat[0], b, a, int(value[i, j]))
           for i, a in enumerate(names[:left]) for j, b in enumerate(others) if two or i < j]
    return _pairs(out)


def source_pairs(kept: DataFrame, groups: DataFrame, terms: int = TERMS, group_block: int = GROUPS) -> DataFrame:
    """``(lang, source, item, value)`` of every ordered pair of sources of a language.

    ``kept (lang, term, source, n, p)``; ``groups (lang, source, n_groups, n_terms, p0)``.
    """
    n_tb = F.greatest(F.ceil(F.col("n_terms") / terms), F.lit(1)).cast("int")
    n_gb = F.ceil(F.col("n_groups") / group_block).cast("int")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    size = groups.select("lang", n_tb.alias("n_tb"), n_gb.alias("n_gb")).distinct()
    body = kept.join(size, "lang").withColumn("tb", dealt("term", F.col("n_tb"))).withColumn("block", dealt("source", F.col("n_gb")))
    in_block = body.groupBy("lang", "tb").agg(F.count_distinct("term").alias("in_block"))
    head = groups.select("*", n_tb.alias("n_tb"), n_gb.alias("n_gb")).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("n_tb") - 1)))
    head = head.withColumn("block", dealt("source", F.col("n_gb"))).join(in_block, ["lang", "tb"], "left")
    head = head.select("lang", "tb", "n_gb", "block", "source", F.lit(None).cast("string").alias("term"),
                       F.coalesce("in_block", F.lit(0)).cast("long").alias("n"), F.col("p0").alias("p"))
    rows = head.unionByName(body.select("lang", "tb", "n_gb", "block", "source", "term", "n", "p"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_gb") - 1)))
    rows = rows.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other")).drop("other", "n_gb")
    found = rows.groupBy("lang", "tb", "bi", "bj").applyInPandas(_unit, "lang string, a string, b string, value long")
    found = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return found.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances to the other sources, and the terms a source has too much of."""
    whole = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs = docs.select(whole(lang, "lang"), whole(source, "source"), whole(text, "text"))
    counts = materialize(term_counts(docs), "term-counts")
    lang_terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("n_lang")).filter(F.col("in_docs") >= least_docs)
    kept = materialize(counts.select("lang", "term", "source", "n").join(lang_terms.select("lang", "term", "n_lang"), ["lang", "term"]), "kept-terms")

    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_term = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang"))
    by_lang = by_term.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("n_lang").alias("lang_total"))
    groups = docs.select("lang", "source").distinct()
    n_groups = groups.groupBy("lang").agg(F.count("*").alias("n_groups"))
    groups = groups.join(n_groups, "lang").join(by_lang, "lang", "left").join(by_source, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["n_terms", "lang_total", "total"])
    groups = materialize(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("n_terms"))), "groups")

    priced = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("n_terms")))
    q = share(F.col("n_lang"), F.col("lang_total"), F.col("n_terms"))
    per_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = priced.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0")
    over = over.withColumn("rank", F.row_number().over(per_group)).filter(F.col("rank") <= top_terms)
    pairs = source_pairs(priced.select("lang", "term", "source", "n", "p"), groups.select("lang", "source", "n_groups", "n_terms", "p0"))
    pairs = pairs.withColumn("rank", F.row_number().over(per_group))
    cols = ["lang", "source", "part", "item", "value", F.col("rank").cast("long").alias("rank")]
    return pairs.withColumn("part", F.lit("pair")).select(*cols).unionByName(over.withColumn("part", F.lit("term")).select(*cols))
