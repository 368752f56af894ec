"""Quality rules with cross-document line frequency, in DataFrame functions only.

Per text (one pass over the scan, no shuffle): words are runs without white
space (blank, tab to carriage return); counts of words, characters in words,
symbols, repeated lines, and words inside three-word windows that occur twice
or more. Repeated windows are found by sorting (window hash, place) inside the
row, only for texts that have any.

Across texts: lines are normalised (words joined by one blank, lower case,
digits to 0) and hashed; per host and line the distinct documents are counted
(by content: exact copies count once, removing them is another operator's
work). A line is boilerplate if more than ``min_docs`` documents and more than
``max_share`` of the host's documents hold it. A document is depleted, and
rejected, if fewer than ``min_left`` of its words are left without such lines.

Only hashes and counts are shuffled, pre-aggregated per (host, line, content),
so a line or host that holds a third of all rows is a partial sum per task.

Defined results: null and empty texts have no words and fail the base rule; a
null host is a host; repeated rows are judged alike (told apart by ``uid``);
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_DOCS, MAX_SHARE, MIN_LEFT = 20, 0.02, 0.3


def _words(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACE), "")


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``(doc_id, uid, host, content, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines)``.

    ``lines`` has (hash of the normalised line, number of words) of each line with a word.
    """
    x = docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("uid"),
                    F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    x = x.withColumn("ls", F.split("t", "\n")).withColumn("lw", F.transform("ls", _words))
    x = x.withColumn("full", F.filter("ls", lambda l: l.rlike(r"[^\x20\x09-\x0D]"))).withColumn("w", F.flatten("lw"))
    n = F.size("w")
    spots = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    x = x.withColumn("win", F.transform(spots, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    line = lambda ws: F.struct(
        F.xxhash64(F.lower(F.regexp_replace(F.array_join(ws, " "), "[0-9]+", "0"))).alias("h"), F.size(ws).alias("n"))
    x = x.select(
        "doc_id", "uid", "host", F.xxhash64("t").alias("content"), n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        F.transform(F.filter("lw", lambda ws: F.size(ws) > 0), line).alias("lines"), "win",
        (F.size(F.array_distinct("win")) < F.size("win")).alias("again"))
    pairs = F.when(F.col("again"), F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    x = x.withColumn("s", pairs)
    twice = F.filter("s", lambda e, i: F.coalesce(F.get("s", i - 1)["h"] == e["h"], F.lit(False))
                     | F.coalesce(F.get("s", i + 1)["h"] == e["h"], F.lit(False)))
    x = x.withColumn("at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + (i + 3 - F.greatest(a["end"], i))).alias("n"))
    return x.select("doc_id", "uid", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    F.coalesce(F.aggregate("at", zero, step)["n"], F.lit(0)).cast("long").alias("n_repeat_words"), "lines")


def frequent_lines(counts: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """``(host, h, n_docs)`` of the lines above both limits."""
    sizes = counts.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    one = counts.select("host", "content", F.explode("lines").alias("l")).select("host", F.col("l.h").alias("h"), "content").distinct()
    seen = one.groupBy("host", "h").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    return seen.join(sizes, "host").filter(F.col("n_docs") > F.col("host_docs") * max_share).select("host", "h", "n_docs")


def judge(docs: DataFrame, key: str = "doc_id", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
          min_left: float = MIN_LEFT) -> DataFrame:
    """Base counts, ``n_left_words`` after removal of frequent lines, ``base_failed`` and ``kept`` per row."""
    counts = materialize(text_counts(docs, key), "line-counts")
    lines = counts.select("uid", "host", F.explode("lines").alias("l")).select("uid", "host", F.col("l.h").alias("h"), F.col("l.n").alias("n"))
    lost = (lines.join(frequent_lines(counts, min_docs, max_share), ["host", "h"])
            .groupBy("uid").agg(F.sum("n").cast("long").alias("lost")))
    x = counts.drop("lines", "content", "host").join(lost, "uid", "left")
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (x.withColumn("n_left_words", left).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (left >= min_left * F.col("n_words"))).drop("lost"))


def remove_lines(docs: DataFrame, frequent: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The documents without their frequent lines: all columns, ``text`` rewritten."""
    per_host = frequent.groupBy("host").agg(F.collect_set("h").alias("_f"))  # at most lines per document / max_share entries
    norm = lambda l: F.xxhash64(F.lower(F.regexp_replace(F.array_join(_words(l), " "), "[0-9]+", "0")))
    x = docs.withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit(""))).join(per_host.withColumnRenamed("host", "_host"), "_host", "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda l: ~F.coalesce(F.array_contains("_f", norm(l)), F.lit(False)))
    return x.withColumn(text, F.array_join(kept, "\n")).select(*docs.columns)
