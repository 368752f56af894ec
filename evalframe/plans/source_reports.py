"""Sources and sinks exercised end to end and the
streaming scorer (§2.12 STR1). Each query writes derived data to a fresh folder under the shared
checkpoint dir and reads it back with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.plans import accuracy_reports, curation_reports
from evalframe.plans.catalog import register
from evalframe.sources import files, layouts, release
from evalframe.sources.tables import read_table, v_generations, v_items
from evalframe.streaming import running_accuracy as stream

PART_SCHEMA = T.StructType([
    T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
    T.StructField("p_brand", T.StringType()), T.StructField("p_type", T.StringType()),
    T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])


@register("src_csv_roundtrip", """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, round(p_retailprice, 6) AS p_retailprice FROM part
""")
def src_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: header CSV written and read back with a declared schema (doubled-quote escapes)."""
    path = files.scratch_path(spark, "part-csv")
    files.write_csv(read_table(spark, sf_dir, "part"), path)
    return files.read_csv(spark, path, PART_SCHEMA)


@register("src_mc_items", "SELECT question, opt_a, opt_b, opt_c, opt_d, answer FROM v_items")
def src_mc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: headerless multiple-choice CSV, positional columns _c0.._c5 named after the read."""
    path = files.scratch_path(spark, "mc-items")
    files.write_csv(v_items(spark, sf_dir).select(*files.MC_ITEM_NAMES), path, header=False)
    return files.read_mc_items(spark, path)


@register("src_files_by_lang", "SELECT lang, split, COUNT(*) AS n_rows FROM v_items GROUP BY ALL")
def src_files_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: one folder per (language, split); the key is recovered from the file path, and a missing
    (language, split) file simply contributes no rows."""
    path = files.scratch_path(spark, "items-by-lang")
    items = v_items(spark, sf_dir).select("item_no", "question", "answer", "lang", "split")
    files.write_csv(items, path, partition_by=["lang", "split"])
    schema = T.StructType([T.StructField("item_no", T.LongType()), T.StructField("question", T.StringType()),
                           T.StructField("answer", T.StringType())])
    df = (spark.read.schema(schema).option("header", True).option("escape", '"')
          .option("recursiveFileLookup", True).csv(path))
    df = files.with_file_name(df, r"lang=([^/]+)/", 1, "lang")
    df = files.with_file_name(df, r"split=([^/]+)/", 1, "split")
    return df.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("snk_jsonl_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def snk_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2 / SRC3: JSON lines with non-ASCII text kept, read back with a declared schema."""
    path = files.scratch_path(spark, "chat-jsonl")
    files.write_jsonl(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), path)
    return files.read_json(spark, path, files.CHAT_SCHEMA)


SNK3_KEYS = ["lang", "train", "eval", "quality", "pct"]


@register("snk_partitioned", f"""
WITH {curation_reports.FRACTIONS_SQL},
rows_ AS (
  SELECT lang, train, CAST(NULL AS VARCHAR) AS eval, CAST(NULL AS VARCHAR) AS quality, CAST(NULL AS BIGINT) AS pct FROM tr
  UNION ALL SELECT lang, train, eval, quality, CAST(pct AS BIGINT) FROM smp)
SELECT lang, train, eval, quality, pct, COUNT(*) AS n_rows FROM rows_ GROUP BY ALL
""")
def snk_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: training sets written one folder per key combination (partitionBy), counted back from disk."""
    path = files.scratch_path(spark, "training-sets")
    sets = curation_reports.build_training_sets(spark, sf_dir)
    files.write_jsonl(sets, path, partition_by=SNK3_KEYS)
    schema = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("messages", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("train", T.StringType()),
                           T.StructField("eval", T.StringType()), T.StructField("quality", T.StringType()),
                           T.StructField("pct", T.LongType())])
    back = spark.read.schema(schema).json(path)
    return back.groupBy(*SNK3_KEYS).agg(F.count(F.lit(1)).alias("n_rows"))


RELEASE_NAMES = {"question": "Question", "opt_a": "OptionA", "opt_b": "OptionB", "opt_c": "OptionC",
                 "opt_d": "OptionD", "answer": "Answer"}


@register("release_normalise", """
SELECT section, split, lang, COUNT(*) AS n_written, COUNT(*) AS n_expected, true AS counts_match
FROM v_items GROUP BY ALL
""")
def release_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6: names of the release schema, published by (section, split, lang) with its audit: written rows per partition
    against the source's."""
    by = ["section", "split", "lang"]
    items = v_items(spark, sf_dir)
    rows = items.select(*[F.col(a).alias(b) for a, b in RELEASE_NAMES.items()], *by)
    expected = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n_expected"))
    return release.publish(rows, files.scratch_path(spark, "release"), "1", by, expected)


@register("release_rows", """
SELECT section, split, lang, question AS "Question", opt_a AS "OptionA", opt_d AS "OptionD", answer AS "Answer" FROM v_items
""")
def release_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6: the rows of a release that was published twice, read by its manifest."""
    by = ["section", "split", "lang"]
    items, path = v_items(spark, sf_dir), files.scratch_path(spark, "release")
    rows = items.select(*[F.col(a).alias(b) for a, b in RELEASE_NAMES.items()], *by)
    expected = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n_expected"))
    for _ in range(2):  # the second changes nothing
        release.publish(rows, path, "1", by, expected)
    return release.read_release(spark, path, "1").select("section", "split", "lang", "Question", "OptionA", "OptionD", "Answer")


WORD_FILES = [
    layouts.Layout("items", "mmlu", 6, stop=-1, skip="_(af|zu|xh)", unless="virology"),
    layouts.Layout("sentences", "winogrande", 8, 4, 7, header=True, skip="_(af|zu|xh)", unless="virology")]
_WORDS = r"length(regexp_replace(regexp_replace(coalesce({x}, ''), '\S+', 'x', 'g'), '\s+', '', 'g'))"


@register("word_count_files", f"""
WITH r AS (
  SELECT CASE WHEN doc_id % 3 = 0 THEN 'mmlu' WHEN doc_id % 3 = 1 THEN 'mmlu_virology' WHEN lang = 'es' THEN 'notes' ELSE 'winogrande' END AS kind,
    CASE lang WHEN 'en' THEN 'af' WHEN 'de' THEN 'zu' ELSE lang END AS lang, {_WORDS.format(x="translate(text, chr(10) || chr(13), '  ')")} AS n, {_WORDS.format(x="source")} AS s FROM documents),
f AS (SELECT kind || '_' || lang || '.csv' AS file, lang, CASE kind WHEN 'notes' THEN NULL WHEN 'winogrande' THEN 'sentences' ELSE 'items' END AS layout,
    CASE WHEN kind = 'notes' THEN 'unknown' WHEN lang IN ('af', 'zu') AND kind <> 'mmlu_virology' THEN 'skipped' ELSE 'counted' END AS status,
    COUNT(*) AS n_rows, SUM(CASE WHEN kind = 'winogrande' THEN n ELSE n + s END) AS w FROM r GROUP BY ALL),
g AS (SELECT file, lang, layout, status, n_rows, CAST(CASE WHEN status = 'counted' THEN w ELSE 0 END AS BIGINT) AS words FROM f)
SELECT * FROM g UNION ALL SELECT NULL, NULL, NULL, 'total', CAST(SUM(n_rows) AS BIGINT), CAST(SUM(words) AS BIGINT) FROM g
""")
def word_count_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-WC / SRC5: words per file and in total over a folder of three layouts, some files skipped, one unknown, one absent.

    ``documents`` as files: without header (first five of six columns count), with header (columns 4 to 6), and of no known layout."""
    path = files.scratch_path(spark, "word-files")
    text = F.translate("text", "\n\r", "  ")
    lang = F.when(F.col("lang") == "en", "af").when(F.col("lang") == "de", "zu").otherwise(F.col("lang"))
    m = F.col("doc_id") % 3
    kind = F.when(m == 0, "mmlu").when(m == 1, "mmlu_virology").when(F.col("lang") == "es", "notes").otherwise("winogrande")
    d = read_table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "source", F.concat(kind, F.lit("_"), lang, F.lit(".csv")).alias("name"), kind.alias("kind"))
    none = F.lit(None).cast("string")
    plain = d.filter("kind <> 'winogrande'").select(F.col("text").alias("a"), "source", none.alias("c"), none.alias("d"), none.alias("e"), F.lit("A").alias("f"), "name")
    titled = d.filter("kind = 'winogrande'").select(F.col("doc_id").cast("string").alias("qID"), *[F.lit(x).alias(x) for x in ("p", "q", "r")],
                                                    F.col("text").alias("sentence"), none.alias("option1"), none.alias("option2"), F.lit("1 2").alias("answer"), "name")
    layouts.write_named(plain, f"{path}/plain", "name")
    layouts.write_named(titled, f"{path}/titled", "name", header=True)
    return layouts.words_by_file(layouts.read_layouts(spark, path, WORD_FILES))


@register("snk_report_csv", accuracy_reports.HEADLINE_SQL)
def snk_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: the headline report written as one ordered CSV (report-sized) and read back."""
    path = files.scratch_path(spark, "report")
    rep = accuracy_reports.report_headline(spark, sf_dir)
    files.write_report_csv(rep, path, ["row_order", "row_label"])
    return spark.read.schema(rep.schema).option("header", True).csv(path)


@register("stream_running_accuracy", """
WITH g AS (SELECT custom_id, arg_max(content, event_id) AS content FROM v_generations GROUP BY custom_id),
p AS (
  SELECT regexp_extract(custom_id, '^(.*)-on-([a-z]+)-(.+)-([0-9]+)-answer-(.+)$', 1) AS model,
    regexp_extract(custom_id, '^(.*)-on-([a-z]+)-(.+)-([0-9]+)-answer-(.+)$', 2) AS lang,
    regexp_extract(custom_id, '^(.*)-on-([a-z]+)-(.+)-([0-9]+)-answer-(.+)$', 3) AS benchmark, custom_id, content
  FROM g),
s AS (SELECT model, lang, benchmark, CASE WHEN benchmark = 'winogrande' THEN
    coalesce(contains(content, right(custom_id, 1)) AND NOT contains(content, CAST(3 - CAST(right(custom_id, 1) AS INTEGER) AS VARCHAR)), false)
  ELSE coalesce(length(upper(replace(replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '(', ''), ')', ''))) > 0
    AND substr(upper(replace(replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '(', ''), ')', '')), 1, 1) = right(custom_id, 1), false) END AS correct
  FROM p)
SELECT model, lang, benchmark, COUNT(*) AS n_answers, CAST(SUM(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS n_correct
FROM s GROUP BY ALL
""")
def stream_running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1: answers land as several JSON-lines files; a Structured Streaming job (availableNow) keeps the
    last answer of each request and its score; the final counts equal the batch aggregate."""
    base = files.scratch_path(spark, "stream")
    src = f"{base}/answers"
    v_generations(spark, sf_dir).select(F.col("event_id").alias("seq"), "custom_id", "content").write.option("maxRecordsPerFile", 2500).json(src)
    return stream.run_available(spark, src, f"{base}/table", f"{base}/_checkpoint")
