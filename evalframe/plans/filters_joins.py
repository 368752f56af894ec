"""Filters, projections, lookups and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe import dims
from evalframe.functions import predicates as P
from evalframe.operators import accuracy as acc
from evalframe.plans.accuracy_reports import LABELS_SQL, OOB_SQL
from evalframe.plans.catalog import register
from evalframe.sources.tables import v_items, v_responses, v_surveys, v_workflow

BASE = dims.FIXTURE_BASELINE_MODEL
FLAGSHIP = dims.FIXTURE_FLAGSHIP_MODEL
DOC_LANGS = ["de", "en", "es", "fr"]  # languages of the driver's documents table


@register("filter_baseline_rows", f"""
SELECT response_id, model, benchmark, eval_lang, trial, CAST(correct AS BIGINT) AS correct FROM v_responses
WHERE NOT was_ft AND model = '{BASE}' AND contains(approach, 'Human') AND benchmark IS DISTINCT FROM 'mmlu-college_medicine'
""")
def filter_baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF1: conjunctive equality + boolean negation filter (the un-tuned baseline rows)."""
    r = acc.baseline_rows(v_responses(spark, sf_dir), BASE)
    return r.select("response_id", "model", "benchmark", "eval_lang", "trial", "correct")


@register("filter_contains", """
SELECT response_id, model, benchmark, approach FROM v_responses
WHERE contains(approach, '(gt)') AND NOT contains(benchmark, 'mmlu')
""")
def filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF2: substring predicate and its negation (machine-translated, non-MMLU rows)."""
    r = v_responses(spark, sf_dir)
    return r.filter(F.col("approach").contains("(gt)") & ~F.col("benchmark").contains("mmlu")).select(
        "response_id", "model", "benchmark", "approach")


@register("filter_null_partition", """
SELECT train_data, quality IS NULL AS full_data, COUNT(*) AS n_rows FROM v_responses WHERE was_ft GROUP BY ALL
""")
def filter_null_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF3: null as a state — full-data runs have no quality partition."""
    r = v_responses(spark, sf_dir).filter(F.col("was_ft"))
    return r.groupBy("train_data", F.col("quality").isNull().alias("full_data")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("project_rename", """
SELECT item_no, lang AS "language", split, question AS "Question", opt_a AS "OptionA", opt_b AS "OptionB",
  opt_c AS "OptionC", opt_d AS "OptionD", answer AS "Answer" FROM v_items
""")
def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF9: select / rename / drop / reorder (to the release column names)."""
    it = v_items(spark, sf_dir).drop("section")
    renames = {"lang": "language", "question": "Question", "opt_a": "OptionA", "opt_b": "OptionB",
               "opt_c": "OptionC", "opt_d": "OptionD", "answer": "Answer"}
    for a, b in renames.items():
        it = it.withColumnRenamed(a, b)
    return it.select("item_no", "language", "split", "Question", "OptionA", "OptionB", "OptionC", "OptionD", "Answer")


@register("dim_model_label", f"""
SELECT r.model, coalesce(lbl.model_label, r.model) AS model_label, COUNT(*) AS n_rows
FROM v_responses r LEFT JOIN {LABELS_SQL} ON r.model = lbl.model GROUP BY ALL
""")
def dim_model_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7 / PF11 / J5: inline dimension (model id → label) joined with a broadcast hint (fixed size)."""
    r = v_responses(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"))
    labels = F.broadcast(dims.model_label_dim(spark))
    return r.join(labels, "model", "left").select(
        "model", F.coalesce("model_label", "model").alias("model_label"), "n_rows")


@register("coerce_numeric", "SELECT wkey, dirty_number, TRY_CAST(dirty_number AS DOUBLE) AS value FROM v_workflow")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF12: dirty numeric text → number or null (``try_cast``)."""
    w = v_workflow(spark, sf_dir)
    return w.select("wkey", "dirty_number", F.col("dirty_number").try_cast("double").alias("value"))


@register("distinct_translators", """
SELECT coalesce(translator, '') AS translator, COUNT(*) AS n, COUNT(*) OVER () AS n_distinct FROM v_workflow GROUP BY 1
""")
def distinct_translators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF13 / AG11: null fill, value counts and the number of distinct values."""
    w = v_workflow(spark, sf_dir).na.fill({"translator": ""})
    vc = w.groupBy("translator").agg(F.count(F.lit(1)).alias("n"))
    return vc.withColumn("n_distinct", vc.agg(F.count(F.lit(1))).scalar())


@register("dense_grid", f"""
WITH m AS (SELECT DISTINCT model FROM v_responses WHERE {OOB_SQL}),
grid AS (SELECT m.model, b.benchmark, l.eval_lang FROM m,
  (VALUES {", ".join(f"('{b}')" for b in dims.BENCHMARKS)}) AS b(benchmark),
  (VALUES {", ".join(f"('{x}')" for x in dims.LANGUAGES)}) AS l(eval_lang)),
c AS (SELECT model, benchmark, eval_lang, COUNT(*) AS n FROM v_responses WHERE {OOB_SQL} GROUP BY ALL)
SELECT g.model, g.benchmark, g.eval_lang, coalesce(c.n, 0) AS n_total
FROM grid g LEFT JOIN c ON g.model = c.model AND g.benchmark = c.benchmark AND g.eval_lang = c.eval_lang
""")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF14: every (model, benchmark, language) label combination, zero when empty."""
    r = acc.out_of_box(v_responses(spark, sf_dir))
    return acc.dense_cells(r, ["model"], dims.BENCHMARKS, list(dims.LANGUAGES)).select(
        "model", "benchmark", "eval_lang", "n_total")


@register("except_english", """
SELECT DISTINCT model, eval_lang FROM v_responses
EXCEPT SELECT model, eval_lang FROM v_responses WHERE eval_lang = 'en'
""")
def except_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference (language list minus English) per model — EXCEPT DISTINCT.

    The subtracted set is a fixed one-row dimension, so the difference is a
    broadcast left-anti join after one distinct over the fact (one scan)."""
    r = v_responses(spark, sf_dir).select("model", "eval_lang").distinct()
    english = F.broadcast(spark.createDataFrame([("en",)], "eval_lang string"))
    return r.join(english, "eval_lang", "left_anti").select("model", "eval_lang")


J1_SQL = f"""j1 AS (
  SELECT s.survey_key, s.answer_item AS item_id, s.lang, s.quality_1, s.quality_2, s.approp_1, s.approp_2, r.response_id, r.correct
  FROM v_surveys s LEFT JOIN v_responses r ON r.item_id = s.answer_item AND r.eval_lang = s.lang
  WHERE contains(r.approach, 'Human') AND NOT r.was_ft AND r.model = '{FLAGSHIP}' AND r.benchmark = 'winogrande')"""


def _j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveys ⟕ answers on (item, language) with a filter on the right side — i.e. an inner join."""
    s = v_surveys(spark, sf_dir).drop("item_id").withColumnRenamed("answer_item", "item_id")
    r = v_responses(spark, sf_dir).filter(P.is_human() & ~F.col("was_ft") & (F.col("model") == FLAGSHIP)
                                          & (F.col("benchmark") == "winogrande"))
    r = r.select("item_id", F.col("eval_lang").alias("lang"), "response_id", "correct")
    return s.join(r, ["item_id", "lang"], "inner")


@register("join_left_composite", f"WITH {J1_SQL} SELECT survey_key, item_id, lang, response_id, CAST(correct AS BIGINT) AS correct FROM j1")
def join_left_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite, differently named keys (answer_item, lang) = (item_id, eval_lang)."""
    return _j1(spark, sf_dir).select("survey_key", "item_id", "lang", "response_id", "correct")


TARGET_SQL = ("CASE WHEN coalesce(contains(s.approp_1, 'Yes'), false) OR coalesce(contains(s.approp_2, 'Yes'), false) "
              "OR coalesce(contains(s.approp_1, 'Maybe'), false) OR coalesce(contains(s.approp_2, 'Maybe'), false) THEN 1 ELSE 0 END::BIGINT")
QUALITY_FLAG_SQL = ("CASE WHEN coalesce(contains(s.quality_1, 'Good'), false) AND coalesce(contains(s.quality_2, 'Good'), false) "
                    "THEN 1 ELSE 0 END::BIGINT")


def _targets(s: DataFrame) -> list:
    def has(c, word):
        return F.coalesce(F.col(c).contains(word), F.lit(False))
    target = F.when(has("approp_1", "Yes") | has("approp_2", "Yes") | has("approp_1", "Maybe") | has("approp_2", "Maybe"),
                    1).otherwise(0)
    quality = F.when(has("quality_1", "Good") & has("quality_2", "Good"), 1).otherwise(0)
    return [target.alias("target"), quality.alias("quality_flag")]


@register("derive_targets", f"SELECT survey_key, {TARGET_SQL} AS target, {QUALITY_FLAG_SQL} AS quality_flag FROM v_surveys s")
def derive_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: rater labels → target flags ("Yes"/"Maybe" in either → 1; "Good" from BOTH annotators, S24 fixed)."""
    s = v_surveys(spark, sf_dir)
    return s.select("survey_key", *_targets(s))


@register("join_workflow_survey", f"""
SELECT w.wkey, w.lang AS lang_x, s.survey_key, s.lang AS lang_y, {TARGET_SQL} AS target
FROM v_workflow w LEFT JOIN v_surveys s ON s.item_id = w.wkey
""")
def join_workflow_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-key left join with 1:n fan-out (4 languages per item) and _x/_y suffixes for clashing names."""
    w = v_workflow(spark, sf_dir).select("wkey", F.col("lang").alias("lang_x"))
    s = v_surveys(spark, sf_dir)
    s = s.select(F.col("item_id").alias("wkey"), "survey_key", F.col("lang").alias("lang_y"), *_targets(s)[:1])
    return w.join(s, "wkey", "left").select("wkey", "lang_x", "survey_key", "lang_y", "target")


@register("correction_rate", """
WITH c AS (SELECT lang, 100.0 * SUM(CASE WHEN correction IS NOT NULL THEN 1 ELSE 0 END) / COUNT(*) AS corrected_pct
           FROM v_workflow GROUP BY lang)
SELECT lang, round(corrected_pct, 6) AS corrected_pct, round(100 - corrected_pct, 6) AS not_corrected_pct,
  rank() OVER (ORDER BY corrected_pct DESC) AS rank FROM c
""")
def correction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8 / A-CORR: share of items needing correction per language, sorted."""
    w = v_workflow(spark, sf_dir)
    c = w.groupBy("lang").agg((F.avg(F.col("correction").isNotNull().cast("int")) * 100).alias("corrected_pct"))
    return c.select("lang", "corrected_pct", (100 - F.col("corrected_pct")).alias("not_corrected_pct"),
                    F.rank().over(Window.orderBy(F.col("corrected_pct").desc())).alias("rank"))


@register("one_hot", f"""
SELECT wkey, {", ".join(f"CAST(CASE WHEN lang = '{x}' THEN 1 ELSE 0 END AS BIGINT) AS lang_{x}" for x in DOC_LANGS)} FROM v_workflow
""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one-hot columns for a categorical (null → all zero), as ``when`` columns over the category list."""
    w = v_workflow(spark, sf_dir)
    return w.select("wkey", *[F.when(F.col("lang") == x, 1).otherwise(0).alias(f"lang_{x}") for x in DOC_LANGS])
