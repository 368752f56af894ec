"""Accuracy reports over the answers fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe import dims
from evalframe.functions.numeric import mean_tenths
from evalframe.operators import accuracy as acc
from evalframe.plans.catalog import register
from evalframe.sources.tables import v_responses

LANGS = dims.FIXTURE_LANGUAGES
AFRICAN = [lang for lang in LANGS if lang != "en"]

# Shared oracle fragments ---------------------------------------------------
TENTHS_SQL = "CAST(FLOOR((SUM(correct) * 2000 + COUNT(*)) / (COUNT(*) * 2.0)) AS BIGINT)"
MEAN_TENTHS_SQL = "CAST(FLOOR((SUM({t}) * 2 + COUNT({t})) / (COUNT({t}) * 2.0)) AS BIGINT)"
OOB_SQL = "NOT was_ft AND contains(approach, 'Human')"
LABELS_SQL = "(VALUES " + ", ".join(
    f"('{m}', '{lab}', {i})" for i, (m, lab) in enumerate(dims.FIXTURE_MODEL_LABELS.items())) + \
    ") AS lbl(model, model_label, model_order)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers fact reduced once to trial-level cells (for reports with several branches)."""
    return acc.fact_cells(v_responses(spark, sf_dir))


def _bench_col(b: str) -> str:
    return b.replace("-", "_")


# AG1 ----------------------------------------------------------------------
@register("acc_by_model_bench_lang", f"""
SELECT model, benchmark, eval_lang,
  CAST(SUM(correct) AS BIGINT) AS n_correct, COUNT(*) AS n_total,
  round(SUM(correct) / COUNT(*), 6) AS accuracy,
  {TENTHS_SQL} AS acc_tenths
FROM v_responses WHERE {OOB_SQL}
GROUP BY model, benchmark, eval_lang
""")
def acc_by_model_bench_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: out-of-the-box accuracy per model, benchmark and language."""
    return acc.accuracy(acc.out_of_box(v_responses(spark, sf_dir)), ["model", "benchmark", "eval_lang"])


# AG2 ----------------------------------------------------------------------
FT_KEYS = ["train_data", "train_lang", "benchmark", "eval_lang"]
FT_KEYS_SQL = ", ".join(FT_KEYS)


@register("acc_mean_over_trials", f"""
WITH t AS (
  SELECT {FT_KEYS_SQL}, trial, SUM(correct) / COUNT(*) AS acc
  FROM v_responses WHERE was_ft AND quality IS NULL
  GROUP BY {FT_KEYS_SQL}, trial)
SELECT {FT_KEYS_SQL}, COUNT(*) AS n_trials, round(AVG(acc), 6) AS mean_acc
FROM t GROUP BY {FT_KEYS_SQL}
""")
def acc_mean_over_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.mean_over_trials(acc.full_data_runs(v_responses(spark, sf_dir)), FT_KEYS)


# AG3 ----------------------------------------------------------------------
ACC_MEAN_STD_SQL = f"""
WITH t AS (
  SELECT {FT_KEYS_SQL}, trial, {TENTHS_SQL} AS tenths
  FROM v_responses WHERE was_ft AND quality IS NULL
  GROUP BY {FT_KEYS_SQL}, trial)
SELECT {FT_KEYS_SQL}, COUNT(*) AS n_trials,
  round({MEAN_TENTHS_SQL.format(t='tenths')} / 10.0, 6) AS mean_pct,
  round(stddev_samp(tenths / 10.0), 6) AS std_pct
FROM t GROUP BY {FT_KEYS_SQL}
"""


@register("acc_mean_std_trials", ACC_MEAN_STD_SQL)
def acc_mean_std_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acc.mean_std_over_trials(acc.full_data_runs(v_responses(spark, sf_dir)), FT_KEYS)


# AG4 ----------------------------------------------------------------------
@register("acc_macro_avg", f"""
WITH per AS (
  SELECT model, benchmark, eval_lang, {TENTHS_SQL} AS tenths
  FROM v_responses WHERE {OOB_SQL} AND eval_lang <> 'en'
  GROUP BY model, benchmark, eval_lang)
SELECT model, benchmark, COUNT(*) AS n_langs,
  round({MEAN_TENTHS_SQL.format(t='tenths')} / 10.0, 6) AS avg_pct
FROM per GROUP BY model, benchmark
""")
def acc_macro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = acc.out_of_box(v_responses(spark, sf_dir)).filter(F.col("eval_lang") != "en")
    return acc.macro_average(r, ["model", "benchmark"])


# AG15 ---------------------------------------------------------------------
def _lang_case_sql(value: str, lang_col: str = "eval_lang") -> str:
    return ", ".join(f"max(CASE WHEN {lang_col} = '{lang}' THEN {value} END) AS {lang}" for lang in LANGS)


@register("pivot_lang_matrix", f"""
WITH per AS (
  SELECT model, benchmark, eval_lang, {TENTHS_SQL} / 10.0 AS pct
  FROM v_responses WHERE {OOB_SQL}
  GROUP BY model, benchmark, eval_lang)
SELECT model, benchmark, {_lang_case_sql('round(pct, 6)')}
FROM per GROUP BY model, benchmark
""")
def pivot_lang_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = acc.accuracy(acc.out_of_box(v_responses(spark, sf_dir)), ["model", "benchmark", "eval_lang"])
    a = a.withColumn("pct", F.col("acc_tenths") / 10.0)
    return acc.pivot_languages(a, ["model", "benchmark"], "pct", LANGS)


# A-T2: accuracy matrix with dense grid (PF14) ---------------------------------
@register("acc_matrix", f"""
WITH per AS (
  SELECT model, benchmark, eval_lang, {TENTHS_SQL} / 10.0 AS pct
  FROM v_responses WHERE {OOB_SQL}
  GROUP BY model, benchmark, eval_lang),
m AS (SELECT DISTINCT model FROM v_responses WHERE {OOB_SQL}),
b AS (SELECT * FROM (VALUES {", ".join(f"('{b}', {i})" for i, b in enumerate(dims.TABLE2_BENCHMARK_ORDER))}) AS b(benchmark, bench_order)),
l AS (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in LANGS)}) AS l(eval_lang)),
grid AS (SELECT m.model, b.benchmark, b.bench_order, l.eval_lang FROM m, b, l),
cells AS (SELECT g.*, p.pct FROM grid g LEFT JOIN per p
  ON g.model = p.model AND g.benchmark = p.benchmark AND g.eval_lang = p.eval_lang)
SELECT c.model, c.benchmark, CAST(c.bench_order AS BIGINT) AS bench_order,
  concat(coalesce(lbl.model_label, c.model), ' (', c.benchmark, ')') AS row_label,
  {_lang_case_sql('round(c.pct, 6)', 'c.eval_lang')}
FROM cells c LEFT JOIN {LABELS_SQL} ON c.model = lbl.model
GROUP BY c.model, c.benchmark, c.bench_order, lbl.model_label
""")
def acc_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table-2 style matrix: (model, benchmark) rows × language columns; empty cells null."""
    r = acc.out_of_box(v_responses(spark, sf_dir))
    grid = acc.dense_cells(r, ["model"], dims.TABLE2_BENCHMARK_ORDER, LANGS) \
        .withColumn("pct", F.col("acc_tenths") / 10.0)
    wide = acc.pivot_languages(grid, ["model", "benchmark"], "pct", LANGS)
    bench = dims.benchmark_dim(spark, dims.TABLE2_BENCHMARK_ORDER).select("benchmark", "bench_order")
    labels = dims.model_label_dim(spark).select("model", "model_label")
    return (wide.join(F.broadcast(bench), "benchmark").join(F.broadcast(labels), "model", "left")
            .select("model", "benchmark", "bench_order",
                    F.concat(F.coalesce("model_label", "model"), F.lit(" ("), "benchmark", F.lit(")")).alias("row_label"),
                    *LANGS))


# A-T1: headline table -------------------------------------------------------
HEADLINE_BENCH = ["belebele", "winogrande", "mmlu-college_medicine", "mmlu-clinical_knowledge", "mmlu-virology"]


HEADLINE_SQL = f"""
WITH per AS (
  SELECT model, benchmark, eval_lang, {TENTHS_SQL} AS tenths
  FROM v_responses WHERE {OOB_SQL}
  GROUP BY model, benchmark, eval_lang),
afr AS (
  SELECT model, benchmark, {MEAN_TENTHS_SQL.format(t='tenths')} AS tenths
  FROM per WHERE eval_lang <> 'en' GROUP BY model, benchmark),
eng AS (SELECT benchmark, tenths FROM per WHERE model = '{dims.FIXTURE_FLAGSHIP_MODEL}' AND eval_lang = 'en'),
long AS (
  SELECT '{dims.FIXTURE_MODEL_LABELS[dims.FIXTURE_FLAGSHIP_MODEL]} (eng)' AS row_label, 0 AS row_order, benchmark, tenths FROM eng
  UNION ALL
  SELECT concat(coalesce(lbl.model_label, a.model), ' (afr; avg)'), 1 + coalesce(lbl.model_order, 50), a.benchmark, a.tenths
  FROM afr a LEFT JOIN {LABELS_SQL} ON a.model = lbl.model
  UNION ALL
  SELECT 'Random (afr; avg)', 90, benchmark, CASE WHEN benchmark = 'winogrande' THEN 500 ELSE 250 END
  FROM (VALUES {", ".join(f"('{b}')" for b in HEADLINE_BENCH)}) AS bb(benchmark)
  UNION ALL
  SELECT '{dims.FIXTURE_MODEL_LABELS[dims.FIXTURE_FLAGSHIP_MODEL]} (eng - (afr; avg))', 91, e.benchmark, e.tenths - a.tenths
  FROM eng e JOIN afr a ON a.model = '{dims.FIXTURE_FLAGSHIP_MODEL}' AND a.benchmark = e.benchmark)
SELECT row_label, CAST(row_order AS BIGINT) AS row_order,
  {", ".join(f"round(max(CASE WHEN benchmark = '{b}' THEN tenths END) / 10.0, 6) AS {_bench_col(b)}" for b in HEADLINE_BENCH)}
FROM long GROUP BY row_label, row_order
"""


@register("report_headline", HEADLINE_SQL)
def report_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English flagship vs African average per model, random baseline, gap (A-T1)."""
    r = acc.out_of_box(cells(spark, sf_dir))
    per = acc.accuracy(r, ["model", "benchmark", "eval_lang"]).select(
        "model", "benchmark", "eval_lang", F.col("acc_tenths").alias("tenths"))
    afr = per.filter(F.col("eval_lang") != "en").groupBy("model", "benchmark").agg(
        mean_tenths(F.sum("tenths"), F.count("tenths")).alias("tenths"))
    flagship = dims.FIXTURE_FLAGSHIP_MODEL
    flag_label = dims.FIXTURE_MODEL_LABELS[flagship]
    eng = per.filter((F.col("model") == flagship) & (F.col("eval_lang") == "en")).select("benchmark", "tenths")
    labels = F.broadcast(dims.model_label_dim(spark))
    models = afr.join(labels, "model", "left").select(
        F.concat(F.coalesce("model_label", "model"), F.lit(" (afr; avg)")).alias("row_label"),
        (F.lit(1) + F.coalesce("model_order", F.lit(50))).alias("row_order"), "benchmark", "tenths")
    bench = dims.benchmark_dim(spark, HEADLINE_BENCH)
    rnd = bench.select(F.lit("Random (afr; avg)").alias("row_label"), F.lit(90).alias("row_order"), "benchmark",
                       (F.col("random_pct") * 10).cast("bigint").alias("tenths"))
    gap = eng.join(afr.filter(F.col("model") == flagship).select("benchmark", F.col("tenths").alias("afr")), "benchmark") \
        .select(F.lit(f"{flag_label} (eng - (afr; avg))").alias("row_label"), F.lit(91).alias("row_order"),
                "benchmark", (F.col("tenths") - F.col("afr")).alias("tenths"))
    eng_row = eng.select(F.lit(f"{flag_label} (eng)").alias("row_label"), F.lit(0).alias("row_order"),
                         "benchmark", "tenths")
    long = eng_row.unionByName(models).unionByName(rnd).unionByName(gap)
    wide = long.groupBy("row_label", "row_order").pivot("benchmark", HEADLINE_BENCH).agg(F.first(F.col("tenths") / 10.0))
    return wide.select("row_label", "row_order", *[F.col(f"`{b}`").alias(_bench_col(b)) for b in HEADLINE_BENCH])
