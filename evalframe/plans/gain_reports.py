"""Cross-lingual, quality×quantity and gain reports (A-XL, A-QQ, A-GAIN, A-DIST, A-QD, A-MT, A-INS, A-SPR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe import dims
from evalframe.operators import accuracy as acc
from evalframe.operators import gains as g
from evalframe.plans.accuracy_reports import (LABELS_SQL, LANGS, MEAN_TENTHS_SQL, OOB_SQL, TENTHS_SQL,
                                              _lang_case_sql, cells)
from evalframe.plans.catalog import register
from evalframe.sources.tables import v_responses

BASE = dims.FIXTURE_BASELINE_MODEL
FT_KEYS_SQL = "train_data, train_lang, benchmark, eval_lang"
AFR = [x for x in LANGS if x != "en"]
AFR_SQL = "(" + ", ".join(f"'{x}'" for x in AFR) + ")"
FT_EVAL_SQL = "(" + ", ".join(f"'{b}'" for b in dims.FT_EVAL_BENCHMARKS) + ")"
FT_TRAIN_SQL = "(" + ", ".join(f"'{b}'" for b in dims.FT_TRAIN_BENCHMARKS) + ")"

BASE_SQL = f"""base AS (
  SELECT benchmark, eval_lang, SUM(correct) / COUNT(*) AS base_acc, {TENTHS_SQL} AS base_tenths
  FROM v_responses
  WHERE NOT was_ft AND model = '{BASE}' AND contains(approach, 'Human') AND benchmark <> 'mmlu-college_medicine'
  GROUP BY benchmark, eval_lang)"""

CELLS_SQL = f"""t AS (
  SELECT {FT_KEYS_SQL}, trial, {TENTHS_SQL} AS tenths
  FROM v_responses WHERE was_ft AND quality IS NULL
  GROUP BY {FT_KEYS_SQL}, trial),
cells AS (
  SELECT {FT_KEYS_SQL}, {MEAN_TENTHS_SQL.format(t='tenths')} AS mean_tenths, stddev_samp(tenths / 10.0) AS std_pct
  FROM t GROUP BY {FT_KEYS_SQL})"""

MEAN_ACC_SQL = f"""tr AS (
  SELECT {FT_KEYS_SQL}, trial, SUM(correct) / COUNT(*) AS acc
  FROM v_responses WHERE was_ft AND quality IS NULL
  GROUP BY {FT_KEYS_SQL}, trial),
m AS (SELECT {FT_KEYS_SQL}, AVG(acc) AS mean_acc FROM tr GROUP BY {FT_KEYS_SQL}),
gains AS (SELECT m.*, m.mean_acc - b.base_acc AS gain FROM m JOIN base b USING (benchmark, eval_lang))"""


def _cross_lingual(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    r = cells(spark, sf_dir)
    keys = ["train_data", "train_lang", "benchmark", "eval_lang"]
    means = acc.mean_std_over_trials(acc.full_data_runs(r), keys).filter(
        F.col("benchmark").isin(dims.FT_EVAL_BENCHMARKS) & F.col("train_data").isin(dims.FT_TRAIN_BENCHMARKS))
    base = acc.baselines(r, BASE).select(
        F.lit("base").alias("train_data"), F.lit(None).cast("string").alias("train_lang"),
        "benchmark", "eval_lang", (F.col("base_tenths") / 10.0).alias(value))
    long = means.select("train_data", "train_lang", "benchmark", "eval_lang", value).unionByName(base)
    return acc.pivot_languages(long, ["train_data", "train_lang", "benchmark"], value, LANGS)


def _cross_lingual_sql(value_sql: str) -> str:
    return f"""
WITH {BASE_SQL},
{CELLS_SQL},
long AS (
  SELECT train_data, train_lang, benchmark, eval_lang, {value_sql} AS v FROM cells
  WHERE benchmark IN {FT_EVAL_SQL} AND train_data IN {FT_TRAIN_SQL}
  UNION ALL
  SELECT 'base', CAST(NULL AS VARCHAR), benchmark, eval_lang, base_tenths / 10.0 FROM base)
SELECT train_data, train_lang, benchmark, {_lang_case_sql('round(v, 6)')}
FROM long GROUP BY train_data, train_lang, benchmark
"""


@register("cross_lingual_mean", _cross_lingual_sql("mean_tenths / 10.0"))
def cross_lingual_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-XL means: (train data, train lang, eval data) × eval-language matrix with a baseline row."""
    return _cross_lingual(spark, sf_dir, "mean_pct")


@register("cross_lingual_std", _cross_lingual_sql("std_pct"))
def cross_lingual_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-XL stds. The baseline row carries the baseline accuracy, as the published std table does."""
    return _cross_lingual(spark, sf_dir, "std_pct")


ELIGIBLE_SQL = f"""{BASE_SQL},
{CELLS_SQL},
elig AS (
  SELECT c.train_data, c.benchmark, c.eval_lang AS lang, (c.mean_tenths - b.base_tenths) / 10.0 AS lift_pct
  FROM cells c JOIN base b USING (benchmark, eval_lang)
  WHERE c.train_lang = c.eval_lang AND c.mean_tenths - b.base_tenths >= {dims.LIFT_THRESHOLD_PCT * 10})"""


@register("eligible_lift_combos", f"""
WITH {ELIGIBLE_SQL}
SELECT train_data, benchmark, COUNT(*) AS n_langs, string_agg(lang, ',' ORDER BY lang) AS langs,
  round(max(lift_pct), 6) AS max_lift_pct
FROM elig GROUP BY train_data, benchmark
""")
def eligible_lift_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 + U3: combos with a mono-lingual lift ≥ 5 points, languages gathered per combo."""
    e = g.eligible_combos(cells(spark, sf_dir), BASE)
    return e.groupBy("train_data", "benchmark").agg(
        F.count(F.lit(1)).alias("n_langs"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"),
        F.max("lift_pct").alias("max_lift_pct"))


@register("quality_quantity", f"""
WITH {ELIGIBLE_SQL},
qt AS (
  SELECT train_data, benchmark, train_lang, quality, pct_used, trial, {TENTHS_SQL} AS tenths
  FROM v_responses WHERE quality IS NOT NULL
  GROUP BY train_data, benchmark, train_lang, quality, pct_used, trial),
qc AS (
  SELECT train_data, benchmark, train_lang AS lang, quality, pct_used, COUNT(*) AS n_trials,
    {MEAN_TENTHS_SQL.format(t='tenths')} / 10.0 AS mean_pct, stddev_samp(tenths / 10.0) AS std_pct
  FROM qt GROUP BY train_data, benchmark, train_lang, quality, pct_used)
SELECT q.train_data, q.benchmark, q.lang, q.quality, q.pct_used, q.n_trials, round(q.mean_pct, 6) AS mean_pct,
  round(q.std_pct, 6) AS std_pct
FROM qc q JOIN elig e ON q.train_data = e.train_data AND q.benchmark = e.benchmark AND q.lang = e.lang
UNION ALL
SELECT e.train_data, e.benchmark, e.lang, qq.quality, '0%', CAST(0 AS BIGINT), round(b.base_tenths / 10.0, 6), 0.0
FROM elig e JOIN base b ON b.benchmark = e.benchmark AND b.eval_lang = e.lang
  CROSS JOIN (VALUES ('low'), ('high')) AS qq(quality)
""")
def quality_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-QQ: per eligible combo, mean/std over trials by (quality, quantity) plus the 0 % baseline column.

    Like the published tables, quality runs are matched on the fine-tuning
    language only (the evaluation language is not filtered).
    """
    r = cells(spark, sf_dir)
    elig = g.eligible_combos(r, BASE)
    q = r.filter(F.col("quality").isNotNull())
    means = acc.mean_std_over_trials(q, ["train_data", "benchmark", "train_lang", "quality", "pct_used"]) \
        .withColumnRenamed("train_lang", "lang")
    runs = means.join(elig.select("train_data", "benchmark", "lang"), ["train_data", "benchmark", "lang"])
    base = acc.baselines(r, BASE).select("benchmark", F.col("eval_lang").alias("lang"), "base_tenths")
    zero = (elig.join(base, ["benchmark", "lang"])
            .withColumn("quality", F.explode(dims.literal_array(dims.QUALITIES)))
            .select("train_data", "benchmark", "lang", "quality", F.lit("0%").alias("pct_used"),
                    F.lit(0).cast("bigint").alias("n_trials"), (F.col("base_tenths") / 10.0).alias("mean_pct"),
                    F.lit(0.0).alias("std_pct")))
    return runs.select(*zero.columns).unionByName(zero)


@register("gain_over_baseline", f"""
WITH {BASE_SQL},
{MEAN_ACC_SQL}
SELECT {FT_KEYS_SQL}, round(mean_acc, 6) AS mean_acc, round(gain, 6) + 0.0 AS gain FROM gains
""")
def gain_over_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean accuracy over trials minus the un-tuned baseline of (eval data, eval lang)."""
    return g.gains(cells(spark, sf_dir), BASE).select(*g.FT_KEYS, "mean_acc", "gain")


@register("filter_mono_cross", f"""
SELECT CASE WHEN train_lang = eval_lang THEN 'mono-lingual' ELSE 'cross-lingual' END AS linguality,
  train_data, benchmark, COUNT(*) AS n_rows, CAST(SUM(correct) AS BIGINT) AS n_correct
FROM v_responses
WHERE was_ft AND quality IS NULL AND eval_lang <> 'en'
GROUP BY ALL
""")
def filter_mono_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF4: column-to-column comparison splits fine-tuned rows into mono/cross-lingual."""
    r = acc.full_data_runs(v_responses(spark, sf_dir)).filter(F.col("eval_lang") != "en")
    return r.groupBy(g.linguality(F.col("train_lang"), F.col("eval_lang")).alias("linguality"),
                     "train_data", "benchmark").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("correct").alias("n_correct"))


def _gain_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = cells(spark, sf_dir)
    return r, g.gains(r, BASE)


@register("gain_report", f"""
WITH {BASE_SQL},
{MEAN_ACC_SQL},
mono AS (SELECT * FROM gains WHERE train_lang = eval_lang AND eval_lang IN {AFR_SQL} AND benchmark IN {FT_EVAL_SQL}),
cross_ AS (SELECT * FROM gains WHERE train_lang <> eval_lang AND eval_lang IN {AFR_SQL} AND train_lang IN {AFR_SQL}
  AND benchmark IN {FT_EVAL_SQL}),
qtr AS (
  SELECT eval_lang, quality, pct_used, trial, SUM(correct) / COUNT(*) AS acc
  FROM v_responses
  WHERE quality IS NOT NULL AND train_lang = eval_lang AND eval_lang IN {AFR_SQL}
    AND benchmark = 'mmlu-clinical_knowledge' AND train_data = 'mmlu-college_medicine'
  GROUP BY ALL),
qm AS (SELECT eval_lang, quality, pct_used, AVG(acc) AS m FROM qtr GROUP BY ALL),
quantity AS (SELECT a.m - b.m AS gain FROM qm a JOIN qm b
  ON a.eval_lang = b.eval_lang AND a.quality = b.quality AND a.pct_used = '100%' AND b.pct_used = '50%'),
quality AS (SELECT a.m - b.m AS gain FROM qm a JOIN qm b
  ON a.eval_lang = b.eval_lang AND a.pct_used = b.pct_used AND a.quality = 'high' AND b.quality = 'low'),
rep AS (
  SELECT 'mono_lingual_avg' AS metric, 100 * AVG(gain) AS value_pct, COUNT(*) AS n FROM mono
  UNION ALL SELECT 'mono_lingual_avg_' || train_data || '_on_' || benchmark, 100 * AVG(gain), COUNT(*) FROM mono GROUP BY train_data, benchmark
  UNION ALL SELECT 'cross_lingual_avg', 100 * AVG(gain), COUNT(*) FROM cross_
  UNION ALL SELECT 'cross_lingual_max', 100 * MAX(gain), COUNT(*) FROM cross_
  UNION ALL SELECT 'quantity_50_to_100_avg', 100 * AVG(gain), COUNT(*) FROM quantity
  UNION ALL SELECT 'quality_low_to_high_avg', 100 * AVG(gain), COUNT(*) FROM quality
  UNION ALL SELECT 'quality_low_to_high_max', 100 * MAX(gain), COUNT(*) FROM quality)
SELECT metric, round(value_pct, 6) + 0.0 AS value_pct, n FROM rep
""")
def gain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-GAIN / AG10 / SNK7: gain statistics as a (metric, value, n) frame; text rendering is presentation."""
    r, gains = _gain_cells(spark, sf_dir)
    afr = F.col("eval_lang").isin(AFR) & F.col("benchmark").isin(dims.FT_EVAL_BENCHMARKS)
    mono = gains.filter(afr & (F.col("train_lang") == F.col("eval_lang")))
    cross = gains.filter(afr & (F.col("train_lang") != F.col("eval_lang")) & F.col("train_lang").isin(AFR))
    q = r.filter(F.col("quality").isNotNull() & (F.col("train_lang") == F.col("eval_lang"))
                 & F.col("eval_lang").isin(AFR) & (F.col("benchmark") == "mmlu-clinical_knowledge")
                 & (F.col("train_data") == "mmlu-college_medicine"))
    qm = acc.mean_over_trials(q, ["eval_lang", "quality", "pct_used"]).select(
        "eval_lang", "quality", "pct_used", F.col("mean_acc").alias("m"))
    quantity = g.step_gains(qm, ["eval_lang", "quality"], "pct_used", "100%", "50%")
    quality = g.step_gains(qm, ["eval_lang", "pct_used"], "quality", "high", "low")

    def stat(df: DataFrame, metric, fn) -> DataFrame:
        return df.agg(fn(F.col("gain") * 100).alias("value_pct"), F.count(F.lit(1)).alias("n")) \
            .select(F.lit(metric).alias("metric"), "value_pct", "n")

    per_bench = mono.groupBy("train_data", "benchmark").agg(
        (F.avg("gain") * 100).alias("value_pct"), F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("mono_lingual_avg_"), "train_data", F.lit("_on_"), "benchmark").alias("metric"), "value_pct", "n")
    parts = [stat(mono, "mono_lingual_avg", F.avg), per_bench, stat(cross, "cross_lingual_avg", F.avg),
             stat(cross, "cross_lingual_max", F.max), stat(quantity, "quantity_50_to_100_avg", F.avg),
             stat(quality, "quality_low_to_high_avg", F.avg), stat(quality, "quality_low_to_high_max", F.max)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("gain_distribution", f"""
WITH {BASE_SQL},
{MEAN_ACC_SQL},
d AS (SELECT train_data, benchmark,
        CASE WHEN train_lang = eval_lang THEN 'mono-lingual' ELSE 'cross-lingual' END AS linguality, gain * 100 AS g
      FROM gains WHERE train_lang IN {AFR_SQL} AND eval_lang IN {AFR_SQL} AND benchmark IN {FT_EVAL_SQL})
SELECT train_data, benchmark, linguality, COUNT(*) AS n,
  round(quantile_cont(g, 0.0), 6) + 0.0 AS p_min, round(quantile_cont(g, 0.25), 6) + 0.0 AS p_q1,
  round(quantile_cont(g, 0.5), 6) + 0.0 AS p_median, round(quantile_cont(g, 0.75), 6) + 0.0 AS p_q3,
  round(quantile_cont(g, 1.0), 6) + 0.0 AS p_max
FROM d GROUP BY ALL
""")
def gain_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-DIST: box-plot numbers of gains by (train data, eval data, linguality), African languages."""
    _, gains = _gain_cells(spark, sf_dir)
    d = gains.filter(F.col("train_lang").isin(AFR) & F.col("eval_lang").isin(AFR)
                     & F.col("benchmark").isin(dims.FT_EVAL_BENCHMARKS))
    return d.groupBy("train_data", "benchmark", g.linguality(F.col("train_lang"), F.col("eval_lang")).alias("linguality")) \
        .agg(F.count(F.lit(1)).alias("n"), *g.five_numbers(F.col("gain") * 100))


@register("gain_median_en", f"""
WITH {BASE_SQL},
{MEAN_ACC_SQL}
SELECT train_data, benchmark,
  round(max(CASE WHEN train_lang = 'en' THEN gain END) * 100, 6) + 0.0 AS mono_gain_pct,
  round(median(CASE WHEN train_lang <> 'en' THEN gain * 100 END), 6) + 0.0 AS cross_median_pct,
  COUNT(CASE WHEN train_lang <> 'en' THEN 1 END) AS n_cross
FROM gains WHERE eval_lang = 'en' AND benchmark IN {FT_EVAL_SQL}
GROUP BY train_data, benchmark
""")
def gain_median_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG9: English evaluation — mono-lingual gain and median of cross-lingual gains."""
    _, gains = _gain_cells(spark, sf_dir)
    en = gains.filter((F.col("eval_lang") == "en") & F.col("benchmark").isin(dims.FT_EVAL_BENCHMARKS))
    return en.groupBy("train_data", "benchmark").agg(
        (F.max(F.when(F.col("train_lang") == "en", F.col("gain"))) * 100).alias("mono_gain_pct"),
        F.median(F.when(F.col("train_lang") != "en", F.col("gain") * 100)).alias("cross_median_pct"),
        F.count(F.when(F.col("train_lang") != "en", 1)).alias("n_cross"))


@register("gain_range", f"""
WITH {BASE_SQL},
{MEAN_ACC_SQL}
SELECT round(min(gain * 100), 6) + 0.0 AS y_min, round(max(gain * 100), 6) + 0.0 AS y_max, COUNT(*) AS n
FROM gains WHERE train_lang IN {AFR_SQL} AND eval_lang IN {AFR_SQL} AND benchmark IN {FT_EVAL_SQL}
""")
def gain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the flattened-distribution min/max (axis limits) as a global aggregate."""
    _, gains = _gain_cells(spark, sf_dir)
    d = gains.filter(F.col("train_lang").isin(AFR) & F.col("eval_lang").isin(AFR)
                     & F.col("benchmark").isin(dims.FT_EVAL_BENCHMARKS))
    return d.agg(F.min(F.col("gain") * 100).alias("y_min"), F.max(F.col("gain") * 100).alias("y_max"),
                  F.count(F.lit(1)).alias("n"))


@register("quality_distribution", f"""
WITH {BASE_SQL},
qtr AS (
  SELECT eval_lang, quality, pct_used, trial, SUM(correct) / COUNT(*) AS acc
  FROM v_responses
  WHERE quality IS NOT NULL AND train_data = 'mmlu-college_medicine' AND benchmark = 'mmlu-clinical_knowledge'
  GROUP BY ALL),
qm AS (SELECT eval_lang, quality, pct_used, AVG(acc) * 100 AS m FROM qtr GROUP BY ALL),
d AS (
  SELECT quality, pct_used, m FROM qm WHERE eval_lang IN {AFR_SQL}
  UNION ALL
  SELECT q.quality, '0%', b.base_acc * 100 FROM base b CROSS JOIN (VALUES ('low'), ('high')) AS q(quality)
  WHERE b.benchmark = 'mmlu-clinical_knowledge' AND b.eval_lang IN {AFR_SQL}),
en AS (SELECT quality, pct_used, m AS en_pct FROM qm WHERE eval_lang = 'en'
  UNION ALL SELECT q.quality, '0%', b.base_acc * 100 FROM base b CROSS JOIN (VALUES ('low'), ('high')) AS q(quality)
  WHERE b.benchmark = 'mmlu-clinical_knowledge' AND b.eval_lang = 'en'),
box AS (SELECT quality, pct_used, COUNT(*) AS n,
  quantile_cont(m, 0.0) AS p_min, quantile_cont(m, 0.25) AS p_q1, quantile_cont(m, 0.5) AS p_median,
  quantile_cont(m, 0.75) AS p_q3, quantile_cont(m, 1.0) AS p_max FROM d GROUP BY ALL)
SELECT box.quality, box.pct_used, box.n, round(p_min, 6) AS p_min, round(p_q1, 6) AS p_q1,
  round(p_median, 6) AS p_median, round(p_q3, 6) AS p_q3, round(p_max, 6) AS p_max, round(en.en_pct, 6) AS en_pct
FROM box LEFT JOIN en ON box.quality = en.quality AND box.pct_used = en.pct_used
""")
def quality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-QD: accuracy distributions (African languages) by quantity × quality, 0 % = baseline, English marker."""
    r = cells(spark, sf_dir)
    q = r.filter(F.col("quality").isNotNull() & (F.col("train_data") == "mmlu-college_medicine")
                 & (F.col("benchmark") == "mmlu-clinical_knowledge"))
    qm = acc.mean_over_trials(q, ["eval_lang", "quality", "pct_used"]).select(
        "eval_lang", "quality", "pct_used", (F.col("mean_acc") * 100).alias("m"))
    base = acc.baselines(r, BASE).filter(F.col("benchmark") == "mmlu-clinical_knowledge") \
        .withColumn("quality", F.explode(dims.literal_array(dims.QUALITIES))) \
        .select("eval_lang", "quality", F.lit("0%").alias("pct_used"), (F.col("base_acc") * 100).alias("m"))
    allm = qm.unionByName(base)
    box = allm.filter(F.col("eval_lang").isin(AFR)).groupBy("quality", "pct_used").agg(
        F.count(F.lit(1)).alias("n"), *g.five_numbers(F.col("m")))
    en = allm.filter(F.col("eval_lang") == "en").select("quality", "pct_used", F.col("m").alias("en_pct"))
    return box.join(en, ["quality", "pct_used"], "left")


@register("mt_bt_difference", f"""
WITH per AS (
  SELECT model, benchmark, CASE WHEN contains(approach, '(bt)') THEN source_lang ELSE target_lang END AS eval_lang,
    {TENTHS_SQL.replace('SUM(correct)', "SUM(CASE WHEN contains(approach, 'Human') THEN correct END)").replace('COUNT(*)', "COUNT(CASE WHEN contains(approach, 'Human') THEN 1 END)")} AS human_t,
    {TENTHS_SQL.replace('SUM(correct)', "SUM(CASE WHEN contains(approach, '(gt)') THEN correct END)").replace('COUNT(*)', "COUNT(CASE WHEN contains(approach, '(gt)') THEN 1 END)")} AS gt_t,
    {TENTHS_SQL.replace('SUM(correct)', "SUM(CASE WHEN contains(approach, '(bt)') THEN correct END)").replace('COUNT(*)', "COUNT(CASE WHEN contains(approach, '(bt)') THEN 1 END)")} AS bt_t
  FROM v_responses WHERE NOT was_ft GROUP BY ALL)
SELECT model, benchmark, eval_lang AS lang, d.direction,
  round(CASE WHEN eval_lang = 'en' THEN human_t ELSE CASE d.direction WHEN 'en -> x' THEN gt_t ELSE bt_t END END / 10.0, 6) AS mt_pct,
  round(CASE WHEN eval_lang = 'en' THEN 0 ELSE human_t - CASE d.direction WHEN 'en -> x' THEN gt_t ELSE bt_t END END / 10.0, 6) + 0.0 AS diff_pct
FROM per CROSS JOIN (VALUES ('en -> x'), ('x -> en')) AS d(direction)
""")
def mt_bt_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-MT: accuracy on machine (gt) and back-translated (bt) inputs and the gap to human translations.

    Translations are grouped by their target language, back-translations, whose
    target is English, by their source language (S31). English cells repeat the
    human value with a zero difference, as in the published tables.
    """
    r = v_responses(spark, sf_dir).filter(~F.col("was_ft"))
    lang = F.when(F.col("approach").contains("(bt)"), F.col("source_lang")).otherwise(F.col("target_lang"))
    r = r.withColumn("eval_lang", lang)

    def t(marker: str):
        m = F.col("approach").contains(marker)
        num, den = F.sum(F.when(m, F.col("correct"))), F.count(F.when(m, 1))
        return F.when(den > 0, F.floor((num * 2000 + den) / (den * 2.0)).cast("bigint"))

    per = r.groupBy("model", "benchmark", "eval_lang").agg(
        t("Human").alias("human_t"), t("(gt)").alias("gt_t"), t("(bt)").alias("bt_t"))
    per = per.withColumn("direction", F.explode(dims.literal_array(["en -> x", "x -> en"])))
    mt = F.when(F.col("direction") == "en -> x", F.col("gt_t")).otherwise(F.col("bt_t"))
    en = F.col("eval_lang") == "en"
    return per.select("model", "benchmark", F.col("eval_lang").alias("lang"), "direction",
                      (F.when(en, F.col("human_t")).otherwise(mt) / 10.0).alias("mt_pct"),
                      (F.when(en, F.lit(0)).otherwise(F.col("human_t") - mt) / 10.0).alias("diff_pct"))


@register("insert_ranked_rows", f"""
WITH per AS (
  SELECT model, benchmark, eval_lang, {TENTHS_SQL} / 10.0 AS pct
  FROM v_responses WHERE {OOB_SQL}
  GROUP BY model, benchmark, eval_lang),
b AS (SELECT * FROM (VALUES {", ".join(f"('{b}', {i})" for i, b in enumerate(dims.TABLE2_BENCHMARK_ORDER))}) AS b(benchmark, bench_order)),
rows_ AS (
  SELECT p.model, p.benchmark, b.bench_order, coalesce(lbl.model_label, p.model) AS model_label,
    coalesce(lbl.model_order, 99) AS model_order, {_lang_case_sql('p.pct', 'p.eval_lang')}
  FROM per p JOIN b USING (benchmark) LEFT JOIN {LABELS_SQL} ON p.model = lbl.model
  GROUP BY ALL),
keyed AS (
  SELECT *, CASE WHEN model = '{dims.FIXTURE_INSERTED_MODEL}'
              THEN {list(dims.FIXTURE_MODEL_LABELS).index(dims.FIXTURE_FLAGSHIP_MODEL)} ELSE model_order END AS anchor,
         CASE WHEN model = '{dims.FIXTURE_INSERTED_MODEL}' THEN 0 ELSE 1 END AS flag
  FROM rows_)
SELECT row_number() OVER (ORDER BY bench_order, anchor, flag, model) AS position,
  concat(model_label, ' (', benchmark, ')') AS row_label, {", ".join(f"round({x}, 6) AS {x}" for x in LANGS)}
FROM keyed
""")
def insert_ranked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 / A-INS: place the inserted model's row directly above the flagship's row in each benchmark block.

    The frame is report-sized (models × benchmarks), so one ordered window
    over it is cheap; the heavy part is the aggregate that feeds it.
    """
    r = acc.out_of_box(v_responses(spark, sf_dir))  # one branch: the filter runs in the scan
    a = acc.accuracy(r, ["model", "benchmark", "eval_lang"]).withColumn("pct", F.col("acc_tenths") / 10.0)
    wide = acc.pivot_languages(a, ["model", "benchmark"], "pct", LANGS)
    labels = dims.model_label_dim(spark)
    bench = dims.benchmark_dim(spark, dims.TABLE2_BENCHMARK_ORDER).select("benchmark", "bench_order")
    rows = wide.join(F.broadcast(bench), "benchmark").join(F.broadcast(labels), "model", "left")
    anchor_order = list(dims.FIXTURE_MODEL_LABELS).index(dims.FIXTURE_FLAGSHIP_MODEL)
    ins = F.col("model") == dims.FIXTURE_INSERTED_MODEL
    keyed = rows.select(
        "*", F.when(ins, F.lit(anchor_order)).otherwise(F.coalesce("model_order", F.lit(99))).alias("anchor"),
        F.when(ins, 0).otherwise(1).alias("flag"))
    w = Window.orderBy("bench_order", "anchor", "flag", "model")
    return keyed.select(
        F.row_number().over(w).alias("position"),
        F.concat(F.coalesce("model_label", "model"), F.lit(" ("), "benchmark", F.lit(")")).alias("row_label"),
        *LANGS)


@register("spearman_matrix", f"""
WITH per AS (
  SELECT model, benchmark, eval_lang, {TENTHS_SQL} / 10.0 AS pct
  FROM v_responses WHERE {OOB_SQL}
  GROUP BY model, benchmark, eval_lang),
rk AS (
  SELECT model, benchmark, eval_lang,
    rank() OVER (PARTITION BY eval_lang ORDER BY pct) + (COUNT(*) OVER (PARTITION BY eval_lang, pct) - 1) / 2.0 AS r
  FROM per),
wide AS (SELECT model, benchmark, {_lang_case_sql('r')} FROM rk GROUP BY model, benchmark),
pairs AS (
  {" UNION ALL ".join(f"SELECT '{a}' AS lang_a, '{b}' AS lang_b, corr({a}, {b}) AS rho FROM wide"
                      for i, a in enumerate(LANGS) for b in LANGS[i + 1:])})
SELECT lang_a, lang_b, round(rho, 6) AS rho FROM pairs
""")
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4 / A-SPR / W7: Spearman correlation between language columns of the accuracy matrix.

    Average ranks per language (ties share the mean rank), then Pearson
    correlation of rank columns — all pairs in ONE global aggregate over the
    wide rank table instead of a self-join per pair. Lower triangle only.
    """
    r = acc.out_of_box(v_responses(spark, sf_dir))  # one branch: the filter runs in the scan
    a = acc.accuracy(r, ["model", "benchmark", "eval_lang"]).withColumn("pct", F.col("acc_tenths") / 10.0)
    w = Window.partitionBy("eval_lang").orderBy("pct")
    ties = Window.partitionBy("eval_lang", "pct")
    ranked = a.withColumn("r", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)
    wide = acc.pivot_languages(ranked, ["model", "benchmark"], "r", LANGS)
    pairs = [(x, y) for i, x in enumerate(LANGS) for y in LANGS[i + 1:]]
    agg = wide.agg(*[F.corr(x, y).alias(f"{x}__{y}") for x, y in pairs])
    stack = "stack({n}, {items}) as (lang_a, lang_b, rho)".format(
        n=len(pairs), items=", ".join(f"'{x}', '{y}', `{x}__{y}`" for x, y in pairs))
    return agg.selectExpr(stack)


@register("five_number_summary", f"""
WITH per AS (
  SELECT model, benchmark, eval_lang, SUM(correct) * 100.0 / COUNT(*) AS pct
  FROM v_responses WHERE {OOB_SQL}
  GROUP BY model, benchmark, eval_lang)
SELECT benchmark, COUNT(*) AS n,
  round(quantile_cont(pct, 0.0), 6) AS p_min, round(quantile_cont(pct, 0.25), 6) AS p_q1,
  round(quantile_cont(pct, 0.5), 6) AS p_median, round(quantile_cont(pct, 0.75), 6) AS p_q3,
  round(quantile_cont(pct, 1.0), 6) AS p_max
FROM per GROUP BY benchmark
""")
def five_number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: box-plot numbers of per-(model, language) accuracy by benchmark."""
    r = acc.out_of_box(v_responses(spark, sf_dir))  # one branch: the filter runs in the scan
    a = acc.accuracy(r, ["model", "benchmark", "eval_lang"])
    return a.groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"),
                                      *g.five_numbers(F.col("n_correct") * 100.0 / F.col("n_total")))
