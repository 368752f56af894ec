"""Sampling-based statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions import predicates as P
from evalframe.operators import ml
from evalframe.operators import sampling as smp
from evalframe.operators.gains import five_numbers
from evalframe.plans.catalog import register
from evalframe.plans.filters_joins import J1_SQL, _j1
from evalframe.session import materialize
from evalframe.sources.tables import read_table, v_surveys

SEED = 42
N_REPS = 100

LABELED_SQL = "lab AS (SELECT l.doc_id, l.quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
BALANCED_SQL = f"""{LABELED_SQL},
rk AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('{SEED}-' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos,
         COUNT(*) OVER (PARTITION BY quality) AS n FROM lab),
bal AS (SELECT doc_id, quality FROM rk WHERE pos < (SELECT min(n) FROM rk))"""


def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return lab.join(docs, "doc_id")


@register("balance_classes", f"WITH {BALANCED_SQL} SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM bal")
def balance_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP4: down-sample every class to the minority count (md5 order, seed 42)."""
    return smp.balance_classes(_labeled(spark, sf_dir), "quality", "doc_id", SEED)


@register("stratified_split", f"""
WITH {BALANCED_SQL},
rk2 AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('{SEED}-' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos,
          COUNT(*) OVER (PARTITION BY quality) AS n FROM bal)
SELECT doc_id, CAST(quality AS BIGINT) AS quality, CASE WHEN pos < ceil(n * 0.25) THEN 'test' ELSE 'train' END AS split FROM rk2
""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP6: stratified 75/25 train/test split of the balanced set (per-class md5 order)."""
    bal = smp.balance_classes(_labeled(spark, sf_dir), "quality", "doc_id", SEED)
    return smp.stratified_split(bal, "quality", "doc_id", 0.25, SEED)


@register("classification_report", """
WITH x AS (
  SELECT CASE WHEN coalesce(approp_1 = 'No, the sentence is typical', false) THEN 1 ELSE 0 END AS y,
         CASE WHEN coalesce(approp_2 = 'No, the sentence is typical', false) THEN 1 ELSE 0 END AS p FROM v_surveys),
s AS (SELECT COUNT(*) AS n, COUNT(CASE WHEN y = p THEN 1 END) AS n_correct,
  COUNT(CASE WHEN y = 0 AND p = 0 THEN 1 END) AS tp_0, COUNT(CASE WHEN y <> 0 AND p = 0 THEN 1 END) AS fp_0,
  COUNT(CASE WHEN y = 0 AND p <> 0 THEN 1 END) AS fn_0,
  COUNT(CASE WHEN y = 1 AND p = 1 THEN 1 END) AS tp_1, COUNT(CASE WHEN y <> 1 AND p = 1 THEN 1 END) AS fp_1,
  COUNT(CASE WHEN y = 1 AND p <> 1 THEN 1 END) AS fn_1 FROM x),
l AS (SELECT n, n_correct, 0 AS class, tp_0 AS tp, fp_0 AS fp, fn_0 AS fn FROM s
      UNION ALL SELECT n, n_correct, 1, tp_1, fp_1, fn_1 FROM s),
m AS (SELECT *, CASE WHEN tp + fp = 0 THEN NULL ELSE tp * 1.0 / (tp + fp) END AS pr,
        CASE WHEN tp + fn = 0 THEN NULL ELSE tp * 1.0 / (tp + fn) END AS rc FROM l)
SELECT CAST(class AS BIGINT) AS class, tp, fp, fn, tp + fn AS support, round(coalesce(pr, 0.0), 6) AS precision,
  round(coalesce(rc, 0.0), 6) AS recall,
  round(coalesce(CASE WHEN pr + rc = 0 THEN NULL ELSE 2 * pr * rc / (pr + rc) END, 0.0), 6) AS f1,
  round(n_correct * 1.0 / n, 6) AS accuracy
FROM m
""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML2: confusion counts and precision / recall / F1 per class — here rater 2 'predicting' rater 1."""
    s = v_surveys(spark, sf_dir).select(
        P.eq_pandas("approp_1", "No, the sentence is typical").cast("int").alias("y"),
        P.eq_pandas("approp_2", "No, the sentence is typical").cast("int").alias("p"))
    return ml.classification_report(s, "y", "p")


@register("resample_null_distribution", f"""
WITH {J1_SQL},
d AS (
  SELECT lang, survey_key, response_id, correct,
    CASE WHEN coalesce(approp_1 = 'No, the sentence is typical', false) AND coalesce(approp_2 = 'No, the sentence is typical', false) THEN 1 ELSE 0 END AS app
  FROM j1 WHERE quality_1 IS DISTINCT FROM 'Completely wrong' AND quality_2 IS DISTINCT FROM 'Completely wrong'),
sizes AS (
  SELECT lang, 'appropriate' AS draw, SUM(app) AS n, SUM(app * correct) AS c FROM d GROUP BY lang
  UNION ALL SELECT lang, 'inappropriate', SUM(1 - app), SUM((1 - app) * correct) FROM d GROUP BY lang),
reps AS (
  SELECT d.*, s.draw, r.rep, s.n,
    row_number() OVER (PARTITION BY d.lang, s.draw, r.rep
      ORDER BY md5('x-' || s.draw || '-' || CAST(r.rep AS VARCHAR) || '-' || CAST(d.survey_key AS VARCHAR) || '-' || CAST(d.response_id AS VARCHAR)),
        d.survey_key, d.response_id) - 1 AS pos
  FROM d JOIN sizes s ON s.lang = d.lang CROSS JOIN range(1, {N_REPS + 1}) AS r(rep)),
rates AS (SELECT lang, draw, rep, SUM(correct) * 1.0 / max(n) AS rate FROM reps WHERE pos < n GROUP BY ALL)
SELECT r.lang, r.draw, CAST(s.n AS BIGINT) AS n_stratum, round(s.c * 1.0 / s.n, 6) AS observed_rate, COUNT(*) AS n_reps,
  round(quantile_cont(rate, 0.0), 6) AS p_min, round(quantile_cont(rate, 0.25), 6) AS p_q1,
  round(quantile_cont(rate, 0.5), 6) AS p_median, round(quantile_cont(rate, 0.75), 6) AS p_q3,
  round(quantile_cont(rate, 1.0), 6) AS p_max
FROM rates r JOIN sizes s ON s.lang = r.lang AND s.draw = r.draw GROUP BY r.lang, r.draw, s.n, s.c
""")
def resample_null_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-NULL / SP5: accuracy on appropriate vs inappropriate items against 100 random subsamples of the
    same sizes drawn from all (good-translation) rows of the language."""
    j = _j1(spark, sf_dir).filter(P.neither_wrong())
    d = j.select("lang", "survey_key", "response_id", "correct", P.both_typical().cast("int").alias("app"))
    d = materialize(d, "null-rows")  # read three times
    sizes = d.groupBy("lang").agg(F.sum("app").alias("n_app"), F.sum(F.col("app") * F.col("correct")).alias("c_app"),
                                  F.sum(1 - F.col("app")).alias("n_in"),
                                  F.sum((1 - F.col("app")) * F.col("correct")).alias("c_in"))
    sizes = sizes.selectExpr("lang", "stack(2, 'appropriate', n_app, c_app, 'inappropriate', n_in, c_in) as (draw, n, c)")
    rates = smp.resample_rates(d, ["lang"], ["survey_key", "response_id"], "correct",
                               sizes.select("lang", "draw", "n"), ["appropriate", "inappropriate"], N_REPS, own_hash=True)
    box = rates.groupBy("lang", "draw").agg(F.count(F.lit(1)).alias("n_reps"), *five_numbers(F.col("rate")))
    return box.join(sizes, ["lang", "draw"]).select(
        "lang", "draw", F.col("n").alias("n_stratum"), (F.col("c") / F.col("n")).alias("observed_rate"),
        "n_reps", "p_min", "p_q1", "p_median", "p_q3", "p_max")
