"""Rater agreement reports and appropriateness lift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe import dims
from evalframe.functions import predicates as P
from evalframe.operators import agreement as ag
from evalframe.operators import checks, lift
from evalframe.plans.catalog import register
from evalframe.sources.tables import read_table, v_responses, v_surveys

LANGS = dims.FIXTURE_LANGUAGES
AFR = [x for x in LANGS if x != "en"]
APP_CATS = dims.APPROPRIATENESS_CATEGORIES
Q_CATS = [(c, {"Completely wrong": "Wrong", "Good translation": "Good", "Understandable": "Understandable"}[c])
          for c in dims.QUALITY_CATEGORIES]
TYP = dims.TYPICAL


def _values_sql(cats, alias):
    return "(VALUES " + ", ".join(f"('{v}', '{lab}', {i})" for i, (v, lab) in enumerate(cats)) + f") AS {alias}(v, lab, i)"


def _contingency_sql(r1: str, r2: str, cats) -> str:
    return f"""
WITH l AS (SELECT DISTINCT lang FROM v_surveys),
grid AS (SELECT l.lang, a.lab AS rater_1, b.lab AS rater_2, a.i AS i_1, b.i AS i_2, a.v AS v1, b.v AS v2
         FROM l, {_values_sql(cats, 'a')}, {_values_sql(cats, 'b')}),
cnt AS (SELECT lang, {r1} AS v1, {r2} AS v2, COUNT(*) AS n FROM v_surveys GROUP BY ALL)
SELECT g.lang, g.rater_1, g.rater_2, CAST(g.i_1 AS BIGINT) AS i_1, CAST(g.i_2 AS BIGINT) AS i_2, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN cnt c ON g.lang = c.lang AND g.v1 = c.v1 AND g.v2 = c.v2
"""


@register("rater_contingency", _contingency_sql("approp_1", "approp_2", APP_CATS))
def rater_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: appropriateness rater-1 × rater-2 counts per language, all 16 cells (zero-filled)."""
    return ag.contingency(v_surveys(spark, sf_dir), ["lang"], "approp_1", "approp_2", APP_CATS)


@register("quality_contingency", _contingency_sql("quality_1", "quality_2", Q_CATS))
def quality_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: translation-quality rater-1 × rater-2 counts per language, all 9 cells."""
    return ag.contingency(v_surveys(spark, sf_dir), ["lang"], "quality_1", "quality_2", Q_CATS)


POLICY_SQL = f"""
SELECT lang, COUNT(*) AS n_items,
  COUNT(CASE WHEN coalesce(approp_1 = '{TYP}', false) AND coalesce(approp_2 = '{TYP}', false)
              AND quality_1 IS DISTINCT FROM 'Completely wrong'
              AND quality_2 IS DISTINCT FROM 'Completely wrong' THEN 1 END) AS appropriate_good,
  COUNT(CASE WHEN (approp_1 IS DISTINCT FROM '{TYP}' OR approp_2 IS DISTINCT FROM '{TYP}')
              AND quality_1 IS DISTINCT FROM 'Completely wrong' AND quality_2 IS DISTINCT FROM 'Completely wrong' THEN 1 END) AS inappropriate_good,
  COUNT(CASE WHEN quality_1 IS DISTINCT FROM 'Completely wrong' AND quality_2 IS DISTINCT FROM 'Completely wrong' THEN 1 END) AS considered_good,
  COUNT(CASE WHEN coalesce(quality_1 = 'Completely wrong', false) OR coalesce(quality_2 = 'Completely wrong', false) THEN 1 END) AS considered_wrong
FROM v_surveys GROUP BY lang
"""


@register("rater_policy_counts", POLICY_SQL)
def rater_policy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5: conditional counts per language with pandas null semantics."""
    s = v_surveys(spark, sf_dir)
    good = P.neither_wrong()
    wrong = P.eq_pandas("quality_1", dims.COMPLETELY_WRONG) | P.eq_pandas("quality_2", dims.COMPLETELY_WRONG)
    return s.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count(F.when(P.both_typical() & good, 1)).alias("appropriate_good"),
        F.count(F.when(P.any_atypical() & good, 1)).alias("inappropriate_good"),
        F.count(F.when(good, 1)).alias("considered_good"),
        F.count(F.when(wrong, 1)).alias("considered_wrong"))


@register("contingency_share", f"""
WITH c AS ({_contingency_sql('approp_1', 'approp_2', APP_CATS)}),
tot AS (SELECT COUNT(*) AS total FROM v_surveys)
SELECT rater_1, rater_2, CAST(SUM(n) AS BIGINT) AS n_total, round(100.0 * SUM(n) / max(tot.total), 6) AS avg_pct
FROM c, tot GROUP BY rater_1, rater_2
""")
def contingency_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7 / S15: cell total over languages and its share of ALL survey rows ("Avg. (%)")."""
    s = v_surveys(spark, sf_dir)
    c = ag.contingency(s, ["lang"], "approp_1", "approp_2", APP_CATS)
    total = s.agg(F.count(F.lit(1))).scalar()
    return c.groupBy("rater_1", "rater_2").agg(F.sum("n").alias("n_total")).select(
        "rater_1", "rater_2", "n_total", (F.col("n_total") * 100.0 / total).alias("avg_pct"))


def _kappa_sql(r1: str, r2: str, cats, where: str = "TRUE") -> str:
    k = len(cats)
    marg = ", ".join(f"COUNT(CASE WHEN {r1} = '{v}' THEN 1 END) AS r_{i}, COUNT(CASE WHEN {r2} = '{v}' THEN 1 END) AS c_{i}"
                     for i, (v, _) in enumerate(cats))
    pe_c = " + ".join(f"r_{i} * c_{i}" for i in range(k))
    pe_f = " + ".join(f"(r_{i} + c_{i}) * (r_{i} + c_{i})" for i in range(k))
    return f"""s AS (
  SELECT lang, COUNT(*) AS n, COUNT(CASE WHEN {r1} = {r2} THEN 1 END) AS n_agree, {marg}
  FROM v_surveys WHERE {r1} IS NOT NULL AND {r2} IS NOT NULL AND {where} GROUP BY lang),
k AS (
  SELECT lang, n, n_agree * 1.0 / n AS po, ({pe_c}) * 1.0 / (n * n) AS pe_c, ({pe_f}) * 1.0 / (4.0 * n * n) AS pe_f FROM s)"""


def _kappa_select(prefix: str) -> str:
    return (f"round(CASE WHEN pe_c = 1 THEN NULL ELSE (po - pe_c) / (1 - pe_c) END, 6) + 0.0 AS {prefix}cohen_kappa, "
            f"round(CASE WHEN pe_f = 1 THEN NULL ELSE (po - pe_f) / (1 - pe_f) END, 6) + 0.0 AS {prefix}fleiss_kappa")


@register("cohen_kappa", f"""
WITH {_kappa_sql('quality_1', 'quality_2', Q_CATS)}
SELECT lang, n, round(po, 6) AS p_o, {_kappa_select('')} FROM k
""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 (with ST2 alongside): translation-quality agreement per language."""
    return ag.kappa_stats(v_surveys(spark, sf_dir), ["lang"], "quality_1", "quality_2", dims.QUALITY_CATEGORIES)


@register("fleiss_kappa", f"""
WITH {_kappa_sql('approp_1', 'approp_2', APP_CATS)}
SELECT lang, n, {_kappa_select('')} FROM k
""")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 (with ST1 alongside): appropriateness agreement per language; rows with a missing rating excluded."""
    k = ag.kappa_stats(v_surveys(spark, sf_dir), ["lang"], "approp_1", "approp_2", [v for v, _ in APP_CATS])
    return k.select("lang", "n", "cohen_kappa", "fleiss_kappa")


@register("kappa_report", f"""
WITH q1 AS (
  WITH {_kappa_sql('quality_1', 'quality_2', Q_CATS)}
  SELECT lang, {_kappa_select('q1_')} FROM k),
q2 AS (
  WITH {_kappa_sql('approp_1', 'approp_2', APP_CATS)}
  SELECT lang, {_kappa_select('q2_')} FROM k)
SELECT q1.lang, q1_cohen_kappa, q1_fleiss_kappa, q2_cohen_kappa, q2_fleiss_kappa
FROM q1 JOIN q2 USING (lang) WHERE q1.lang <> 'en'
""")
def kappa_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-KAP: two questions × two statistics per African language."""
    s = v_surveys(spark, sf_dir).filter(F.col("lang") != "en")
    k = ag.kappa_stats_many(s, ["lang"], [("q1_", "quality_1", "quality_2", dims.QUALITY_CATEGORIES),
                                          ("q2_", "approp_1", "approp_2", [v for v, _ in APP_CATS])])
    return k.select("lang", "q1_cohen_kappa", "q1_fleiss_kappa", "q2_cohen_kappa", "q2_fleiss_kappa")


@register("labels_kappa", """
WITH s AS (SELECT COUNT(*) AS n, COUNT(CASE WHEN quality = toxic THEN 1 END) AS a,
  COUNT(CASE WHEN quality = 1 THEN 1 END) AS q1, COUNT(CASE WHEN toxic = 1 THEN 1 END) AS t1
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
k AS (SELECT n, a * 1.0 / n AS po, (q1 * t1 + (n - q1) * (n - t1)) * 1.0 / (n * n) AS pe FROM s)
SELECT n, round(CASE WHEN pe = 1 THEN NULL ELSE (po - pe) / (1 - pe) END, 6) + 0.0 AS cohen_kappa FROM k
""")
def labels_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1 on the labels table: agreement of the two binary judgements per document."""
    lab = read_table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("a"),
                                                     F.col("toxic").cast("string").alias("b"))
    k = ag.kappa_stats(lab, [], "a", "b", ["0", "1"])
    return k.select("n", "cohen_kappa")


@register("derive_appropriate", f"""
SELECT survey_key, item_id, lang,
  coalesce(approp_1 = '{TYP}', false) AND coalesce(approp_2 = '{TYP}', false) AS appropriate,
  coalesce(quality_1 = 'Good translation', false) AND coalesce(quality_2 = 'Good translation', false) AS good_translation
FROM v_surveys
""")
def derive_appropriate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF8: per-row derived booleans as column expressions (no row-wise Python)."""
    s = v_surveys(spark, sf_dir)
    return s.select("survey_key", "item_id", "lang", P.both_typical().alias("appropriate"),
                    P.both_good().alias("good_translation"))


@register("filter_rater_policy", """
SELECT 'either' AS policy, survey_key, lang FROM v_surveys
WHERE quality_1 IS DISTINCT FROM 'Completely wrong' OR quality_2 IS DISTINCT FROM 'Completely wrong'
UNION ALL
SELECT 'both', survey_key, lang FROM v_surveys
WHERE quality_1 IS DISTINCT FROM 'Completely wrong' AND quality_2 IS DISTINCT FROM 'Completely wrong'
""")
def filter_rater_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF7: survey rows kept by the 'either rater ok' and 'both raters ok' quality policies."""
    s = v_surveys(spark, sf_dir)
    tags = F.array(F.when(P.either_not_wrong(), F.lit("either")), F.when(P.neither_wrong(), F.lit("both")))
    return s.select(F.explode(F.array_compact(tags)).alias("policy"), "survey_key", "lang")


KLM_SQL = f"""
WITH gt AS (
  SELECT item_id, lang, CASE WHEN coalesce(approp_1 = '{TYP}', false) AND coalesce(approp_2 = '{TYP}', false) THEN 1 ELSE 0 END AS app
  FROM v_surveys WHERE coalesce(quality_1 = 'Good translation', false) AND coalesce(quality_2 = 'Good translation', false)),
p AS (
  SELECT a.lang AS lang_a, b.lang AS lang_b, COUNT(*) AS n, SUM(a.app * b.app) AS n11, SUM(a.app) AS nx, SUM(b.app) AS ny
  FROM gt a JOIN gt b ON a.item_id = b.item_id GROUP BY a.lang, b.lang),
k AS (SELECT *, n - nx - ny + n11 AS n00, (n11 + n - nx - ny + n11) * 1.0 / n AS po,
        (nx * ny + (n - nx) * (n - ny)) * 1.0 / (n * n) AS pe FROM p)
SELECT lang_a, lang_b, n, CAST(n11 + n00 AS BIGINT) AS n_agree,
  round(CASE WHEN pe = 1 THEN NULL ELSE (po - pe) / (1 - pe) END, 6) + 0.0 AS kappa
FROM k
"""


def _appropriate_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v_surveys(spark, sf_dir).filter(P.both_good())
    flags = s.select("item_id", "lang", P.both_typical().cast("int").alias("app"))
    return flags.groupBy("item_id").agg(*[F.max(F.when(F.col("lang") == x, F.col("app"))).alias(x) for x in LANGS])


@register("kappa_lang_matrix", KLM_SQL)
def kappa_lang_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3 / A-KLM: Cohen's kappa of 'appropriate' between every pair of languages on common items
    (good translations only). One pivot to a per-item row, then one global aggregate."""
    return ag.pairwise_binary(_appropriate_wide(spark, sf_dir), LANGS)


@register("self_join_lang_pairs", f"""
WITH t AS ({KLM_SQL})
SELECT lang_a, lang_b, n, n_agree FROM t WHERE lang_a <> lang_b
""")
def self_join_lang_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 re-aimed: per language pair, common items and agreements — without emitting item pairs."""
    return ag.pairwise_binary(_appropriate_wide(spark, sf_dir), LANGS, include_diagonal=False).select(
        "lang_a", "lang_b", "n", "n_agree")


# --- A-LIFT ---------------------------------------------------------------------
def _lift_sql(policy_where: str) -> str:
    return f"""
WITH items AS (SELECT DISTINCT item_id FROM v_responses
               WHERE NOT was_ft AND benchmark = 'winogrande' AND contains(approach, 'Human')),
flags AS (
  SELECT s.answer_item AS item_id, s.lang,
    CASE WHEN coalesce(approp_1 = '{TYP}', false) AND coalesce(approp_2 = '{TYP}', false) THEN 1 ELSE 0 END AS app
  FROM v_surveys s SEMI JOIN items i ON s.answer_item = i.item_id
  WHERE s.lang <> 'en' AND ({policy_where})),
runs AS (
  SELECT model, item_id, eval_lang AS lang, trial, arg_max(correct, response_id) AS c
  FROM v_responses WHERE NOT was_ft AND benchmark = 'winogrande' AND contains(approach, 'Human')
  GROUP BY ALL),
acc AS (SELECT model, item_id, lang, CASE WHEN COUNT(*) = 3 THEN SUM(c) / 3.0 END AS m FROM runs GROUP BY ALL),
tot AS (SELECT lang, SUM(app) AS n_app, COUNT(*) - SUM(app) AS n_inapp FROM flags GROUP BY lang),
sl AS (SELECT a.model, f.lang, SUM(CASE WHEN f.app = 1 THEN a.m END) AS s_app, SUM(CASE WHEN f.app = 0 THEN a.m END) AS s_inapp
       FROM flags f JOIN acc a ON a.item_id = f.item_id AND a.lang = f.lang GROUP BY ALL),
se AS (SELECT a.model, f.lang, SUM(CASE WHEN f.app = 1 THEN a.m END) AS e_app, SUM(CASE WHEN f.app = 0 THEN a.m END) AS e_inapp
       FROM flags f JOIN acc a ON a.item_id = f.item_id AND a.lang = 'en' GROUP BY ALL),
r AS (
  SELECT x.model, t.lang, t.n_app, t.n_inapp,
    100.0 * coalesce(x.s_app, 0) / t.n_app AS app_acc, 100.0 * coalesce(x.s_inapp, 0) / t.n_inapp AS inapp_acc,
    100.0 * coalesce(x.e_app, 0) / t.n_app AS en_app_acc, 100.0 * coalesce(x.e_inapp, 0) / t.n_inapp AS en_inapp_acc
  FROM (sl FULL JOIN se USING (model, lang)) x JOIN tot t ON x.lang = t.lang)
SELECT model, lang, CAST(n_app AS BIGINT) AS n_app, CAST(n_inapp AS BIGINT) AS n_inapp,
  round(app_acc, 6) AS app_acc, round(inapp_acc, 6) AS inapp_acc,
  round(en_app_acc, 6) AS en_app_acc, round(en_inapp_acc, 6) AS en_inapp_acc,
  round(app_acc - inapp_acc, 6) + 0.0 AS diff, round(en_app_acc - en_inapp_acc, 6) + 0.0 AS en_diff,
  round((app_acc - inapp_acc) - (en_app_acc - en_inapp_acc), 6) + 0.0 AS did
FROM r
"""


@register("lift_report_all", _lift_sql("TRUE"))
def lift_report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-LIFT (all survey rows): accuracy on appropriate vs inappropriate items, English twin, diff-in-diff."""
    return lift.lift_report(v_surveys(spark, sf_dir), v_responses(spark, sf_dir), "all")


@register("lift_report_either", _lift_sql(
    "quality_1 IS DISTINCT FROM 'Completely wrong' OR quality_2 IS DISTINCT FROM 'Completely wrong'"))
def lift_report_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-LIFT with the 'either rater ok' quality policy."""
    return lift.lift_report(v_surveys(spark, sf_dir), v_responses(spark, sf_dir), "either")


@register("lift_report_both", _lift_sql(
    "quality_1 IS DISTINCT FROM 'Completely wrong' AND quality_2 IS DISTINCT FROM 'Completely wrong'"))
def lift_report_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-LIFT with the 'both raters ok' quality policy."""
    return lift.lift_report(v_surveys(spark, sf_dir), v_responses(spark, sf_dir), "both")


@register("align_runs", """
WITH runs AS (
  SELECT model, item_id, eval_lang AS lang, trial, arg_max(correct, response_id) AS c
  FROM v_responses WHERE NOT was_ft AND benchmark = 'winogrande' AND contains(approach, 'Human')
  GROUP BY ALL)
SELECT model, item_id, lang, COUNT(*) AS n_runs, CAST(SUM(c) AS BIGINT) AS sum_correct,
  round(CASE WHEN COUNT(*) = 3 THEN SUM(c) / 3.0 END, 6) AS mean_correct
FROM runs GROUP BY ALL
""")
def align_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three run tables aligned on (item, language); missing in any run → null mean."""
    return lift.aligned_runs(lift.item_runs(v_responses(spark, sf_dir))).select(
        "model", "item_id", "lang", "n_runs", "sum_correct", "mean_correct")


@register("semi_assessed_items", """
WITH items AS (SELECT DISTINCT item_id FROM v_responses
               WHERE NOT was_ft AND benchmark = 'winogrande' AND contains(approach, 'Human'))
SELECT s.lang, COUNT(*) AS n_items,
  COUNT(CASE WHEN i.item_id IS NOT NULL THEN 1 END) AS n_matched,
  COUNT(CASE WHEN i.item_id IS NULL THEN 1 END) AS n_unmatched
FROM v_surveys s LEFT JOIN items i ON s.answer_item = i.item_id GROUP BY s.lang
""")
def semi_assessed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey items restricted to assessed items (semi join) with the anti-join completeness check."""
    s = v_surveys(spark, sf_dir).select(F.col("answer_item").alias("item_id"), "lang")
    items = lift.assessed_items(lift.item_runs(v_responses(spark, sf_dir))).withColumn("hit", F.lit(True))
    j = s.join(items, "item_id", "left")  # items is distinct: semi + anti in one pass
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n_items"), F.count("hit").alias("n_matched"),
                                 F.count(F.when(F.col("hit").isNull(), 1)).alias("n_unmatched"))


@register("lookup_assessed_items", """
WITH a AS (SELECT item_id, eval_lang AS lang, COUNT(*) AS n FROM v_responses
           WHERE NOT was_ft AND benchmark = 'winogrande' AND contains(approach, 'Human') AND model = 'click' AND trial = 1 GROUP BY ALL)
SELECT s.lang, CASE coalesce(a.n, 0) WHEN 1 THEN 'ok' WHEN 0 THEN 'missing' ELSE 'repeated' END AS status,
  COUNT(*) AS n_items, COUNT(DISTINCT s.answer_item) AS n_labels
FROM v_surveys s LEFT JOIN a ON s.answer_item = a.item_id AND s.lang = a.lang GROUP BY ALL
""")
def lookup_assessed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every survey looks up the one answer of one model in one run; how many find it, miss it, or find several."""
    s = v_surveys(spark, sf_dir).select(F.col("answer_item").alias("item_id"), "lang")
    r = v_responses(spark, sf_dir).filter(~F.col("was_ft") & (F.col("benchmark") == "winogrande") & P.is_human())
    r = r.filter((F.col("model") == "click") & (F.col("trial") == 1)).select("item_id", F.col("eval_lang").alias("lang"), "correct")
    found = checks.lookup(s, r, ["item_id", "lang"], on_broken="status")
    return found.groupBy("lang", "status").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("item_id").alias("n_labels"))


@register("lift_did", f"""
WITH t AS ({_lift_sql('TRUE')})
SELECT model, lang, did FROM t
""")
def lift_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11: stratified lift and difference-in-differences vs English (policy 'all')."""
    return lift.lift_report(v_surveys(spark, sf_dir), v_responses(spark, sf_dir), "all").select("model", "lang", "did")


@register("rank_by_lift", f"""
WITH t AS ({_lift_sql('TRUE')})
SELECT lang, diff, rank() OVER (ORDER BY diff DESC) AS rank FROM t WHERE model = '{dims.FIXTURE_FLAGSHIP_MODEL}'
""")
def rank_by_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages sorted by the flagship model's appropriate-minus-inappropriate gap (report-sized window)."""
    r = lift.lift_report(v_surveys(spark, sf_dir), v_responses(spark, sf_dir), "all") \
        .filter(F.col("model") == dims.FIXTURE_FLAGSHIP_MODEL)
    return r.select("lang", "diff", F.rank().over(Window.orderBy(F.col("diff").desc())).alias("rank"))


METRICS = ["n_app", "n_inapp", "app_acc", "inapp_acc", "en_app_acc", "en_inapp_acc", "diff", "en_diff", "did"]


@register("transpose_metrics", f"""
WITH t AS ({_lift_sql('TRUE')}),
u AS (
  {" UNION ALL ".join(f"SELECT '{m}' AS metric, {i} AS metric_order, lang, CAST({m} AS DOUBLE) AS v FROM t WHERE model = '{dims.FIXTURE_FLAGSHIP_MODEL}'" for i, m in enumerate(METRICS))})
SELECT metric, CAST(metric_order AS BIGINT) AS metric_order,
  {", ".join(f"round(max(CASE WHEN lang = '{x}' THEN v END), 6) + 0.0 AS {x}" for x in AFR)}
FROM u GROUP BY metric, metric_order
""")
def transpose_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16: language × metric result transposed to metric × language (unpivot, then pivot with order column)."""
    r = lift.lift_report(v_surveys(spark, sf_dir), v_responses(spark, sf_dir), "all") \
        .filter(F.col("model") == dims.FIXTURE_FLAGSHIP_MODEL)
    cast = r.select("lang", *[F.col(m).cast("double").alias(m) for m in METRICS])
    long = cast.unpivot(["lang"], METRICS, "metric", "v")
    order = spark.createDataFrame([(m, i) for i, m in enumerate(METRICS)], "metric string, metric_order int")
    return long.join(F.broadcast(order), "metric").groupBy("metric", "metric_order").pivot("lang", AFR).agg(F.first("v"))


@register("stratum_counts", f"""
SELECT lang, coalesce(approp_1 = '{TYP}', false) AND coalesce(approp_2 = '{TYP}', false) AS appropriate, COUNT(*) AS n
FROM v_surveys WHERE quality_1 IS DISTINCT FROM 'Completely wrong' AND quality_2 IS DISTINCT FROM 'Completely wrong'
GROUP BY ALL
""")
def stratum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17: group counts of the boolean stratum (good translations only)."""
    s = v_surveys(spark, sf_dir).filter(P.neither_wrong())
    return s.groupBy("lang", P.both_typical().alias("appropriate")).agg(F.count(F.lit(1)).alias("n"))


# --- A-AGR: contingency tables with policy rows, languages as columns ------------------
APP_REPORT_ORDER = ["Typical", "Not sure", "Strange", "D.U."]
Q_REPORT_ORDER = ["Good", "Understandable", "Wrong"]


def _report_rows_sql(question: str, r1: str, r2: str, cats, order, extra_sql: str) -> str:
    pos = "CASE lab " + " ".join(f"WHEN '{lab}' THEN {i}" for i, lab in enumerate(order)) + " END"
    k = len(order)
    return f"""SELECT '{question}' AS question, a.lab || ' / ' || b.lab AS row_label,
    ({pos.replace('lab', 'a.lab')}) * {k} + ({pos.replace('lab', 'b.lab')}) AS row_order, l.lang,
    (SELECT COUNT(*) FROM v_surveys s WHERE s.lang = l.lang AND s.{r1} = a.v AND s.{r2} = b.v) AS n
  FROM (SELECT DISTINCT lang FROM v_surveys) l, {_values_sql(cats, 'a')}, {_values_sql(cats, 'b')}
  UNION ALL {extra_sql}"""


RATER_REPORT_SQL = f"""
WITH rows_ AS (
  {_report_rows_sql('appropriateness', 'approp_1', 'approp_2', APP_CATS, APP_REPORT_ORDER, f"""
  SELECT 'appropriateness', 'Appropriate + Good', 16, lang, appropriate_good FROM ({POLICY_SQL})
  UNION ALL SELECT 'appropriateness', 'Inappropriate + Good', 17, lang, inappropriate_good FROM ({POLICY_SQL})""")}
  UNION ALL
  {_report_rows_sql('quality', 'quality_1', 'quality_2', Q_CATS, Q_REPORT_ORDER, f"""
  SELECT 'quality', 'Considered Good', 9, lang, considered_good FROM ({POLICY_SQL})
  UNION ALL SELECT 'quality', 'Considered Wrong', 10, lang, considered_wrong FROM ({POLICY_SQL})""")}),
tot AS (SELECT COUNT(*) AS total FROM v_surveys)
SELECT question, row_label, CAST(row_order AS BIGINT) AS row_order,
  {", ".join(f"CAST(SUM(CASE WHEN lang = '{x}' THEN n ELSE 0 END) AS BIGINT) AS {x}" for x in LANGS)},
  round(100.0 * SUM(n) / max(tot.total), 6) AS avg_pct
FROM rows_, tot GROUP BY question, row_label, row_order
"""


@register("rater_report", RATER_REPORT_SQL)
def rater_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-AGR: flattened rater-1 × rater-2 tables for both questions plus the policy rows
    (appropriate/inappropriate among good translations; considered good/wrong), one column per
    language and "Avg. (%)" = row total over all survey rows × 100 (S15). One pass over the surveys."""
    s = v_surveys(spark, sf_dir)
    good, wrong = P.neither_wrong(), \
        P.eq_pandas("quality_1", dims.COMPLETELY_WRONG) | P.eq_pandas("quality_2", dims.COMPLETELY_WRONG)
    rows = []  # (question, label, order, predicate)
    for question, r1, r2, cats, order in (("appropriateness", "approp_1", "approp_2", APP_CATS, APP_REPORT_ORDER),
                                           ("quality", "quality_1", "quality_2", Q_CATS, Q_REPORT_ORDER)):
        for v1, l1 in cats:
            for v2, l2 in cats:
                rows.append((question, f"{l1} / {l2}", order.index(l1) * len(order) + order.index(l2),
                             (F.col(r1) == v1) & (F.col(r2) == v2)))
    rows += [("appropriateness", "Appropriate + Good", 16, P.both_typical() & good),
             ("appropriateness", "Inappropriate + Good", 17, P.any_atypical() & good),
             ("quality", "Considered Good", 9, good), ("quality", "Considered Wrong", 10, wrong)]
    per_lang = s.groupBy("lang").agg(*[F.count(F.when(pred, 1)).alias(f"c{i}") for i, (_, _, _, pred) in enumerate(rows)])
    long = per_lang.select("lang", F.explode(F.array(*[
        F.struct(F.lit(q).alias("question"), F.lit(lab).alias("row_label"), F.lit(o).alias("row_order"),
                 F.col(f"c{i}").alias("n")) for i, (q, lab, o, _) in enumerate(rows)])).alias("x"))
    total = s.agg(F.count(F.lit(1))).scalar()
    wide = long.groupBy("x.question", "x.row_label", "x.row_order").agg(
        *[F.sum(F.when(F.col("lang") == x, F.col("x.n")).otherwise(0)).alias(x) for x in LANGS],
        (F.sum("x.n") * 100.0 / total).alias("avg_pct"))
    return wide
