"""Golden checks against published result tables.

The numbers below are fixed values copied from the published tables: rater
contingency counts and the kappas reported for them, per-language accuracies
and their macro average, and per-trial token usage with the projected cost.
"""

import pytest
from pyspark.sql import functions as F

from evalframe.functions.numeric import mean_tenths
from evalframe.operators import agreement as ag
from evalframe.operators import gains, lift
from evalframe.operators.costs import project_costs

# --- fixed values: translation-quality contingency (rater 1 / rater 2) per language -------------
QUALITY_COUNTS = {  # order: Good/Good, Good/Und, Good/Wrong, Und/Good, Und/Und, Und/Wrong, Wrong/Good, Wrong/Und, Wrong/Wrong
    "xh": [2406, 552, 24, 312, 185, 3, 88, 100, 4],
    "zu": [1349, 771, 39, 898, 452, 33, 68, 61, 3],
    "af": [2522, 353, 36, 455, 139, 20, 80, 56, 13],
}
# --- fixed values: appropriateness contingency, rows Typical, Not sure, Strange, D.U. (rater 1) x same (rater 2)
APPROP_COUNTS = {
    "xh": [2755, 26, 6, 1, 394, 7, 0, 1, 208, 3, 4, 0, 248, 10, 10, 1],
    "zu": [2832, 70, 267, 43, 51, 1, 0, 0, 356, 0, 26, 0, 28, 0, 0, 0],
    "af": [2229, 60, 335, 3, 246, 12, 41, 1, 593, 24, 85, 1, 34, 3, 7, 0],
}
# --- fixed values: published kappas (Q1 Cohen, Q1 Fleiss, Q2 Cohen, Q2 Fleiss) -------------------
KAPPAS = {"xh": (0.158, 0.15, 0.027, -0.042), "zu": (-0.023, -0.025, -0.037, -0.038), "af": (0.136, 0.134, 0.008, -0.009)}
Q_VALUES = ["Good translation", "Understandable", "Completely wrong"]
A_VALUES = ["No, the sentence is typical", "Maybe", "Yes", "Do not understand"]


def _rows(counts, values):
    k = len(values)
    for idx, n in enumerate(counts):
        yield values[idx // k], values[idx % k], n


def _rater_frame(spark, table, values):
    data = [(lang, a, b) for lang, counts in table.items() for a, b, n in _rows(counts, values) for _ in range(n)]
    return spark.createDataFrame(data, "lang string, r1 string, r2 string")


@pytest.mark.parametrize("question", ["q1", "q2"])
def test_g2_g3_kappas_from_published_contingency(spark, question):
    table, values, off = (QUALITY_COUNTS, Q_VALUES, 0) if question == "q1" else (APPROP_COUNTS, A_VALUES, 2)
    k = ag.kappa_stats(_rater_frame(spark, table, values), ["lang"], "r1", "r2", values)
    got = {r["lang"]: (round(r["cohen_kappa"], 3), round(r["fleiss_kappa"], 3)) for r in k.collect()}
    for lang, exp in KAPPAS.items():
        assert got[lang] == pytest.approx((exp[off], exp[off + 1]), abs=1e-9), lang


def test_contingency_is_dense_and_ordered(spark):
    df = _rater_frame(spark, {"af": APPROP_COUNTS["af"]}, A_VALUES)
    cats = list(zip(A_VALUES, ["Typical", "Not sure", "Strange", "D.U."]))
    c = ag.contingency(df, ["lang"], "r1", "r2", cats)
    got = [r["n"] for r in c.orderBy("i_1", "i_2").collect()]
    assert got == APPROP_COUNTS["af"] and len(got) == 16  # zero cells kept (S14)


# --- fixed values: per-language accuracies (en excluded) and their published macro average ---------
G1 = {
    ("GPT-4o", "winogrande"): ([79.7, 68.3, 65.9, 59.4, 50.2, 60.7, 64.1, 69.5, 67.4, 64.7, 62.6], 64.8),
    ("GPT-4", "winogrande"): ([77.0, 64.2, 62.3, 51.0, 50.7, 58.7, 58.8, 65.6, 63.8, 59.9, 57.7], 60.9),
}


def test_g1_macro_average_of_rounded_cells(spark):
    rows = [(f"{m}|{b}", int(round(v * 10))) for (m, b), (vals, _) in G1.items() for v in vals]
    df = spark.createDataFrame(rows, "k string, tenths long")
    got = {r["k"]: r["avg"] / 10.0 for r in df.groupBy("k").agg(
        mean_tenths(F.sum("tenths"), F.count("tenths")).alias("avg")).collect()}
    for (m, b), (_, exp) in G1.items():
        assert got[f"{m}|{b}"] == exp


# --- fixed values: per-trial average token usage and the published projection (39,252 requests) -----
TRIAL_USAGE = [(1, 529.38, 611.71), (2, 564.74, 479.49), (3, 529.73, 567.11)]
N_REQUESTS = 39252


def test_g7_cost_projection(spark):
    usage = spark.createDataFrame(TRIAL_USAGE, "trial int, in_tok double, out_tok double")
    out = {r["metric"]: r for r in project_costs(usage, F.lit(N_REQUESTS)).collect()}
    mini = out["o1_mini_costs"]
    assert mini["mean"] == pytest.approx(324.11, abs=0.01)
    assert mini["std"] == pytest.approx(29.43, abs=0.01)
    assert mini["ci_lower"] == pytest.approx(265.25, abs=0.02) and mini["ci_upper"] == pytest.approx(382.97, abs=0.02)
    assert out["o1_costs"]["mean"] == pytest.approx(1620.54, abs=0.02)


# --- fixed values: mean accuracies at 25, 50, 75 and 100 % of the low- and the high-quality training rows, by language, and the published statistics
G5 = {
    "af": ([64.4, 63.8, 67.3, 71.1], [72.5, 75.4, 76.3, 75.6]),
    "am": ([44.8, 42.9, 45.9, 48.4], [48.2, 48.2, 51.3, 51.7]),
    "bm": ([32.8, 34.9, 32.7, 33.9], [32.1, 33.6, 38.7, 36.1]),
    "ig": ([41.9, 43.4, 40.9, 47.5], [48.7, 47.9, 50.8, 50.3]),
    "nso": ([39.5, 46.3, 41.9, 46.4], [46.9, 47.4, 54.0, 53.6]),
    "sn": ([43.7, 46.7, 43.8, 44.5], [46.8, 48.9, 50.1, 52.4]),
    "st": ([48.8, 44.4, 39.5, 44.0], [47.9, 50.7, 53.3, 54.7]),
    "tn": ([44.0, 44.3, 46.7, 35.9], [46.9, 46.9, 45.7, 45.3]),
    "ts": ([36.4, 36.8, 34.3, 40.5], [37.9, 43.6, 43.3, 47.4]),
    "xh": ([42.2, 34.3, 40.7, 42.3], [39.9, 48.8, 47.6, 48.9]),
    "zu": ([44.6, 39.5, 42.5, 41.5], [40.5, 44.0, 49.8, 50.2]),
}
G5_QUALITY_AVG, G5_QUALITY_MAX, G5_QUALITY_N, G5_QUANTITY_AVG, G5_QUANTITY_N = 5.4, 14.5, 44, 2.3, 22


def test_g5_gains_by_quality_and_quantity(spark):
    rows = [(lang, q, f"{p}%", v) for lang, both in G5.items() for q, values in zip(("low", "high"), both) for p, v in zip((25, 50, 75, 100), values)]
    cells = spark.createDataFrame(rows, "eval_lang string, quality string, pct_used string, m double")
    quality = gains.step_gains(cells, ["eval_lang", "pct_used"], "quality", "high", "low")
    q = quality.agg(F.avg("gain").alias("a"), F.max("gain").alias("m"), F.count("gain").alias("n")).first()
    assert (round(q.a, 1), round(q.m, 1), q.n) == (G5_QUALITY_AVG, G5_QUALITY_MAX, G5_QUALITY_N)
    quantity = gains.step_gains(cells, ["eval_lang", "quality"], "pct_used", "100%", "50%")
    d = quantity.agg(F.avg("gain").alias("a"), F.count("gain").alias("n")).first()
    assert d.n == G5_QUANTITY_N and abs(d.a - G5_QUANTITY_AVG) <= 0.05 + 1e-9  # from rounded cells: 2.25
    with pytest.raises(Exception, match="2 rows for one cell"):
        gains.step_gains(cells.unionByName(cells.filter("eval_lang = 'af' and pct_used = '25%'")), ["eval_lang", "pct_used"], "quality", "high", "low").collect()


# --- fixed values: accuracy on appropriate and inappropriate items, the same in English, published gaps and difference of gaps (all rounded)
G9 = [  # model, language, app, inapp, en app, en inapp, gap, en gap, difference
    ("GPT-4o", "xh", 65.5, 65.7, 83.9, 84.2, -0.2, -0.3, 0.1), ("GPT-4o", "zu", 69.1, 64.3, 85.1, 80.0, 4.8, 5.1, -0.4),
    ("GPT-4o", "af", 81.7, 74.9, 85.3, 81.8, 6.8, 3.5, 3.3), ("GPT-4o", "ig", 60.7, 61.7, 84.9, 83.2, -1.0, 1.7, -2.7),
    ("GPT-4", "xh", 61.4, 60.7, 83.1, 82.9, 0.8, 0.2, 0.6), ("GPT-4", "zu", 65.3, 59.2, 83.1, 82.8, 6.1, 0.3, 5.9),
    ("GPT-4", "af", 80.0, 72.3, 84.8, 80.2, 7.8, 4.7, 3.1), ("GPT-4", "ig", 60.7, 57.5, 83.0, 83.1, 3.2, 0.0, 3.2),
    ("GPT-3.5", "xh", 51.6, 53.5, 58.7, 59.0, -1.9, -0.3, -1.6), ("GPT-3.5", "zu", 49.7, 50.6, 58.5, 59.7, -1.0, -1.2, 0.3),
    ("GPT-3.5", "af", 56.7, 51.9, 59.9, 57.0, 4.7, 2.9, 1.9), ("GPT-3.5", "ig", 51.9, 50.0, 61.0, 56.9, 1.8, 4.1, -2.3),
]


def test_g9_stratified_lift(spark):
    df = spark.createDataFrame([r[:6] for r in G9], "model string, lang string, app_acc double, inapp_acc double, en_app_acc double, en_inapp_acc double")
    got = {(r.model, r.lang): (r.diff, r.en_diff, r.did) for r in lift.with_differences(df).collect()}
    for model, lang, *_, gap, en_gap, did in G9:  # from rounded inputs: one, one and two roundings of 0.05 on either side
        a, b, c = got[model, lang]
        assert abs(a - gap) <= 0.15 + 1e-9 and abs(b - en_gap) <= 0.15 + 1e-9 and abs(c - did) <= 0.25 + 1e-9
