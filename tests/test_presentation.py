"""SNK7 text report; SQL users' views."""

from evalframe.plans import catalog, render
from evalframe.plans.gain_reports import gain_report
from evalframe.sources.tables import VIEWS, register_views

from conftest import SF_SMALL


def test_gain_report_as_text(spark):
    rows = spark.createDataFrame([("mono_lingual_avg", 5.64, 88), ("quality_low_to_high_max", 14.5, 44), ("mono_lingual_avg_af", 3.21, 8)], "metric string, value_pct double, n long")
    assert render.gain_report_text(rows) == (
        "Average Mono-Lingual Gain (total number of gains considered): 5.6% (88)\n"
        "Maximum low to high quality MMLU Gain (total number of gains considered): 14.5% (44)\nAverage gains for af: 3.2%\n")
    text = render.write_gain_report(spark, SF_SMALL)
    metrics = {r.metric for r in gain_report(spark, SF_SMALL).filter("value_pct IS NOT NULL").collect()}
    assert len(text.splitlines()) == len(metrics & set(render.GAIN_LINES)) + sum(m.startswith("mono_lingual_avg_") for m in metrics)


def test_views_for_sql(spark):
    register_views(spark, SF_SMALL)
    assert all(spark.table(v).limit(1).count() == 1 for v in VIEWS)
    n = spark.sql("SELECT model, benchmark, eval_lang, count(*) AS n FROM v_responses WHERE NOT was_ft GROUP BY ALL")
    assert n.count() > 0 and "acc_by_model_bench_lang" in catalog.queries()
