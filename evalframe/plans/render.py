"""Presentation of report-sized results (SNK7): the free-text statistics file.

Only bounded reports (a handful of rows keyed by metric names) are brought to
the driver here; every number is computed by the Spark query beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalframe.plans.gain_reports import gain_report

# Wording of the published gain-statistics lines.
GAIN_LINES = {
    "mono_lingual_avg": "Average Mono-Lingual Gain (total number of gains considered): {v}% ({n})",
    "cross_lingual_avg": "Average Cross-Lingual Gain (total number of gains considered): {v}% ({n})",
    "cross_lingual_max": "Maximum Cross-Lingual Gain (total number of gains considered): {v}% ({n})",
    "quantity_50_to_100_avg": "Average 33 to 66 Quantity MMLU Gain (total number of gains considered): {v}% ({n})",
    "quality_low_to_high_avg": "Average low to high quality MMLU Gain (total number of gains considered): {v}% ({n})",
    "quality_low_to_high_max": "Maximum low to high quality MMLU Gain (total number of gains considered): {v}% ({n})",
}


def gain_report_text(report: DataFrame) -> str:
    """Render the (metric, value_pct, n) frame as text lines, rounded to 0.1 for display; a metric without gains has no line."""
    rows = {r["metric"]: r for r in report.filter("value_pct IS NOT NULL").collect()}  # bounded: one row per metric name
    lines = []
    for key, template in GAIN_LINES.items():
        if key in rows:
            lines.append(template.format(v=round(rows[key]["value_pct"], 1), n=rows[key]["n"]))
    for key in sorted(k for k in rows if k.startswith("mono_lingual_avg_")):
        lines.append(f"Average gains for {key[len('mono_lingual_avg_'):]}: {round(rows[key]['value_pct'], 1)}%")
    return "\n".join(lines) + "\n"


def write_gain_report(spark: SparkSession, sf_dir: str) -> str:
    return gain_report_text(gain_report(spark, sf_dir))
