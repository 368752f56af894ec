"""Evaluation cost projection (ST9, ST10).

Per-trial average token usage (failed calls excluded, AG14) is priced under
each price sheet and multiplied by the number of requests; the trials give a
mean, a sample std and a mean ± 2σ interval. Inputs are tiny (one row per
trial), the usage averages come from a Spark aggregate over the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# USD per million tokens (input, output) for the two price sheets.
PRICES = {"o1": (15.0, 60.0), "o1_mini": (3.0, 12.0)}


def project_costs(usage: DataFrame, n_requests: Column) -> DataFrame:
    """``usage`` has (trial, in_tok, out_tok); returns (metric, n_trials, mean, std, ci_lower, ci_upper)."""
    u = usage.withColumn("n", n_requests)
    metrics = F.array(
        F.struct(F.lit("input_token_usages").alias("metric"), F.col("in_tok").alias("v")),
        F.struct(F.lit("output_token_usages").alias("metric"), F.col("out_tok").alias("v")),
        *[F.struct(F.lit(f"{name}_costs").alias("metric"),
                   ((F.col("in_tok") * pin / 1e6 + F.col("out_tok") * pout / 1e6) * F.col("n")).alias("v"))
          for name, (pin, pout) in PRICES.items()])
    long = u.select(F.explode(metrics).alias("m")).select("m.metric", "m.v")
    return long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_trials"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")) \
        .select("metric", "n_trials", "mean", "std", (F.col("mean") - 2 * F.col("std")).alias("ci_lower"),
                (F.col("mean") + 2 * F.col("std")).alias("ci_upper"))
