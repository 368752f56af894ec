"""SRC3 / S33: scan of answer files (JSON lines) in which some lines are broken and some calls failed.

The reference reads a whole file and stops at the first broken line; its own
runs skip failed calls, so accuracy is over the answered requests. Here one
permissive scan classifies every line: ``answered``; ``failed`` (a request id
without an answer: no response, no choice, no content); ``broken`` (not parsable
as the declared schema, or without a request id). Answers go on to the scorers,
broken lines to a quarantine table with file name and text, and counts by file
stand beside the request coverage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWERED, FAILED, BROKEN = "answered", "failed", "broken"
_RAW = "_corrupt_record"
LINE_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([T.StructField("body", T.StructType([
        T.StructField("choices", T.ArrayType(T.StructType([
            T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))])))]))])),
    T.StructField(_RAW, T.StringType())])


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, file, status, seq, custom_id, content, line)`` of every line below ``path``; ``line`` is the text of broken ones.

    Blank lines are no lines, as in the reference's reader. Order fields: files of one run may
    carry ``seq``; without it the last answer of a request is that of the greatest (file, position).
    """
    raw = (spark.read.schema(LINE_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RAW).option("recursiveFileLookup", True)
           .json(path).select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at")))
    content = F.get("response.body.choices", F.lit(0))["message"]["content"]
    broken = F.col(_RAW).isNotNull() | F.col("custom_id").isNull()
    status = F.when(broken, BROKEN).when(content.isNull(), FAILED).otherwise(ANSWERED)
    # a line that parses but names no request is written out again as it was understood
    line = F.when(broken, F.coalesce(F.col(_RAW), F.to_json(F.struct("seq", "custom_id", "response"))))
    # by counting from the end: a pattern bound to the end of a path is tried at each of its characters, for each line
    name = lambda k: F.substring_index(F.substring_index("path", "/", -k), "/", 1)
    return raw.select(name(2).alias("folder"), name(1).alias("file"), status.alias("status"), F.coalesce("seq", "at").alias("seq"), F.when(~broken, F.col("custom_id")).alias("custom_id"),
                      F.when(~broken, content).alias("content"), line.alias("line"))


def answers(outcomes: DataFrame) -> DataFrame:
    """The answered lines, ``(seq, file, custom_id, content)``, for the scorers."""
    return outcomes.filter(F.col("status") == ANSWERED).select("seq", "file", "custom_id", "content")


def last_answers(outcomes: DataFrame) -> DataFrame:
    """``(custom_id, content)``: the answer latest in load order of each request."""
    return answers(outcomes).groupBy("custom_id").agg(F.max_by("content", F.struct("seq", "file")).alias("content"))


def quarantine(outcomes: DataFrame, path: str) -> None:
    """Broken lines with their file, as a table (files whose lines are all right write nothing)."""
    outcomes.filter(F.col("status") == BROKEN).select("folder", "file", "line").write.mode("overwrite").parquet(path)


def file_counts(outcomes: DataFrame, *by: str) -> DataFrame:
    """Lines by outcome per file (or ``by``)."""
    return outcomes.groupBy(*(by or ("folder", "file"))).agg(
        F.count(F.lit(1)).alias("n_lines"), *[F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in (ANSWERED, FAILED, BROKEN)])


def coverage(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """J9 beside S33: per request ``(custom_id, outcome)``: answered, failed, or pending (no line names it)."""
    known = outcomes.filter(F.col("custom_id").isNotNull()).groupBy("custom_id").agg(
        F.max(F.when(F.col("status") == ANSWERED, 1).otherwise(0)).alias("ok"))
    j = requests.select("custom_id").distinct().join(known, "custom_id", "left")
    return j.select("custom_id", F.when(F.col("ok") == 1, ANSWERED).when(F.col("ok") == 0, FAILED).otherwise("pending").alias("outcome"))
