"""File sources and sinks (SRC1–SRC5, SNK1–SNK6).

Readers always take a declared schema (no inference pass over 100 TB) and
fail fast on malformed records. Writers never funnel data through one task
except for report-sized results (``write_report_csv``).
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.session import scratch_folder

MC_ITEM_SCHEMA = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(6)])
MC_ITEM_NAMES = ["question", "opt_a", "opt_b", "opt_c", "opt_d", "answer"]
CHAT_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint dir (never a machine-local temp dir)."""
    return scratch_folder(spark, name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, multi_line: bool = False) -> DataFrame:
    """SRC1/SRC2: CSV with doubled quotes, declared schema, FAILFAST.

    ``multi_line`` reads cells that hold line breaks (S32); a file is then one
    task. Without it files are split, and a cell with a line break fails.
    """
    return (spark.read.schema(schema).option("header", header).option("multiLine", multi_line)
            .option("quote", '"').option("escape", '"').option("mode", "FAILFAST").csv(path))


def write_csv(df: DataFrame, path: str, header: bool = True, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("header", header).option("quote", '"').option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_mc_items(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC2: headerless multiple-choice files, positional columns named after the fact."""
    df = read_csv(spark, path, MC_ITEM_SCHEMA, header=False, multi_line=multi_line)
    return df.toDF(*MC_ITEM_NAMES)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC3: JSON lines with a declared (possibly nested) schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SNK2/SNK3: JSON lines, UTF-8, non-ASCII kept as is; optional one folder per key combination."""
    w = df.write.mode("overwrite").option("encoding", "UTF-8")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def with_file_name(df: DataFrame, pattern: str, group: int = 1, name: str = "file_key") -> DataFrame:
    """SRC5: file name as metadata — extract a key from ``_metadata.file_path``."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, group))


def write_report_csv(df: DataFrame, path: str, order_by: list[str]) -> None:
    """SNK1: ordered report CSV. Only for report-sized frames (bounded by dimensions): one file."""
    df.orderBy(*order_by).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_sharded_jsonl(df: DataFrame, path: str, shard_col: str = "shard") -> None:
    """SNK4: one folder per request shard (size-limited batch files), written in parallel."""
    df.write.mode("overwrite").partitionBy(shard_col).json(path)
