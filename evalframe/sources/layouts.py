"""SRC5 / A-WC: files of different layouts in one scan, by rules on the file name.

A folder holds CSV files whose columns mean different things: some without a
header, some with one, some not to be counted at all. Spark reads them once with
positional string columns; a rule, chosen by file name, says which positions
hold text and which line is a header. Rules are plain data (tens of them), so they become a ``CASE`` over
the file name: no file list is walked on the driver, a file that is absent gives
no rows, and a file that no rule names is reported rather than dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions.text import word_count

COUNTED, SKIPPED, UNKNOWN = "counted", "skipped", "unknown"


@dataclass(frozen=True)
class Layout:
    """Files whose name matches ``pattern``: text in the columns ``start`` to ``stop`` (from 0, ``stop`` excluded; negative from the file's ``width``)."""

    name: str
    pattern: str
    width: int
    start: int = 0
    stop: int | None = None
    header: bool = False
    skip: str | None = None
    unless: str | None = None

    def positions(self) -> range:
        return range(self.width)[slice(self.start, self.stop)]

    def skips(self, file: Column) -> Column:
        """Files of the layout that are not counted: ``skip`` matches their name and ``unless`` does not."""
        if not self.skip:
            return F.lit(False)
        return file.rlike(self.skip) & (~file.rlike(self.unless) if self.unless else F.lit(True))


def read_layouts(spark: SparkSession, path: str, layouts: Sequence[Layout], suffix: str = r"_([a-z]{2,3})\.csv", multi_line: bool = False) -> DataFrame:
    """``(file, lang, layout, status, row, cells)``: all rows of all files, ``cells`` the texts the first matching layout names.

    ``multi_line`` reads cells with line breaks, at the price of one task per
    file. ``lang`` is the name's suffix. Rows of skipped and unknown files have
    no cells. A folder of parts, as ``write_named`` makes it, counts as the file of the folder's name.
    """
    width = max(x.width for x in layouts)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    raw = (spark.read.schema(schema).option("header", False).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
           .option("mode", "PERMISSIVE").option("recursiveFileLookup", True).csv(path)
           .select("*", F.url_decode(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("at")))
    own, folder = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"(?:[^/=]+=)?([^/]+)/[^/]+$", 1)
    raw = raw.withColumn("file", F.when(own.startswith("part-"), folder).otherwise(own))
    file, layout, status, cells = F.col("file"), F.lit(None).cast("string"), F.lit(UNKNOWN), F.array().cast("array<string>")
    for x in reversed(layouts):
        here = file.rlike(x.pattern)
        layout = F.when(here, x.name).otherwise(layout)
        status = F.when(here, F.when(x.skips(file), SKIPPED).otherwise(COUNTED)).otherwise(status)
        cells = F.when(here & ~x.skips(file), F.array(*[f"_c{i}" for i in x.positions()])).otherwise(cells)
    out = raw.select("path", "file", F.nullif(F.regexp_extract("file", suffix, 1), F.lit("")).alias("lang"), layout.alias("layout"),
                     status.alias("status"), F.struct("block", "at").alias("row"), cells.alias("cells"))
    with_header = [x.name for x in layouts if x.header]
    if not with_header:
        return out.drop("path")
    # a header is the first row of its file: the least (block, place), one small row per file
    firsts = out.filter(F.col("layout").isin(with_header)).groupBy("path").agg(F.min("row").alias("first"))
    return out.join(firsts, "path", "left").filter(F.col("first").isNull() | (F.col("row") != F.col("first"))).drop("first", "path")


def words_by_file(rows: DataFrame, pandas_compat: bool = False) -> DataFrame:
    """A-WC: ``(file, lang, layout, status, n_rows, words)`` per file and, with null file, in total.

    ``pandas_compat`` counts an empty cell as one word, as the published totals do (S17).
    """
    n = F.aggregate(F.transform("cells", lambda c: word_count(c, pandas_compat)), F.lit(0).cast("bigint"), lambda a, b: a + b)
    per = rows.groupBy("file", "lang", "layout", "status").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(n).alias("words"))
    total = per.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    none = [F.lit(None).cast("string").alias(c) for c in ("file", "lang", "layout")]
    return per.unionByName(total.select(*none, F.lit("total").alias("status"), "n_rows", "words"))


def write_named(df: DataFrame, path: str, name: str, header: bool = False) -> None:
    """One folder of CSV parts per value of ``name``."""
    (df.write.mode("overwrite").partitionBy(name).option("header", header).option("quote", '"').option("escape", '"').csv(path))
