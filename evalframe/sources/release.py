"""SNK6: write, audit, publish.

The reference asserts row counts while it writes its release. Here a release is
written to a folder that no reader looks at, its rows are counted and summed by
hash in the job that writes them (an observation), the files are read back and counted
per partition, and only if all counts agree a manifest names the folder. Readers
go by the manifest, so a release is seen whole or not at all. A failed audit
removes the folder. Publishing the same rows under the same version again changes
nothing; other rows under a version that exists are refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version string, folder string, partition_columns array<string>, n_rows long, fingerprint decimal(38,0), n_partitions long"


class AuditError(ValueError):
    """The written release does not have the rows it should have."""


def _fingerprint(df: DataFrame) -> Column:
    """Sum of row hashes: independent of order, sensitive to every row and copy."""
    names = sorted(df.columns)
    return F.coalesce(F.sum(F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) for c in names]).cast("decimal(38,0)")),
                      F.lit(0).cast("decimal(38,0)"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """All published versions below ``path``; none if nothing has been published."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def read_release(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The rows of a published version; a version that is not published raises."""
    rows = manifest(spark, path).filter(F.col("version") == version).take(1)
    if not rows:
        raise FileNotFoundError(f"release {version} is not published below {path}")
    return spark.read.parquet(f"{path}/{rows[0]['folder']}")


def _remove(spark: SparkSession, folder: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def audit(written: DataFrame, expected: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(*by, n_written, n_expected, counts_match)`` per partition; ``expected`` has ``n_expected`` per ``by``."""
    w = written.groupBy(*by).agg(F.count(F.lit(1)).alias("n_written")).alias("w")
    e = expected.select(*by, "n_expected").alias("e")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    j = e.join(w, cond, "full")
    n_w, n_e = F.coalesce("w.n_written", F.lit(0)), F.coalesce("e.n_expected", F.lit(0))
    return j.select(*[F.coalesce(f"e.{c}", f"w.{c}").alias(c) for c in by], n_w.alias("n_written"), n_e.alias("n_expected"), (n_w == n_e).alias("counts_match"))


def publish(df: DataFrame, path: str, version: str, by: Sequence[str], expected: DataFrame) -> DataFrame:
    """Publish ``df`` as ``version`` and return the audit of its partitions.

    ``expected (*by, n_expected)`` comes from where the rows do, not from ``df``. Raises ``AuditError``, and
    leaves no release, if the counts differ from it, or the files from what was written (so an empty
    string as a partition, which reads back as null, is refused too).
    """
    spark = df.sparkSession
    folder = f"data-{version}-{uuid.uuid4().hex}"
    staged, seen = f"{path}/{folder}", Observation(f"release-{uuid.uuid4().hex}")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows"), _fingerprint(df).alias("fingerprint")).write.partitionBy(*by).parquet(staged)
        back = spark.read.schema(df.schema).parquet(staged)
        result = audit(back, expected, by)
        wrong = result.filter(~F.col("counts_match")).take(10)
        if wrong:
            raise AuditError(f"release {version}: counts differ, for example {[tuple(r) for r in wrong]}")
        n, found = back.agg(F.count(F.lit(1)), _fingerprint(back)).first()
        if (n, found) != (seen.get["rows"], seen.get["fingerprint"]):
            raise AuditError(f"release {version}: {seen.get['rows']} rows were written, {n} read back, or with other values")
    except Exception:
        _remove(spark, staged)
        raise
    known = manifest(spark, path).filter(F.col("version") == version).take(1)
    if known:
        _remove(spark, staged)
        if (known[0]["n_rows"], known[0]["fingerprint"]) != (n, found):
            raise AuditError(f"release {version} exists with other rows")
        return audit(read_release(spark, path, version), expected, by)
    entry = spark.createDataFrame([(version, folder, list(by), n, found, result.count())], MANIFEST)
    entry.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{version}")
    return result
