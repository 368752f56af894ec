"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "evalframe") -> SparkSession:
    """A session tuned for the library's plans.

    On a cluster the master and most sizing come from spark-submit; the
    settings below are the ones our plans rely on (AQE for runtime
    re-planning, skew-join splitting, partition coalescing).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders of intermediates written by this process, newest last (see ``cleanup``).
_WRITTEN: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for materialised intermediates, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset, a local session (one JVM) gets a temporary folder; on a
    cluster, whose executors do not share one, that is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect has no context: the server's setting applies
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        configured = tempfile.mkdtemp(prefix="evalframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; ``cleanup`` removes what was written there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back. This runs a job.

    Cuts the lineage like ``checkpoint()`` (a lost executor re-reads the table
    instead of recomputing upstream stages), fixes the rows once for every
    later reader, and stays columnar and splittable — unlike an RDD
    checkpoint, which is row-serialised and keeps the (possibly coalesced)
    partitioning of the stage that wrote it. Queries that use it run jobs while
    they are built; the tables stay until ``cleanup``. ``codec`` names a compression
    other than the session's.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Delete the intermediates written so far, once the results built on them are consumed; returns how many folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n
