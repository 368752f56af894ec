"""STR1: incremental scorer over a growing answers folder (Structured Streaming, keyed state).

The reference appends answers to a log and resumes where it stopped. Here the
log is a folder of JSON-lines files read with ``readStream``; a request can be
answered again, and the answer latest in load order (``seq``) counts, as in the
batch scorer (of equal ``seq`` a right one).

Answers are scored as they are read. The state store keeps, per request, the
``seq`` and score of its last answer, in ``SHARDS`` shards of requests by the hash
of their ids (a state of its own costs milliseconds in Python, far more than the
requests of a shard together). An epoch touches only the shards it has answers
for, and emits what they change in the counts, a row per request: one more answer
where the request is new, the difference of the scores where it is answered again,
nothing where the answer is older than the known one. The sink adds an epoch's
changes to the counts of the epoch before, a table of one row per (model, language,
benchmark), and writes them as a folder of this epoch. So the work of an epoch
follows its batch, and the shards of its requests, whatever else has been answered before.

Restarts: an epoch that failed runs again on the same files and the state before
it, so it emits the same changes, and it rewrites its own folder from that of the
epoch before. Readers take the newest epoch whose folder is complete. The counts
folder and the checkpoint belong together; a counts folder that lacks the epoch
before raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.functions import scoring as sc

GENERATION_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("custom_id", T.StringType()), T.StructField("content", T.StringType())])
CELL = ["model", "lang", "benchmark"]
COUNTS_SCHEMA = "model string, lang string, benchmark string, n_answers long, n_correct long"
FILES_PER_TRIGGER = 1000
#: Shards of requests, each one row of the state; fixed in a checkpoint, like its partitions. 10 million requests are 2,400 a shard.
SHARDS = 1 << 12
#: Bytes of the hash that tells a shard's requests apart.
DIGEST = 16
#: A shard: its requests' hashes, the ``seq`` and the score of their last answers, one after the other.
SHARD_SCHEMA = "ids binary, seqs binary, scores binary"
#: State on the executors' disks with increments in the checkpoint, not in their heaps.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scored(answers: DataFrame) -> DataFrame:
    """``(custom_id, model, lang, benchmark, seq, correct)`` of every answer; the texts go no further."""
    p = sc.parse_custom_id(F.col("custom_id"))
    return answers.select("custom_id", *[p[c].alias(c) for c in CELL], "seq",
                          sc.score_generation("custom_id", "content", p["benchmark"]).cast("int").alias("correct"))


def last_scores(answers: DataFrame) -> DataFrame:
    """The batch rule: the score of each request's last answer."""
    packed = F.max(F.shiftleft("seq", 1) + F.col("correct")).alias("p")
    last = scored(answers).groupBy("custom_id", *CELL).agg(packed)
    return last.select("custom_id", F.shiftright("p", 1).alias("seq"), *CELL, F.col("p").bitwiseAND(F.lit(1)).cast("int").alias("correct"))


def running_accuracy(scores: DataFrame) -> DataFrame:
    """Counts per (model, language, benchmark) of a table of last scores."""
    return scores.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_answers"), F.sum("correct").alias("n_correct"))


def changes(answers: DataFrame) -> DataFrame:
    """The stream of changes in the counts. Answers without an id or ``seq`` are left out."""
    cell, size = list(CELL), DIGEST

    def changes_of(key: tuple, answers: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """What new answers to requests of one shard change in the counts."""
        ids, seqs, scores = map(bytes, state.get) if state.exists else (b"", b"", b"")
        known = {ids[size * k:size * (k + 1)]: last for k, last in enumerate(zip(np.frombuffer(seqs, "<i8").tolist(), scores))}
        new = {}
        for part in answers:
            for i, seq, correct, *of in zip(*(part[c].tolist() for c in ["id", "seq", "correct", *cell])):
                best = new[i][0] if i in new else known.get(i)
                if best is None or (seq, correct) > best:
                    new[i] = ((seq, correct), of)
        if not new:
            return
        out = []
        for i, (best, of) in new.items():
            change = (0, best[1] - known[i][1]) if i in known else (1, best[1])
            known[i] = best
            if any(change):
                out.append((*of, *change))
        seqs, scores = zip(*known.values())
        state.update((b"".join(known), np.array(seqs, "<i8").tobytes(), bytes(scores)))
        if out:
            yield pd.DataFrame(out, columns=[*cell, "n_answers", "n_correct"])

    known = scored(answers).filter(F.col("custom_id").isNotNull() & F.col("seq").isNotNull() & F.col("correct").isNotNull())
    digest = F.unhex(F.substring(F.sha2("custom_id", 256), 1, 2 * DIGEST))
    known = known.select(F.pmod(F.xxhash64("custom_id"), F.lit(SHARDS)).alias("shard"), digest.alias("id"), "seq", "correct", *CELL)
    return known.groupBy("shard").applyInPandasWithState(changes_of, COUNTS_SCHEMA, SHARD_SCHEMA, "update", "NoTimeout")


def _folder(table_dir: str, epoch: int) -> str:
    return f"{table_dir}/epoch={epoch}"


def _add(batch: DataFrame, epoch: int, table_dir: str) -> None:
    """Writes the counts after this epoch."""
    spark = batch.sparkSession
    if epoch:
        batch = batch.unionByName(spark.read.schema(COUNTS_SCHEMA).parquet(_folder(table_dir, epoch - 1)))
    total = batch.groupBy(*CELL).agg(F.sum("n_answers").alias("n_answers"), F.sum("n_correct").alias("n_correct"))
    total.coalesce(1).write.mode("overwrite").parquet(_folder(table_dir, epoch))


def counts(spark: SparkSession, table_dir: str) -> DataFrame:
    """The counts after the newest epoch; none if nothing has been answered yet. Read errors raise."""
    try:
        epochs = spark.read.schema(COUNTS_SCHEMA + ", epoch long").parquet(table_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COUNTS_SCHEMA)
    newest = epochs.agg(F.max("epoch")).first()[0]
    return epochs.filter(F.col("epoch").eqNullSafe(F.lit(newest))).drop("epoch")  # partition pruning: one folder is read


def run_available(spark: SparkSession, source_dir: str, table_dir: str, checkpoint: str,
                  files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Process everything currently in ``source_dir`` (``availableNow``) and return the running counts."""
    src = (spark.readStream.schema(GENERATION_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(source_dir))
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, STATE_STORE)
    try:
        q = (changes(src).writeStream.foreachBatch(lambda batch, epoch: _add(batch, epoch, table_dir)).outputMode("update")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    return counts(spark, table_dir)
