"""STR1: the streaming scorer resumes from its checkpoint and ends equal to the batch rule (the last answer counts)."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from evalframe.plans import catalog
from evalframe.sources import files
from evalframe.sources.tables import v_generations
from evalframe.streaming import running_accuracy as stream

from conftest import SF_SMALL


def equal(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_resume_from_checkpoint_equals_batch(spark):
    base = files.scratch_path(spark, "stream-test")
    src, table, ckpt = f"{base}/answers", f"{base}/table", f"{base}/_checkpoint"
    g = v_generations(spark, SF_SMALL).select(F.col("event_id").alias("seq"), "custom_id", "content")
    assert g.count() > g.select("custom_id").distinct().count()  # requests answered twice
    early = F.col("seq") < 600
    g.filter(early).repartition(4).write.json(src)
    first = stream.run_available(spark, src, table, ckpt, files_per_trigger=2)
    assert first.agg(F.sum("n_answers")).first()[0] == g.filter(early).select("custom_id").distinct().count()
    g.filter(~early).repartition(3).write.mode("append").json(src)        # new answers arrive, some to old requests
    final = stream.run_available(spark, src, table, ckpt, files_per_trigger=1)  # rerun resumes
    assert equal(final, stream.running_accuracy(stream.last_scores(g)))
    total = final.groupBy("model", "benchmark", "lang").agg(F.sum("n_answers").alias("n"))
    scored = catalog.queries()["score_generations"](spark, SF_SMALL).filter("n_answers > 0").select("model", "benchmark", "lang", F.col("n_answers").alias("n"))
    assert equal(total, scored)


ID = "view-on-af-mmlu-virology-4-answer-A"
OTHER = "view-on-af-mmlu-virology-5-answer-B"


def arrive(spark, base, rows):
    spark.createDataFrame(rows, "seq long, custom_id string, content string").coalesce(1).write.mode("append").json(f"{base}/answers")
    return stream.run_available(spark, f"{base}/answers", f"{base}/table", f"{base}/c", files_per_trigger=1)


def test_answers_that_change_from_epoch_to_epoch(spark):
    base = files.scratch_path(spark, "stream-order")
    epochs = [([(2, ID, "A")], (1, 1)), ([(1, ID, "")], (1, 1)),          # an older answer arrives late: nothing changes
              ([(3, ID, "B"), (4, OTHER, "B")], (2, 1)), ([(5, ID, "A"), (6, ID, "A")], (2, 2)),
              ([(6, ID, "C")], (2, 2)), ([(7, ID, None), (None, ID, "A"), (8, None, "A")], (2, 1))]
    arrived = []
    for rows, want in epochs:
        got = arrive(spark, base, rows)
        arrived += [r for r in rows if None not in r[:2]]
        assert [(r.n_answers, r.n_correct) for r in got.collect()] == [want]
        batch = spark.createDataFrame(arrived, "seq long, custom_id string, content string")
        assert equal(got, stream.running_accuracy(stream.last_scores(batch)))


@pytest.mark.parametrize("written", [False, True])
def test_restart_in_the_middle_of_an_epoch(spark, monkeypatch, written):
    base = files.scratch_path(spark, "stream-restart")
    arrive(spark, base, [(1, ID, "A"), (2, OTHER, "A")])
    add = stream._add

    def dies(batch, epoch, table_dir):
        if written:
            add(batch, epoch, table_dir)  # the counts are out, the epoch is not committed
        else:
            batch.count()  # the state has been updated, but not committed
        raise RuntimeError("lost")

    monkeypatch.setattr(stream, "_add", dies)
    with pytest.raises(StreamingQueryException):
        arrive(spark, base, [(3, ID, "B"), (4, "view-on-af-mmlu-virology-6-answer-C", "C")])
    monkeypatch.setattr(stream, "_add", add)
    got = stream.run_available(spark, f"{base}/answers", f"{base}/table", f"{base}/c")
    assert [(r.n_answers, r.n_correct) for r in got.collect()] == [(3, 1)]


def test_an_epoch_changes_only_what_its_answers_change(spark):
    """The work follows the batch: the changes of an epoch hold the requests of its batch alone."""
    base = files.scratch_path(spark, "stream-work")
    arrive(spark, base, [(k, f"view-on-af-mmlu-virology-{k}-answer-A", "A") for k in range(200)])
    seen = []
    add = stream._add
    stream._add = lambda batch, epoch, table_dir: (seen.append(batch.agg(F.count("*"), F.sum("n_answers"), F.sum("n_correct")).first()), add(batch, epoch, table_dir))
    try:
        got = arrive(spark, base, [(300, "view-on-af-mmlu-virology-7-answer-A", "B"), (301, "view-on-af-mmlu-virology-500-answer-A", "A")])
    finally:
        stream._add = add
    assert [tuple(r) for r in seen] == [(2, 1, 0)] and [(r.n_answers, r.n_correct) for r in got.collect()] == [(201, 200)]


def test_nothing_has_arrived(spark):
    base = files.scratch_path(spark, "stream-empty")
    spark.createDataFrame([], "seq long, custom_id string, content string").write.json(f"{base}/answers")
    assert stream.run_available(spark, f"{base}/answers", f"{base}/table", f"{base}/c").count() == 0


def test_counts_without_the_epoch_before_raise(spark):
    base = files.scratch_path(spark, "stream-foreign")
    arrive(spark, base, [(1, ID, "A")])
    spark.createDataFrame([(2, ID, "B")], "seq long, custom_id string, content string").write.mode("append").json(f"{base}/answers")
    with pytest.raises(StreamingQueryException):
        stream.run_available(spark, f"{base}/answers", f"{base}/elsewhere", f"{base}/c")


def test_requests_share_the_rows_of_the_state(spark):
    """A state row costs milliseconds in Python, so there are at most ``SHARDS`` of them, whatever the number of requests."""
    base = files.scratch_path(spark, "stream-shards")
    rows = spark.range(3 * stream.SHARDS).select(
        F.col("id").alias("seq"), F.concat(F.lit("view-on-af-mmlu-virology-"), "id", F.lit("-answer-A")).alias("custom_id"),
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("content"))
    rows.write.json(f"{base}/answers")
    got = stream.run_available(spark, f"{base}/answers", f"{base}/table", f"{base}/c")
    assert [(r.n_answers, r.n_correct) for r in got.collect()] == [(3 * stream.SHARDS, stream.SHARDS)]
    again = rows.filter("seq < 5000").select((F.col("seq") + 10 ** 6).alias("seq"), "custom_id", F.lit("A").alias("content"))
    again.write.mode("append").json(f"{base}/answers")
    got = stream.run_available(spark, f"{base}/answers", f"{base}/table", f"{base}/c")
    right = stream.SHARDS + sum(1 for k in range(5000) if k % 3)
    assert [(r.n_answers, r.n_correct) for r in got.collect()] == [(3 * stream.SHARDS, right)]
    assert spark.read.format("statestore").load(f"{base}/c").count() <= stream.SHARDS
