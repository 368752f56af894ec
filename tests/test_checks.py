"""J4, J8, AG15 (S10, S11): constraints that run inside the plan, and give the same whatever the partitioning."""

import pytest
from pyspark.sql import functions as F

from evalframe.operators import accuracy as acc
from evalframe.operators import checks
from evalframe.operators.pairing import translation_triples


def translations(spark, rows, parts):
    cols = "question_id string, target_lang string, approach string, benchmark string, question string"
    return spark.createDataFrame(rows, cols).repartition(parts)


ROWS = [("q-en-1", "en", "Human", "t", "one"), ("q-af-1", "af", "Human", "t", "een"), ("q-gt-af-1", "af", "Machine", "t", "een?"),
        ("q-en-2", "en", "Human", "t", "two"), ("q-en-2", "en", "Human", "u", "TWO"), ("q-af-2", "af", "Human", "t", "twee"), ("q-gt-af-2", "af", "Machine", "t", "twee?"),
        ("q-af-3", "af", "Human", "t", "drie"), ("q-gt-af-3", "af", "Machine", "t", "drie?"), ("q-gt-af-3", "af", "Machine", "t", "drie!")]


@pytest.mark.parametrize("parts", [1, 5])
def test_status_of_partners(spark, parts):
    got = {r.question_id: r for r in translation_triples(translations(spark, ROWS, parts)).collect()}
    assert {k: (r.n_en, r.n_mt, r.status) for k, r in got.items()} == {
        "q-af-1": (1, 1, "ok"), "q-af-2": (2, 1, "repeated"), "q-af-3": (0, 2, "repeated")}
    assert got["q-af-2"].en_text is None and got["q-af-2"].mt_text == "twee?" and got["q-af-1"].en_text == "one"  # no choice among several


@pytest.mark.parametrize("parts", [1, 5])
def test_a_doubled_english_row_raises(spark, parts):
    with pytest.raises(Exception, match="partners of q-af-2: 2 English, 1 machine"):
        translation_triples(translations(spark, ROWS[:7], parts), raise_on=("repeated",)).filter("status = 'ok'").collect()
    ok = translation_triples(translations(spark, ROWS[:4], parts), raise_on=("repeated", "missing")).filter("status = 'ok'")
    assert [r.question_id for r in ok.collect()] == ["q-af-1"]
    with pytest.raises(Exception, match="0 English"):
        translation_triples(translations(spark, ROWS[7:9], parts), raise_on=("missing",)).select("status").collect()


@pytest.mark.parametrize("parts", [1, 6])
def test_pivot_of_a_repeated_cell_raises(spark, parts):
    long = spark.createDataFrame([("m", "en", 1.0), ("m", "af", 2.0), ("n", "en", None), ("n", "xx", 9.0), ("n", "xx", 8.0)], "model string, eval_lang string, v double")
    wide = {r.model: (r.en, r.af) for r in acc.pivot_languages(long, ["model"], "v", ["en", "af"]).collect()}
    assert wide == {"m": (1.0, 2.0), "n": (None, None)}  # languages that are not asked for may repeat
    twice = long.unionByName(long.filter("model = 'n' and eval_lang = 'en'")).repartition(parts)  # the same cell, even if null
    with pytest.raises(Exception, match="n, en: 2 rows for one cell"):
        acc.pivot_languages(twice, ["model"], "v", ["en", "af"]).collect()


@pytest.mark.parametrize("parts", [1, 6])
def test_lookup_must_be_complete_and_single(spark, parts):
    labels = spark.createDataFrame([(k, "x") for k in (1, 1, 2, 3, None)], "k long, tag string").repartition(parts)
    rows = spark.createDataFrame([(1, 0.5), (2, 1.0), (2, 2.0), (9, 3.0)], "k long, v double").repartition(parts)
    got = sorted((str(r.k), r.v, r.status) for r in checks.lookup(labels, rows, ["k"], on_broken="status").collect())
    assert got == [("1", 0.5, "ok"), ("1", 0.5, "ok"), ("2", None, "repeated"), ("3", None, "missing"), ("None", None, "missing")]
    assert checks.lookup(labels.filter("k = 1"), rows, ["k"]).collect()[0].v == 0.5
    for k, n in ((2, 2), (3, 0)):
        with pytest.raises(Exception, match=f"lookup of {k}: {n} rows"):
            checks.lookup(labels.filter(f"k = {k}"), rows, ["k"]).collect()


def test_counts_observed_by_the_job_itself(spark):
    df, seen = checks.observed(spark.range(10), "t", even=F.col("id") % 2 == 0, none=F.col("id") > 99)
    assert df.count() == 10 and seen.get == {"rows": 10, "even": 5, "none": 0}
