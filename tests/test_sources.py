"""SRC1-SRC3, SNK6, A-WC: answer files with broken lines, checked releases, files of different layouts."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from evalframe.plans import scoring_reports
from evalframe.session import materialize
from evalframe.sources import answers, files, layouts, release


def folder(**contents):
    d = tempfile.mkdtemp(prefix="evalframe-src-")
    for name, text in contents.items():
        name = name.replace("__", ".")
        with open(f"{d}/{name}", "w") as f:
            f.write(text)
    return d


def line(i, content, **more):
    return json.dumps({"custom_id": i, "response": {"body": {"choices": [{"message": {"content": content}}]}}, **more}, ensure_ascii=False)


def test_answer_lines_are_answered_failed_or_broken(spark):
    good = [line("a", "é 1"), line("b", ""), "", line("a", "later")]
    d = folder(one__jsonl="\n".join(good), two__jsonl="\n".join([
        line("c", "x")[:-9], '{"custom_id": "d", "response": null}', '{"custom_id": "e", "response": {"body": {"choices": []}}}',
        line("f", None), "[1, 2", "not json", '{"other": 1}', '{"custom_id": 7, "response": {"body": 3}}', line("d", "at last")]), three__jsonl="")
    o = answers.read_outcomes(spark, d)
    got = sorted((r.file, r.status, r.custom_id or "") for r in o.collect())
    assert got == sorted([("one.jsonl", "answered", "a"), ("one.jsonl", "answered", "a"), ("one.jsonl", "answered", "b"), ("two.jsonl", "answered", "d"),
                          *[("two.jsonl", "failed", x) for x in "def"], *[("two.jsonl", "broken", "")] * 5])
    assert dict(answers.last_answers(o).collect()) == {"a": "later", "b": "", "d": "at last"}
    path = files.scratch_path(spark, "quarantine")
    answers.quarantine(o, path)
    held = spark.read.parquet(path).collect()
    assert {r.file for r in held} == {"two.jsonl"} and len(held) == 5 and "not json" in {r.line for r in held}
    counts = {r.file: tuple(r)[2:] for r in answers.file_counts(o).collect()}
    assert counts == {"one.jsonl": (3, 3, 0, 0), "two.jsonl": (9, 1, 3, 5)}
    requests = spark.createDataFrame([(x,) for x in "abcdefg"], "custom_id string")
    outcome = dict(answers.coverage(requests, o).collect())
    assert outcome == {"a": "answered", "b": "answered", "c": "pending", "d": "answered", "e": "failed", "f": "failed", "g": "pending"}


def test_names_of_answer_files_cost_no_search_of_the_path(spark):
    """A pattern bound to the end of a path is tried from each of its characters, for every line of the file."""
    d = folder()
    for at in ("model=a", "deep/model=b.c"):
        os.makedirs(f"{d}/{at}")
        with open(f"{d}/{at}/part 1.jsonl", "w") as f:
            f.write(line("a", "x"))
    o = answers.read_outcomes(spark, d)
    assert sorted((r.folder, r.file) for r in o.select("folder", "file").collect()) == [("model=a", "part%201.jsonl"), ("model=b.c", "part%201.jsonl")]
    assert "regexp" not in o._jdf.queryExecution().optimizedPlan().toString()


def test_quarantine_query_parses_its_lines_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(scoring_reports, "materialize", lambda df, name: kept.append(name) or materialize(df, name))
    plan = scoring_reports.src_generations_quarantine(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert kept == ["outcomes"] and "json" not in plan.lower()


def items(spark, n=40):
    return spark.range(n).select((F.col("id") % 3).cast("string").alias("split"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("l"), F.col("id") % 2)).alias("lang"),
                                 F.col("id").alias("n"), F.concat(F.lit("text "), "id").alias("text"))


def expected(df):
    return df.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n_expected"))


def test_release_is_published_once(spark):
    df, path = items(spark), files.scratch_path(spark, "release-test")
    a = release.publish(df, path, "v1", ["split", "lang"], expected(df))
    assert a.filter("not counts_match").count() == 0 and a.agg(F.sum("n_written")).first()[0] == 40
    back = release.read_release(spark, path, "v1").select(*df.columns)
    assert back.exceptAll(df).count() == 0 and back.count() == 40
    release.publish(df.repartition(7), path, "v1", ["split", "lang"], expected(df))  # again: nothing changes
    assert release.manifest(spark, path).count() == 1 and sum(x.startswith("data-") for x in os.listdir(path.removeprefix("file:"))) == 1
    with pytest.raises(release.AuditError, match="exists with other rows"):
        more = df.withColumn("n", F.col("n") + 1)
        release.publish(more, path, "v1", ["split", "lang"], expected(more))
    release.publish(df.filter("n < 9"), path, "v2", ["split", "lang"], expected(df.filter("n < 9")))
    assert release.read_release(spark, path, "v2").count() == 9 and release.read_release(spark, path, "v1").count() == 40


@pytest.mark.parametrize("wrong", ["n < 39", "split <> '1'", "n < 41 or true"])
def test_a_wrong_count_leaves_no_release(spark, wrong):
    df, path = items(spark), files.scratch_path(spark, "release-wrong")
    source = df.unionByName(df.filter("n = 3")) if "true" in wrong else df.filter(wrong)
    with pytest.raises(release.AuditError, match="counts differ"):
        release.publish(df, path, "v1", ["split", "lang"], expected(source))
    assert release.manifest(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        release.read_release(spark, path, "v1")
    assert not os.path.isdir(path.removeprefix("file:")) or not [x for x in os.listdir(path.removeprefix("file:")) if x.startswith("data-")]


RULES = [layouts.Layout("items", "mmlu", 6, stop=-1, skip="_(af|zu|xh)", unless="virology"),
         layouts.Layout("sentences", "winogrande", 8, 4, 7, header=True, skip="_(af|zu|xh)", unless="virology")]


def test_words_of_files_of_different_layouts(spark):
    d = folder(**{"mmlu_nso__csv": 'one two,a,b,"c, d",e,A\nthree,,b,c,d,B\n', "mmlu_af__csv": "x y z,a,b,c,d,A\n", "virology_mmlu_af__csv": "u v,a,b,c,d,A\n",
                  "winogrande_nso__csv": "qID,p,q,r,sentence,option1,option2,answer\n1,p,q,r,He said so,he,she,1\n2,p,q,r, no break ,,x,2\n",
                  "winogrande_zu__csv": "qID,p,q,r,sentence,option1,option2,answer\n1,p,q,r,s t,o,o,1\n", "readme_nso__csv": "a b c\n"})
    rows = layouts.read_layouts(spark, d, RULES)
    got = {r.file: (r.lang, r.status, r.n_rows, r.words) for r in layouts.words_by_file(rows).collect()}
    assert got == {"mmlu_nso.csv": ("nso", "counted", 2, 2 + 1 + 1 + 2 + 1 + 1 + 1 + 1 + 1), "mmlu_af.csv": ("af", "skipped", 1, 0), "virology_mmlu_af.csv": ("af", "counted", 1, 6),
                   "winogrande_nso.csv": ("nso", "counted", 2, 3 + 1 + 1 + 2 + 1), "winogrande_zu.csv": ("zu", "skipped", 1, 0), "readme_nso.csv": ("nso", "unknown", 1, 0),
                   None: (None, "total", 8, 25)}
    as_published = {r.file: r.words for r in layouts.words_by_file(rows, pandas_compat=True).collect()}
    assert as_published["mmlu_nso.csv"] == 12 and as_published["winogrande_nso.csv"] == 9


def test_cells_with_line_breaks_need_multi_line(spark):
    d = folder(mmlu_nso__csv='"two\nlines",a,b,c,d,A\n')
    assert [r.cells[0] for r in layouts.read_layouts(spark, d, RULES, multi_line=True).collect()] == ["two\nlines"]
    assert files.read_mc_items(spark, d, multi_line=True).first().question == "two\nlines"
    with pytest.raises(Exception):
        files.read_mc_items(spark, d).collect()


def test_files_are_split_unless_multi_line(spark):
    d = folder(mmlu_nso__csv="word,a,b,c,d,A\n" * 5000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        split, whole = files.read_mc_items(spark, d), files.read_mc_items(spark, d, multi_line=True)
        assert split.rdd.getNumPartitions() > 2 and whole.rdd.getNumPartitions() == 1 and split.count() == whole.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
