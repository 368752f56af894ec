"""SRC4, SNK5: one JSON object per file, read from any splits and written in parts."""

import glob
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from evalframe.sources import files, json_objects as jo

NASTY = ['plain', 'quo"te', 'back\\slash', 'line\nbreak', '\n  "fake": 1', 'tab\t', 'é 漢字 😀', '', '{', '}', '  ', ' lead', 'a: [', 'null', ',', '\u0001']


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048b")
    spark.conf.set("spark.sql.files.openCostInBytes", "2048b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def dumped(obj, **kw):
    d = tempfile.mkdtemp(prefix="evalframe-json-")
    with open(f"{d}/answers.json", "w") as f:
        json.dump(obj, f, indent=2, **kw)
    return f"{d}/answers.json"


@pytest.mark.parametrize("ascii_only", [True, False])
def test_members_of_one_file_from_many_tasks(spark, small_splits, ascii_only):
    obj = {f"{w}-{k}" if k else w: w * (k % 3) for k in range(40) for w in NASTY}
    df = jo.read_members(spark, dumped(obj, ensure_ascii=ascii_only), "string")
    assert df.rdd.getNumPartitions() > 4
    assert dict(df.select("key", "value").collect()) == obj and df.count() == len(obj)
    in_order = [r.key for r in df.orderBy("block", "at").collect()]
    assert in_order == list(obj)


def test_struct_and_list_values_span_lines(spark, small_splits):
    obj = {f"id {k}": {"mean": k / 2, "runs": [k, k + 1], "note": 'x\n  "id 1": {"mean": 9}' if k % 2 else None} for k in range(60)}
    df = jo.read_members(spark, dumped(obj), "struct<mean: double, runs: array<int>, note: string>")
    assert df.rdd.getNumPartitions() > 2
    assert {r.key: r.value.asDict() for r in df.collect()} == obj


def test_null_numbers_and_empty_objects(spark):
    assert dict(jo.read_object(spark, dumped({"a": 1, "b": None}), "int").collect()) == {"a": 1, "b": None}
    assert jo.read_object(spark, dumped({}), "int").count() == 0
    assert dict(jo.read_object(spark, dumped({"only": "x"}), "string").collect()) == {"only": "x"}


def test_last_of_repeated_members_counts(spark):
    d = tempfile.mkdtemp(prefix="evalframe-json-")
    text = '{\n  "a": "1",\n  "b": "2",\n  "a": "3"\n}'
    open(f"{d}/x.json", "w").write(text)
    assert dict(jo.read_object(spark, f"{d}/x.json", "string").collect()) == json.loads(text)


@pytest.mark.parametrize("text", ['{"a": 1, "b": 2}', '{\n  "a": 1,\n  "b": x\n}', '{\n  "a": 1\n  "b"\n}'])
def test_other_layouts_and_broken_members_raise(spark, text):
    d = tempfile.mkdtemp(prefix="evalframe-json-")
    open(f"{d}/x.json", "w").write(text)
    with pytest.raises(Exception):
        jo.read_members(spark, f"{d}/x.json", "int").collect()


def joined(path):
    names = sorted(glob.glob(f"{path.removeprefix('file:')}/part=*/*.txt"))
    assert len({os.path.dirname(n) for n in names}) == len(names)  # one file per range
    return "".join(open(n).read() for n in names), len(names)


def test_written_object_joins_to_one(spark, small_splits):
    rows = [(w + str(k), w) for k in range(30) for w in NASTY]
    path = files.scratch_path(spark, "object")
    jo.write_object(spark.createDataFrame(rows, "k string, v string"), path, "k", "v")
    text, parts = joined(path)
    assert parts > 1 and json.loads(text) == dict(rows) and list(json.loads(text)) == sorted(dict(rows), key=str.encode)
    assert dict(jo.read_object(spark, path, "string").collect()) == dict(rows)
    with pytest.raises(Exception, match="repeated key"):
        jo.write_object(spark.createDataFrame([("a", "1"), ("a", "2")], "k string, v string"), path + "-2", "k", "v")


def nested(rows):
    out = {}
    for a, b, c, v in sorted((*["null" if x is None else x for x in r[:3]], r[3]) for r in rows):
        out.setdefault(a, {}).setdefault(b, {}).setdefault(c, []).append(v)
    return out


def test_nested_object_in_parts(spark, small_splits):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000b")  # enough parts; the fixture puts it back
    rows = [(a, b, c, f"{a}-{k}") for a in ("af", "zu", "é\"") for b in ("x", None) for c in ("high", "low", "med") for k in range(7)]
    rows += [("af", "x", "low", f"hot {k:05d} " + NASTY[k % len(NASTY)]) for k in range(1500)]  # one list is most of the rows
    rows += [("solo", "s", "t", "u"), ("solo", "s", "t", "u")]
    df = spark.createDataFrame(rows, "lang string, train string, bucket string, id string")
    path = files.scratch_path(spark, "nested")
    jo.write_nested(df, path, ["lang", "train", "bucket"], "id")
    text, parts = joined(path)
    want = nested(rows)
    assert parts > 2 and json.loads(text) == want
    assert text.rstrip("\n") == json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    back = jo.read_nested(spark, path, ["lang", "train", "bucket"], "id")
    assert back.rdd.getNumPartitions() >= 1
    plain = df.withColumn("train", F.coalesce("train", F.lit("null")))
    assert back.exceptAll(plain).count() == 0 and plain.exceptAll(back).count() == 0
    whole = dumped(want, ensure_ascii=False)  # the same object in one file, cut into splits by the reader
    back = jo.read_nested(spark, whole, ["lang", "train", "bucket"], "id")
    assert back.exceptAll(plain).count() == 0 and plain.exceptAll(back).count() == 0


def test_nested_object_of_nothing(spark):
    path = files.scratch_path(spark, "nested-empty")
    jo.write_nested(spark.createDataFrame([], "a string, v string"), path, ["a"], "v")
    assert json.loads(joined(path)[0]) == {} and jo.read_nested(spark, path, ["a"], "v").count() == 0
