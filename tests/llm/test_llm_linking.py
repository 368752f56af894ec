import random

import pytest
from pyspark.sql import functions as F

from evalframe.llm.linking import components, link, rows_without
from llm_util import Union


def labels(df):
    return {r.id: r.component for r in df.collect()}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1030)] + [(5, 5)]
    edges += [(-7, k) for k in range(2000, 2100)]
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = labels(components(spark.createDataFrame(edges, "a long, b long")))
    assert {x: got.get(x, x) for x in u.up} == {x: u.find(x) for x in u.up}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_link_finds_the_components_of_all_pairs(spark, seed):
    """Ids 0..n with a position; linked if they share a bucket and are at most 2 apart: chains that hubs alone do not join."""
    rng = random.Random(seed)
    pos = {i: rng.randint(0, 120) for i in range(90)}
    posts = [(b, i, 1) for i in pos for b in rng.sample(range(6), 2)]
    u = Union(pos)
    by = {}
    for b, i, _ in posts:
        by.setdefault(b, []).append(i)
    for v in by.values():
        for a in v:
            for b in v:
                if a < b and abs(pos[a] - pos[b]) <= 2:
                    u.join(a, b)
    where = spark.createDataFrame(list(pos.items()), "i long, p long")

    def test(pairs):
        x = pairs.join(where.toDF("a", "pa"), "a").join(where.toDF("b", "pb"), "b")
        return x.filter(F.abs(F.col("pa") - F.col("pb")) <= 2).select("a", "b", F.lit(1).cast("long").alias("score"))

    got = labels(link(spark.createDataFrame(posts, "bucket long, id long, rank long"), test))
    assert {i: got.get(i, i) for i in pos} == {i: u.find(i) for i in pos}


def test_hub_of_a_large_group_costs_no_pairs(spark):
    n, seen = 400, []

    def test(pairs):
        seen.append(pairs.count())
        return pairs.withColumn("score", F.lit(1).cast("long"))

    posts = spark.range(n).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("bucket"), "id", F.lit(0).alias("rank"))
    assert set(labels(link(posts, test)).values()) == {0}
    assert sum(seen) < 2 * n


def test_rows_without_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "uid long, _row string").coalesce(1)
    assert [tuple(r) for r in rows_without(df, spark.createDataFrame([(0,)], "uid long")).collect()] == [(2, "b")]


@pytest.mark.parametrize("limit", [{"BROADCAST_IDS": 0}, {"BROADCAST_BYTES": 0}, {}])
def test_rows_of_ids_by_either_way(spark, monkeypatch, limit):
    """Sent to the scan, or by a shuffle: the same rows."""
    from evalframe.llm import linking

    for k, v in limit.items():
        monkeypatch.setattr(linking, k, v)
    df = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "id long, t string")
    ids = spark.createDataFrame([(k, k * 2) for k in range(0, 60, 7)], "id long, n int")
    got = linking.rows_of_ids(df, ids, "id", F.col("n") * 0 + 8)
    assert {tuple(r) for r in got.collect()} == {(k, f"t{k}", k * 2) for k in range(0, 50, 7)}
    assert ("BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()) or limit
