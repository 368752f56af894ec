import math
import random

import numpy as np
import pytest

from evalframe.llm import embed_dedup, registry
from llm_util import SF, Union, same


def brute(rows, threshold):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    u, n = Union([i for i, _ in rows]), {i: 0 for i, _ in rows}
    for k, (i, a) in enumerate(ok):
        for j, b in ok[k + 1:]:
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                n[i] += 1
                n[j] += 1
                u.join(i, j)
    return {i: (n[i], u.find(i)) for i, _ in rows}


def test_query_matches_sql(spark):
    same(registry.queries()["op2_embed_graph"](spark, SF), registry.oracle_sql()["op2_embed_graph"])


@pytest.mark.parametrize("block,per_cluster", [(2500, 400), (60, 60)])
def test_groups_copies_and_odd_vectors(spark, monkeypatch, block, per_cluster):
    """Groups near one another, exact and scaled copies; with small shards that are cut into blocks."""
    monkeypatch.setattr(embed_dedup, "PER_CLUSTER", per_cluster)
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for size in (90, 40, 5, 2, 2, 2):
        base = rng.normal(size=24)
        for _ in range(size):
            rows.append((k, (base + rng.normal(size=24) * 0.12).tolist()))
            k += 1
    for _ in range(200):
        rows.append((k, rng.normal(size=24).tolist()))
        k += 1
    rows += [(k, rows[0][1]), (k + 1, [2 * x for x in rows[0][1]]), (k + 2, None), (k + 3, []), (k + 4, [0.0] * 24), (k + 5, [None] + [1.0] * 23),
             (k + 6, [float("nan")] + [1.0] * 23), (k + 7, [float("inf")] + [1.0] * 23), (k + 8, [1.0, 0.0]), (k + 9, [2.0, 0.0]), (k + 10, [0.0, 1.0]), (k + 11, [0.0] * 24)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, uid string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(df, block=block).collect()}
    want = brute(rows, 0.9)
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want) and found >= 0.98 * true
    assert {i: v[1] for i, v in got.items()} == {i: v[1] for i, v in want.items()}


def test_rows_with_equal_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links) for r in embed_dedup.near_vectors(df).collect()) == [(0, 0), (1, 1), (1, 1)]
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0
    assert [tuple(r) for r in embed_dedup.near_vectors(spark.createDataFrame([(5, None)], "vec_id long, embedding array<float>")).select("vec_id", "n_links", "component_id", "kept").collect()] == [(5, 0, 5, True)]


def test_pruning_keeps_the_nearest_and_drops_what_it_covers():
    v = np.array([[1, 0], [math.cos(0.1), math.sin(0.1)], [math.cos(0.11), math.sin(0.11)], [math.cos(0.3), -math.sin(0.3)]])
    near = v[[1, 2, 3]]
    assert embed_dedup.prune((near @ near.T)[None], (near @ v[0])[None]).tolist() == [[True, False, True]]
    assert embed_dedup.prune((near @ near.T)[None], (near @ v[0])[None], degree=1).tolist() == [[True, False, False]]


def plain_prune(v, i, degree, alpha, candidates):
    """Robust pruning of one node as it is defined."""
    dist = lambda x, y: math.sqrt(max(0.0, 2 - 2 * float(v[x] @ v[y])))
    left = sorted((k for k in range(len(v)) if k != i), key=lambda k: (dist(i, k), k))[:candidates]
    kept = []
    while left and len(kept) < degree:
        p = left.pop(0)
        kept.append(p)
        left = [x for x in left if alpha * dist(p, x) > dist(i, x)]
    return set(kept)


def test_graph_equals_pruning_node_by_node():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a, b = embed_dedup.build_graph(v, candidates=12, degree=4, step=32)
    edges = set(zip(a.tolist(), b.tolist()))
    want = {i: plain_prune(v, i, 4, embed_dedup.ALPHA, 12) for i in range(90)}
    assert all((i, j) in edges for i in want for j in want[i]) and len(edges) == len(a)
    assert all(j in want[i] or i in want[j] for i, j in edges) and np.bincount(a).max() <= 8
    assert [len(x) for x in embed_dedup.build_graph(v[:1])] == [0, 0] and sorted(zip(*map(list, embed_dedup.build_graph(v[:2])))) == [(0, 1), (1, 0)]


def test_search_follows_the_range_and_no_further():
    angle = np.arange(0, 60) * 0.05  # a chain on a circle: each point links to the nine or so on either side
    v = np.column_stack([np.cos(angle), np.sin(angle)])
    adj = np.array([[k - 1 if k else 60, k + 1 if k < 59 else 60] for k in range(60)])
    hits = embed_dedup.range_search(v[[30, 5]], (np.array([0, 1]), np.array([0, 0])), v, adj, 0.9, beam=2)
    assert (hits == (v[[30, 5]] @ v.T >= 0.9)).all()
    lone = embed_dedup.range_search(v[[30]], (np.array([0]), np.array([59])), v, np.full((60, 1), 60), 0.9)
    assert not lone.any()  # without edges nothing but the entry is seen


def test_cosine_at_the_threshold_links(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, 4.1])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(df, threshold=0.6).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_audit_sees_missing_links(spark):
    v = np.array([1.0, 0.0]).tobytes()
    reps = spark.createDataFrame([(k, 1, v) for k in range(4)], "id long, w long, v binary")
    full = spark.createDataFrame([(k, 3) for k in range(4)], "id long, links long")
    half = spark.createDataFrame([(k, 1) for k in range(4)], "id long, links long")
    assert embed_dedup.audit(reps, full, 0.9) == 1.0 and abs(embed_dedup.audit(reps, half, 0.9) - 1 / 3) < 1e-9


def groups(sizes, dim=64, seed=6, noise=0.03):
    rng, rows = np.random.default_rng(seed), []
    for size in sizes:
        base = rng.normal(size=dim)
        rows += [(base + rng.normal(size=dim) * noise).tolist() for _ in range(size)]
    return list(enumerate(rows))


def exact(rows, threshold=0.9):
    """{id: links} by all cosines."""
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return {i: int(n) for (i, _), n in zip(rows, (v @ v.T >= threshold).sum(axis=1) - 1)}


def per_class(got, want):
    """Mean share of the links found, per class of group sizes (powers of two)."""
    shares = {}
    for i, n in want.items():
        if n:
            shares.setdefault(n.bit_length(), []).append(got[i] / n)
    return {k: sum(x) / len(x) for k, x in shares.items()}


@pytest.mark.parametrize("block", [5000, 700])
def test_recall_by_size_of_group(spark, monkeypatch, block):
    """20,000 vectors in groups of 2 to 2,000 and alone, more than 20 shards; with small blocks, shards are clustered again."""
    rows = groups([2000] * 2 + [500] * 4 + [130] * 10 + [48] * 20 + [20] * 50 + [7] * 150 + [3] * 400 + [2] * 1500 + [1] * 6000, noise=0.15)
    shards = []
    plain = embed_dedup._search
    monkeypatch.setattr(embed_dedup, "_search", lambda placed, *a: shards.append(placed.select(embed_dedup.F.explode("places")).distinct().count()) or plain(placed, *a))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(df, block=block).collect()}
    want = exact(rows)
    assert len(rows) > 17_000 and max(shards) > 20 and all(got[i] <= want[i] for i in want)
    assert min(per_class(got, want).values()) > 0.95, per_class(got, want)


def test_a_dense_group_over_many_blocks(spark):
    """One shard, in which a group takes most rows: its blocks are reached through medoids and lists of other shards."""
    rows = groups([900] + [2] * 60, noise=0.1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2)
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df, block=200).collect()}
    want = exact(rows)
    assert min(per_class({i: r.n_links for i, r in got.items()}, want).values()) >= 0.9
    assert len({got[i].component_id for i in range(900)}) == 1


def test_low_recall_raises(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "audit", lambda *a: 0.4)
    df = spark.createDataFrame(groups([3] * 4), "vec_id long, embedding array<double>").coalesce(1)
    with pytest.raises(embed_dedup.LowRecall, match="0.400 after 2 rounds"):
        embed_dedup.near_vectors(df, rounds=2).collect()


def test_audit_sees_losses_of_small_groups(spark):
    """A complete group of 100 outweighs in links what 50 pairs lose."""
    e = lambda k: np.eye(51)[k].tobytes()
    reps = spark.createDataFrame([(k, 1, e(50)) for k in range(100)] + [(100 + k, 1, e(k // 2)) for k in range(100)], "id long, w long, v binary")
    counts = spark.createDataFrame([(k, 99) for k in range(100)] + [(100 + k, 0) for k in range(100)], "id long, links long")
    assert embed_dedup.audit(reps, counts, 0.9) == 0.0
    assert embed_dedup.audit(reps, counts.filter("id < 100"), 0.9) == 0.0


@pytest.mark.parametrize("overlap", [1, 4])
def test_small_groups_beside_a_hot_one(spark, monkeypatch, overlap):
    """Groups cut by shards: rounds with more overlap go on until no class of groups loses links."""
    monkeypatch.setattr(embed_dedup, "PER_CLUSTER", 40)
    rows = groups([250] + [3] * 100, dim=12, noise=0.15)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2)
    found = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(df, overlap=overlap).collect()}
    want = exact(rows)
    assert all(found[i] <= want[i] for i in want) and min(per_class(found, want).values()) >= 0.9
