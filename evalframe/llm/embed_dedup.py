"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards.

1. Vectors are normalised in double precision; equal ones are one representative
   with a weight. Centroids are fitted on a bounded sample (``MAX_SAMPLE``);
   every representative is placed in the shards of its ``overlap`` nearest
   centroids. A shard of more than ``block`` rows is clustered again, on a
   bounded sample of its own, and its rows go to their two nearest cells.
2. In each cell every node gets its nearest ``CANDIDATES`` as candidates and keeps
   at most ``DEGREE`` of them by robust pruning (a candidate is left out if a
   chosen neighbour is ``ALPHA`` times closer to it than the node is), and the reverse edges
   that room is left for. A node's lists from all its shards are united.
3. Search: each representative is a query in its home shard; in a shard of
   cells it visits the nearest ones and all whose centre is nearly in its range,
   which are those of a dense group around it. Greedy search starts from the
   cell's medoid, the query's own node and its united list; then the range is
   expanded: nodes down to ``SLACK`` below the threshold are followed until none
   is new. So a list found in one shard leads into the cells of another. Cosines are computed exactly, so no pair below the
   threshold is linked. Queries of a cell advance together as arrays of (query, node).
4. Audit, after every round: ``AUDIT`` queries (by hash) are compared with all
   rows by brute force, the only place where that is done. If recall, in total
   or per query of a class of group sizes, is below ``min_recall``, the overlap is
   doubled and the work is done again; after ``ROUNDS`` rounds ``LowRecall`` is raised.

Links are counted in the tasks; what leaves them is a count per query and a
spanning forest, never the pairs of a group. Work follows the nodes that searches
visit: a constant number per query, and all links of a query, each once.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing (a component of their own); vectors of different
lengths do not link; equal vectors link, and a cosine of exactly the threshold
does; rows with equal ids and equal vectors are both counted; extra columns (labels) are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.linking import components
from evalframe.llm.streams import arrow_schema, batched, rows_of
from evalframe.session import materialize

PER_CLUSTER, MAX_CLUSTERS, MAX_SAMPLE = 400, 4096, 40_000
OVERLAP, BLOCK, CELL_SAMPLE, PROBE, NEARLY = 4, 5000, 4000, 4, 0.1
CANDIDATES, DEGREE, ALPHA, BEAM, SLACK = 48, 16, 1.2, 16, 0.03
AUDIT, MIN_RECALL, CLASS, ROUNDS = 256, 0.9, 8, 3
#: Queries that advance together, and (query, node) pairs whose cosines are taken at once.
TOGETHER, PAIRS = 64, 50_000


class LowRecall(RuntimeError):
    """The audit stayed below the recall that was asked for."""


def unit(v) -> np.ndarray | None:
    """The vector normalised in double precision; None if it links with nothing."""
    if not v or any(x is None for x in v):
        return None
    a = np.asarray(v, dtype=np.float64)
    if not np.isfinite(a).all():
        return None
    top = np.abs(a).max()
    if top == 0:
        return None
    a = a / top
    return a / math.sqrt(np.dot(a, a))


def normalised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, uid, dim, k, v)``: ``v`` the unit vector's bytes, ``k`` their digest; null where nothing is to link."""
    out = "vec_id long, uid long, dim int, k binary, v binary"
    schema = arrow_schema(out)

    def run(batches):
        def gen():
            for vec_id, uid, v in rows_of(batches):
                u = unit(v)
                raw = None if u is None else u.tobytes()
                yield vec_id, uid, (0 if u is None else len(u)), (None if u is None else xxhash.xxh3_128_digest(raw)), raw

        yield from batched(gen(), schema)

    x = vectors.select(F.col(key).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("uid"), F.col(vector).alias("e"))
    return x.mapInArrow(run, out)


def fit_centroids(sample: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means, starting from evenly spread sample rows."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(steps):
        near = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return c


def prune(gram: np.ndarray, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning of many nodes at once: which candidates each keeps.

    ``near`` holds the cosines of m nodes to their c candidates, nearest first, ``gram`` the cosines of the candidates to
    one another (m, c, c). Distances are those of unit vectors.
    """
    d, between = (np.sqrt(np.maximum(0.0, 2 - 2 * x)) for x in (near, gram))
    alive, kept, count = np.ones(near.shape, dtype=bool), np.zeros(near.shape, dtype=bool), np.zeros(len(near), dtype=int)
    for j in range(near.shape[1]):
        take = alive[:, j] & (count < degree)
        kept[:, j] = take
        count += take
        alive &= ~(take[:, None] & (alpha * between[:, j] <= d))
    return kept


def build_graph(v: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the pruned edges between a block's rows, and of the reverse edges up to ``2 * degree`` a node."""
    n = len(v)
    c = min(candidates, n - 1)
    if c < 1:
        return np.zeros(0, int), np.zeros(0, int)
    a, b, cos = [], [], []
    for start in range(0, n, step):
        sims = v[start:start + step] @ v.T
        own = np.arange(len(sims))
        sims[own, start + own] = -2
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        value = np.take_along_axis(sims, near, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, axis=1), np.take_along_axis(value, order, axis=1)
        mine = v[near]
        keep = prune(mine @ mine.transpose(0, 2, 1), value, degree)
        row, col = np.nonzero(keep)
        a.append(start + row), b.append(near[row, col]), cos.append(value[row, col])
    a, b, cos = np.concatenate(a), np.concatenate(b), np.concatenate(cos)
    both, seen = np.unique(np.concatenate([a * n + b, b * n + a]), return_index=True)  # a node's own edges come first among equals
    reverse, cos = seen >= len(a), np.concatenate([cos, cos])[seen]
    a, b = both // n, both % n
    order = np.lexsort((-cos, reverse, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < 2 * degree], b[place < 2 * degree]


def range_search(q: np.ndarray, entry: tuple[np.ndarray, np.ndarray], v: np.ndarray, adj: np.ndarray, threshold: float,
                 beam: int = BEAM, slack: float = SLACK) -> np.ndarray:
    """(queries, rows) truth of being found at or above the threshold: greedy from the entries, then expanding inside the range.

    ``entry`` are (query, row) pairs; ``adj`` holds each row's neighbours, padded with ``len(v)``.
    """
    m, n = len(q), len(v)
    seen, done, score = np.zeros((m, n + 1), dtype=bool), np.zeros((m, n), dtype=bool), np.full((m, n), -2.0)
    seen[:, n] = True
    fresh = np.zeros((m, n + 1), dtype=bool)
    fresh[entry] = True
    while True:
        fresh &= ~seen
        seen |= fresh
        ask, row = np.nonzero(fresh[:, :n])
        for k in range(0, len(ask), PAIRS):
            i, j = ask[k:k + PAIRS], row[k:k + PAIRS]
            score[i, j] = np.einsum("ij,ij->i", q[i], v[j])
        go = score >= threshold - slack
        if n > beam:
            best = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            go[np.arange(m)[:, None], best] = True
        go &= seen[:, :n] & ~done
        ask, row = np.nonzero(go)
        if not len(ask):
            return score >= threshold
        done |= go
        fresh[:] = False
        for k in range(0, len(ask), PAIRS):
            fresh[ask[k:k + PAIRS, None], adj[row[k:k + PAIRS]]] = True


def _matrix(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if len(raw) else np.zeros((0, 1))


def _shards(reps: DataFrame, centroids: np.ndarray, overlap: int) -> DataFrame:
    """``reps`` with ``places array<int>``, the nearest centroids first."""
    held = reps.sparkSession.sparkContext.broadcast(centroids)
    out = "id long, w long, v binary, places array<int>"
    schema = arrow_schema(out)

    def run(batches):
        c = held.value
        for b in batches:
            if b.num_rows:
                sims = _matrix(b.column(2).to_pylist()) @ c.T
                top = np.argsort(-sims, axis=1, kind="stable")[:, :overlap].tolist()
                yield from batched(zip(*(x.to_pylist() for x in b.columns), top), schema)

    return materialize(reps.select("id", "w", "v").mapInArrow(run, out), "vec-places")


def _members(placed: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Members ``(c, s, main, id, w, v)`` of shard ``c`` and its cell ``s`` (-1: the shard is one), and visits ``(c, s, id)`` of queries.

    A row of a large shard belongs to its two nearest cells, for the graph, and is counted in the nearest (``main``). A query
    visits its ``PROBE`` nearest cells and all whose centre is nearly in its range: those of a dense group it lies in.
    """
    spread = placed.select("id", "w", "v", F.posexplode("places").alias("rank", "c"))
    sizes = materialize(spread.groupBy("c").agg(F.count("*").alias("n")), "vec-sizes")  # a row per centroid: MAX_CLUSTERS at most
    large, whole = sizes.filter(F.col("n") > block), sizes.filter(F.col("n") <= block)
    one = spread.join(F.broadcast(whole), "c").withColumn("s", F.lit(-1))
    member, visit = one.select("c", "s", F.lit(True).alias("main"), "id", "w", "v"), one.filter("rank = 0").select("c", "s", "id")
    if large.isEmpty():
        return member, visit
    rows = spread.join(F.broadcast(large), "c")

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = _matrix(pdf["v"].tolist())
        k = min(len(x), -(-4 * int(pdf["n"].iat[0]) // block))
        return pd.DataFrame({"c": [int(pdf["c"].iat[0])], "m": [fit_centroids(x, k).tobytes()], "n": [int(pdf["n"].iat[0])]})

    picked = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.col("n")) < CELL_SAMPLE).select("c", "n", "id", "v")
    fitted = materialize(picked.groupBy("c").applyInPandas(centres, "c int, m binary, n long"), "vec-cells")
    salts = F.ceil(F.col("n") / (4 * block)).cast("int")

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """(c, id, s, kind): 1 for the nearest cell, 0 for the second, 2 for a visit."""
        out = {"c": np.zeros(0, int), "id": np.zeros(0, int), "s": np.zeros(0, int), "kind": np.zeros(0, int)}
        if len(left) and len(right):
            x = _matrix(left["v"].tolist())
            m = np.frombuffer(right["m"].iat[0]).reshape(-1, x.shape[1])
            cos = x @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)).T
            top = np.argsort(-cos, axis=1, kind="stable")
            ids = left["id"].to_numpy()
            go = cos >= threshold - NEARLY
            go[np.arange(len(x))[:, None], top[:, :PROBE]] = True
            go &= (left["rank"].to_numpy() == 0)[:, None]
            ask, cell = np.nonzero(go)
            both = [(ids, top[:, 0], 1), *[(ids, top[:, k], 0) for k in range(1, min(2, len(m)))], (ids[ask], cell, 2)]
            out = {"id": np.concatenate([a for a, _, _ in both]), "s": np.concatenate([c for _, c, _ in both]),
                   "kind": np.concatenate([np.full(len(a), k) for a, _, k in both])}
            out["c"] = np.full(len(out["id"]), int(left["c"].iat[0]))
        return pd.DataFrame(out)

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).select("c", "salt", "rank", "id", "v")
    spots = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("c", "salt", "m")
    dealt = salted.groupBy("c", "salt").cogroup(spots.groupBy("c", "salt")).applyInPandas(lambda x, y: place(x, y), "c int, id long, s int, kind int")
    dealt = materialize(dealt, "vec-dealt")
    own = dealt.filter("kind < 2").join(placed.select("id", "w", "v"), "id").select("c", "s", (F.col("kind") == 1).alias("main"), "id", "w", "v")
    return member.unionByName(own), visit.unionByName(dealt.filter("kind = 2").select("c", "s", "id"))


def _graph(member: DataFrame) -> DataFrame:
    """``(id, n)``: each node's lists from all its shards and cells, united."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids = pdf["id"].to_numpy()
        a, b = build_graph(_matrix(pdf["v"].tolist()))
        ends = np.searchsorted(a, np.arange(len(ids) + 1))
        return pd.DataFrame({"id": ids, "n": [ids[b[ends[k]:ends[k + 1]]] for k in range(len(ids))]})

    lists = member.select("c", "s", "gb", "id", "v").groupBy("c", "s", "gb").applyInPandas(build, "id long, n array<long>")
    return materialize(lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("n"))).alias("n")), "vec-graph")


def _search(placed: DataFrame, threshold: float, block: int) -> DataFrame:
    """``(a, b, links)``: rows with b null give a query's number of links, rows with links null an edge of a forest."""
    member, visit = _members(placed, threshold, block)
    blocks = member.groupBy("c", "s").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("nb"))  # of a cell that is large all the same
    asks = visit.groupBy("c", "s").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("nq"))  # queries of a cell that many visit
    blocks = materialize(blocks.join(asks, ["c", "s"], "left").na.fill(1, ["nq"]), "vec-blocks")
    member = member.join(blocks, ["c", "s"]).withColumn("gb", F.pmod(F.xxhash64("id", "c", "s"), F.col("nb")).cast("int"))
    graph = _graph(member)
    nodes = member.filter("main").join(graph, "id").select("c", "s", "gb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), "id", "w", "v", "n")
    queries = placed.select("id", "v").join(graph, "id")
    ask = visit.join(blocks, ["c", "s"]).select("c", "s", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("gb"),
                                                F.pmod(F.xxhash64("id"), F.col("nq")).cast("int").alias("qb"), "id").join(queries, "id")
    ask = ask.select(*[F.col(x).alias(x) for x in ("c", "s", "gb", "qb", "id", "v", "n")])

    def search(asked: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        a, b, links = [], [], []
        if len(asked) and len(nodes):
            nodes, asked = nodes.sort_values("id", kind="stable"), asked.sort_values("id", kind="stable")
            ids, w, v = nodes["id"].to_numpy(), nodes["w"].to_numpy(), _matrix(nodes["v"].tolist())

            def local(lists) -> tuple[np.ndarray, np.ndarray]:
                """(list, row) of the members of lists that are in this block."""
                size = np.array([len(x) for x in lists])
                flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if size.sum() else np.zeros(0, np.int64)
                at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
                here = ids[at] == flat
                return np.repeat(np.arange(len(size)), size)[here], at[here]

            row, col = local(nodes["n"].tolist())
            place = np.arange(len(row)) - np.searchsorted(row, row)
            adj = np.full((len(ids), int(place.max()) + 1 if len(place) else 1), len(ids))
            adj[row, place] = col
            medoid = int(np.argmax(v @ v.mean(axis=0)))
            group = np.arange(len(ids))  # each row's group so far, named by its first row
            for start in range(0, len(asked), TOGETHER):
                part = asked.iloc[start:start + TOGETHER]
                mine = part["id"].to_numpy()
                k, x = local(part["n"].tolist())
                at = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
                own = np.where(ids[at] == mine, at, -1)
                with_own = np.flatnonzero(own >= 0)
                entry = (np.concatenate([np.arange(len(part)), with_own, k]), np.concatenate([np.full(len(part), medoid), own[with_own], x]))
                hits = range_search(_matrix(part["v"].tolist()), entry, v, adj, threshold)
                hits[with_own, own[with_own]] = False
                for i, o, hit in zip(mine.tolist(), own.tolist(), hits):
                    found = np.flatnonzero(hit)
                    a.append(i), b.append(None), links.append(int(w[found].sum()))
                    if len(found):
                        met = np.unique(group[found if o < 0 else np.append(found, o)])
                        if len(met) > 1:
                            group[np.isin(group, met)] = met[0]
                        if o < 0:
                            a.append(i), b.append(int(ids[found[0]])), links.append(None)
            for x in np.flatnonzero(group != np.arange(len(ids))):
                a.append(int(ids[x])), b.append(int(ids[group[x]])), links.append(None)
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "links": pd.array(links, "Int64")})

    return materialize(ask.groupBy("c", "s", "gb", "qb").cogroup(nodes.groupBy("c", "s", "gb", "qb"))
                       .applyInPandas(lambda x, y: search(x, y), "a long, b long, links long"), "vec-links")


def audit(reps: DataFrame, counts: DataFrame, threshold: float, n: int = AUDIT) -> float:
    """Recall of ``counts (id, links)`` on ``n`` queries (by hash), all rows being looked at.

    The lowest of the share of all true links and the mean share per query in
    each class of queries with about as many true links (powers of two, classes
    of less than ``CLASS`` queries together), so that a large group does not
    outweigh the losses of small ones.
    """
    asked = (reps.join(counts, "id", "left").orderBy(F.xxhash64("id"), "id").limit(n)
             .select("id", "v", F.coalesce("links", F.lit(0)).alias("links")).collect())
    if not asked:
        return 1.0
    q, own = _matrix([r["v"] for r in asked]), np.array([r["id"] for r in asked])
    held = reps.sparkSession.sparkContext.broadcast((q, own))

    def run(batches):
        qq, ids = held.value
        total = np.zeros(len(ids), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                hit = (qq @ _matrix(b.column(2).to_pylist()).T >= threshold) & (ids[:, None] != b.column(0).to_numpy()[None, :])
                total += hit @ b.column(1).to_numpy()
        yield from batched(((int(i), int(t)) for i, t in zip(ids, total)), schema)

    schema = arrow_schema("id long, n long")
    sums = reps.select("id", "w", "v").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    true = {r["id"]: r["n"] for r in sums.collect()}  # a row per query
    pairs = [(r["links"], true.get(r["id"]) or 0) for r in asked]
    pairs = [(got, of) for got, of in pairs if of]
    if not pairs:
        return 1.0
    classes, few = {}, []
    for got, of in pairs:
        classes.setdefault(of.bit_length(), []).append(got / of)
    for k in [k for k, x in classes.items() if len(x) < CLASS]:
        few += classes.pop(k)
    means = [sum(x) / len(x) for x in [*classes.values(), few] if x]
    return min([sum(got for got, _ in pairs) / sum(of for _, of in pairs), *means])


def near_vectors(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding",
                 overlap: int = OVERLAP, min_recall: float = MIN_RECALL, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, uid, n_links, component_id, kept)`` of every row."""
    base = materialize(normalised(vectors, key, vector), "vectors")
    valid = base.filter("dim > 0")
    every = materialize(valid.groupBy("dim", "k").agg(F.min("uid").alias("id"), F.count("*").alias("w"), F.first("v").alias("v")), "vec-reps")
    counts, edges = None, None
    for row in every.groupBy("dim").count().orderBy("dim").collect():  # lengths of vectors: one, in a sane table
        reps, n = every.filter(F.col("dim") == row["dim"]), row["count"]
        k = max(1, min(MAX_CLUSTERS, n // PER_CLUSTER))
        sample = _matrix([r["v"] for r in reps.orderBy(F.xxhash64("id"), "id").limit(min(MAX_SAMPLE, 50 * k)).select("v").collect()])
        centroids, wide = fit_centroids(sample, min(k, len(sample))), overlap
        for k in range(rounds):
            found = _search(_shards(reps, centroids, wide), threshold, block)
            c = materialize(found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links")), "vec-counts")
            recall = audit(reps, c, threshold)
            if recall >= min_recall:
                break
            wide *= 2
        else:
            raise LowRecall(f"recall {recall:.3f} after {rounds} rounds, {min_recall} was asked for")
        e = found.filter("b is not null").select("a", "b")
        counts, edges = (c, e) if counts is None else (counts.unionByName(c), edges.unionByName(e))
    if counts is None:
        x = base.withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col("vec_id"))
        return x.select("vec_id", "uid", "n_links", "component_id", F.lit(True).alias("kept"))
    comp = components(edges)
    named = every.select("dim", "k", "id", "w").join(comp, "id", "left").join(counts, "id", "left")
    named = named.select("dim", "k", F.coalesce("component", "id").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"))
    low = valid.groupBy("dim", "k").agg(F.min("vec_id").alias("m")).join(named, ["dim", "k"])
    best = low.groupBy("c").agg(F.min("m").alias("component_id"))
    x = base.select("vec_id", "uid", "dim", "k").join(low.join(best, "c").select("dim", "k", "n", "component_id"), ["dim", "k"], "left")
    cid = F.when(F.col("dim") == 0, F.col("vec_id")).otherwise(F.col("component_id"))
    return x.select("vec_id", "uid", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"),
                    F.col("vec_id").eqNullSafe(cid).alias("kept"))
