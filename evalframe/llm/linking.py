"""Linking rows that share a bucket, and connected components, without pairs of whole groups.

``link`` is given posts (bucket, id) and a test of pairs. Two ids are linked if
they share a bucket and pass the test; wanted are the connected components.

1. Hub rounds, while the buckets hold more than ``FEW`` pairs per post: in each
   bucket only the hub is paired with the members, so a bucket of n members
   costs n pairs. The first hub is the member of the highest rank, later ones
   the member most similar to a hub before, which leads to the middle of a group
   (its original, where there is one). After each round the components are
   updated; a bucket whose members are all in one component is done.
2. The rest, exactly: in buckets that still hold several components, every
   pair of members of different components is tested. The caller can give a bound
   that linked pairs fulfil, and a test that runs inside the join, so that only
   links leave it. Pairs inside a component are never formed.

So the components are those of the full graph: a pair that was never tested has
both ends in one component already. Nothing is collected; all steps are joins
and aggregates over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.session import materialize

#: Ids of this number (8 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
BROADCAST_BYTES = 40 << 20
#: Pairs per post up to which all pairs of different components are formed at once.
FEW = 4


def of_side(side: str, column: str) -> Column:
    """The column of one side of a pair: ``x_column`` of side ``x``, that of the table with the alias ``x`` of side ``x.``."""
    return F.col(f"{side}{column}" if side.endswith(".") else f"{side}_{column}")


def joined(df: DataFrame, other: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``df`` joined with ``other`` by a merge, unless both have at most ``rows`` rows and these are few.

    Left to itself Spark sends a side to the driver and the tasks by the size of
    the files below it: compressed, an array counted as one element, and the
    same before and after an explode; and a plan that begins so is kept when the
    sizes are known.
    """
    return df.join(other if rows is not None and rows <= BROADCAST_IDS else other.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of all ids in ``edges (a, b)`` but the smallest of each component, which is its name.

    Alternating large-star and small-star steps; each result is a table, so
    lineage stays short. A node with many neighbours is a partial minimum per
    task and a skewed join that can be split.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    rows = 2 * e.count()  # no step has more
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both.filter("v > u"), low, "u", rows=rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, least, "u", rows=rows).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        n = e.agg(F.count("*").alias("n"), F.count_distinct("u").alias("u")).first()
        if n["n"] == n["u"] and joined(e, e.select(F.col("v").alias("u")).distinct(), "u", "left_semi", rows).isEmpty():  # stars only
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def shared(posts: DataFrame) -> DataFrame:
    """Posts of the buckets that hold more than one post."""
    n = posts.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select("bucket")
    return joined(posts, n, "bucket", rows=posts.count())


def link(posts: DataFrame | Sequence[DataFrame], test: Callable[[DataFrame], DataFrame], near: Callable[[str, str], Column] | None = None,
         payload: tuple[str, ...] = (), bound: Callable[[DataFrame], DataFrame] | None = None,
         possible: Callable[[str, str], Column] | None = None,
         inside: tuple[Callable[[DataFrame], DataFrame], Callable[[str, str], Column]] | None = None,
         ranks: DataFrame | None = None, rounds: int = 1) -> DataFrame:
    """``(id, component)`` as ``components`` gives it.

    ``posts``: ``(bucket, id, rank, *payload)``; with ``near``, ranks come from
    ``ranks (id, rank)`` instead and are added once posts are few, and ``posts`` may be
    several tables that share no bucket. ``test`` maps pairs ``(a, b)``,
    a < b, to the linked ones with their similarity, ``(a, b, score long)``. ``near(x, y)`` is a cheap condition on the payload
    columns ``of_side`` ``x`` and ``y``, applied as pairs are formed. For the
    rest, ``bound`` gives columns for its ids ``(id)``, and ``possible(x, y)`` is
    a condition on them that every linked pair fulfils; ``inside`` gives columns
    for those that may have a partner, and the exact test on them as a condition.
    """
    cols = ["id", *payload]
    ok = near if near is not None else lambda x, y: F.lit(True)
    if near is None:
        posts = shared(materialize(posts.select("bucket", "id", "rank", *payload), "posts"))
    else:  # only posts with a near one in their bucket; a semi-join stops at the first and emits no pairs
        kinds = [p.select("bucket", *cols) for p in (posts if isinstance(posts, (list, tuple)) else [posts])]  # apart: a semi-join is pushed below a union, with the whole right side each time

        def met_of(posts: DataFrame) -> DataFrame:
            # the columns keep their names: with others on one side, the posts are shuffled twice instead of one shuffle read twice
            cond = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") != F.col("y.id")) & near("x.", "y.")
            return joined(posts.alias("x"), posts.alias("y"), cond, "left_semi").select("bucket", *cols)

        met = materialize(reduce(DataFrame.unionByName, [met_of(p) for p in kinds]), "posts")
        posts = joined(met, ranks, "id").select("bucket", "id", "rank", *payload)
    posts = materialize(posts, "posts")
    n_posts = posts.count()
    tried, found, last, used, comp = None, None, None, None, None

    def labelled() -> DataFrame:
        """Posts with the component ``c`` of their id as known so far."""
        if comp is None:
            return posts.withColumn("c", F.col("id"))
        return materialize(joined(posts, comp, "id", "left", n_posts).withColumn("c", F.coalesce("component", "id")).drop("component"), "posts")

    def open_buckets(p: DataFrame) -> DataFrame:
        """Buckets with several components: pairs across them, and the hub."""
        if found is None:
            order = [F.lit(0).alias("w"), "rank", (-F.col("id")).alias("first")]
        else:
            linked = last.select(F.col("a").alias("id"), "score").unionByName(last.select(F.col("b").alias("id"), "score"))
            was = used.withColumn("score", F.lit(None).cast("long")).withColumn("u", F.lit(1))
            worth = (linked.withColumn("u", F.lit(0)).unionByName(was).groupBy("id").agg(F.max("score").alias("w"), F.max("u").alias("u"))
                     .select("id", F.when(F.col("u") == 1, -1).otherwise(F.col("w")).alias("w")))
            p = joined(p, worth, "id", "left", n_posts)
            order = [F.coalesce("w", F.lit(0)).alias("w"), "rank", (-F.col("id")).alias("first")]
        parts = p.groupBy("bucket", "c").agg(F.count("*").alias("n"), F.max(F.struct(*order, *cols, "c")).alias("h"))
        b = parts.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.max("h").alias("h"))
        return materialize(b.filter("k > 1").select("bucket", ((F.col("n") * F.col("n") - F.col("nn")) / 2).alias("across"),
                                                    *[F.col(f"h.{c}").alias(f"y_{c}") for c in [*cols, "c"]]), "buckets")

    def tested(pairs: DataFrame) -> None:
        """Tests the pairs that are new and updates the components."""
        nonlocal tried, found, last, comp
        pairs = pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
        if tried is not None:
            pairs = joined(pairs, tried, ["a", "b"], "left_anti", n_posts)  # the pairs of a hub round
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            return
        tried = pairs if tried is None else tried.unionByName(pairs)
        last = materialize(test(pairs), "links")
        found = last if found is None else found.unionByName(last)
        comp = components(found)

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("bucket", *[F.col(c).alias(f"{p}_{c}") for c in [*cols, "c"]])

    for r in range(rounds + 1):
        p = labelled()
        b = open_buckets(p)
        left = b.agg(F.sum("across")).first()[0] or 0
        if left <= FEW * n_posts or r == rounds:
            break
        tested(joined(side(p, "x"), b.drop("across"), "bucket", rows=n_posts).filter((F.col("x_c") != F.col("y_c")) & ok("x", "y")))
        hubs = b.select(F.col("y_id").alias("id")).distinct()
        used = hubs if used is None else used.unionByName(hubs)
    if left:
        rest = materialize(joined(p, b.select("bucket"), "bucket", rows=n_posts).select("bucket", *cols, "c"), "rest")
        also = lambda x, y: F.lit(True)
        if bound is not None:
            extra = bound(rest.select("id").distinct())
            cols += [c for c in extra.columns if c != "id"]
            rest, also = materialize(joined(rest, extra, "id", rows=n_posts), "rest"), possible
        pair = lambda x, y: ok(x, y) & also(x, y)
        if inside is None:
            tested(joined(side(rest, "x"), side(rest, "y"), "bucket", rows=n_posts).filter((F.col("x_c") < F.col("y_c")) & pair("x", "y")))
        else:
            extra, linked = inside
            x, y = side(rest, "x").alias("x"), side(rest, "y").alias("y")
            met = joined(x, y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x_c") != F.col("y_c")) & pair("x", "y"), "left_semi", n_posts)
            met = materialize(met.select("bucket", *[F.col(f"x_{c}").alias(c) for c in [*cols, "c"]]), "met")
            more = extra(met.select("id").distinct())
            cols += [c for c in more.columns if c != "id"]
            met = materialize(joined(met, more, "id"), "met")
            x, y = side(met, "x").alias("x"), side(met, "y").alias("y")
            cond = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x_c") < F.col("y_c")) & pair("x", "y") & linked("x", "y")
            new = materialize(joined(x, y, cond).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.lit(1).cast("long").alias("score")), "links")
            comp = components(new if found is None else found.unionByName(new))
    return comp if comp is not None else posts.limit(0).select("id", F.col("id").alias("component"))


def as_stored(df: DataFrame, stored: bool) -> DataFrame:
    """``df`` if it is a stored table, else a stored copy.

    Rows are told apart by their number at the scan, which is the same each time
    a file table is read, but not for the outcome of a shuffle or a sample.
    """
    return df if stored else materialize(df, "input")


def rows_of_ids(df: DataFrame, ids: DataFrame, key: str, size: Column | None = None) -> DataFrame:
    """``df`` joined with ``ids`` (which has ``key``): sent to the scan if there are few, by a shuffle otherwise.

    Few are at most ``BROADCAST_IDS`` rows of ``BROADCAST_BYTES`` together; ``size`` tells a row's bytes, 16 by default.
    """
    ids = materialize(ids, "ids")
    n = ids.agg(F.count("*").alias("n"), F.sum(F.lit(16) if size is None else size).alias("b")).first()
    few = n["n"] <= BROADCAST_IDS and (n["b"] or 0) <= BROADCAST_BYTES
    return df.join(F.broadcast(ids) if few else ids, key)


def rows_without(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """``df`` without the rows whose number at the scan is in ``dropped (uid)``; columns as they are."""
    gone = materialize(dropped, "dropped")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    row = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.monotonically_increasing_id().alias("uid"))
    return row.join(F.broadcast(gone) if few else gone, "uid", "left_anti").select("_row.*")
