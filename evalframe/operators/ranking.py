"""Skew-safe exact ranking within groups (W1, W3, SP2, SP4–SP6, exact percentiles).

``row_number().over(Window.partitionBy(g).orderBy(o))`` sends every row of a
group to ONE task. When a group holds a third of a 100 TB table (a language,
a benchmark) that task never finishes. ``positions`` computes the same
0-based position with bounded tasks:

1. ``repartitionByRange`` on (group, order, tie-break) — a hot group is
   split across many range partitions by its order columns;
2. inside each partition rows are sorted, so ``monotonically_increasing_id``
   (partition index << 33 | row index) is the local rank;
3. a tiny aggregate gives, per (partition, group), the first local id and
   the row count; a running sum over partitions (per group) gives each
   partition's offset inside the group;
4. join back: position = local id − first local id + offset.

Steps 3 and 4 both read the numbered rows, so those rows are written once
as a table in the cluster's shared ``spark.checkpoint.dir``: range bounds
come from sampling a shuffle whose row order is not deterministic, and two
recomputations could otherwise disagree on which partition a row belongs
to. Partition id and local id are stored as columns, so the table can be
re-read with any split layout; the write also cuts the lineage, so a lost
executor re-reads the numbered rows instead of re-sampling.

The only data-sized shuffle is the range exchange; the offsets table has at
most (#partitions + #groups) rows and AQE broadcasts it when small. The
order must be total (pass a unique tie-break column) so the result is
deterministic and identical when a lost task is recomputed.

For small ``k`` top-k (``row_number() <= k``) plain windows are better:
Spark plans a partial ``WindowGroupLimit`` before the shuffle, so a hot
group ships at most k rows per map task. ``top_k`` wraps that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.session import materialize

_PID, _MID, _FIRST, _CNT, _BEFORE = "_rk_pid", "_rk_mid", "_rk_first", "_rk_cnt", "_rk_before"


def _as_cols(cols: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _bytes(text: str) -> int:
    """Parse a Spark byte-size setting ("64MB", "134217728b", "1g")."""
    t = text.strip().lower().rstrip("b")
    for unit, mult in (("k", 1 << 10), ("m", 1 << 20), ("g", 1 << 30), ("t", 1 << 40)):
        if t.endswith(unit):
            return int(float(t[:-1]) * mult)
    return int(t)


def _range_partitions(df: DataFrame) -> int:
    """Range-exchange width: at least the shuffle setting, and enough for the estimated input size.

    An explicit-count exchange is neither coalesced nor split by AQE, so its
    width must follow the data: the size of the plan's inputs (leaf scans —
    file sizes, unlike operator estimates that multiply through joins and
    explodes) divided by the advisory partition size. Planning only: asking
    the RDD for its partition count would make AQE run upstream stages.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = 0
        for i in range(leaves.size()):  # input volume: file sizes of the scans (operator estimates can explode)
            raw = leaves.apply(i).stats().sizeInBytes()
            size += raw if isinstance(raw, int) else int(raw.toString())  # py4j may already convert BigInt
        target = _bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m"))
        n = int(min(max(n, -(-size // target)), 1 << 20))  # JVM int parameter; ~1M ranges is plenty
    except Exception:  # no JVM handle (Spark Connect) or unparsable setting: keep the shuffle setting
        pass
    return n


def numbered(df: DataFrame, keys: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """All rows in order of ``keys``, as a stored table: ``part`` numbers the ranges in order, ``at`` ascends along all of them."""
    ranged = df.repartitionByRange(num_partitions or _range_partitions(df), *_as_cols(keys)).sortWithinPartitions(*_as_cols(keys))
    return materialize(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "numbered")


def positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, pos_col: str = "pos",
              size_col: str = "group_n", num_partitions: int | None = None) -> DataFrame:
    """Append 0-based position within group (by ``order_cols``) and the group size."""
    spark = df.sparkSession
    n = num_partitions or _range_partitions(df)
    group_cols = list(group_cols)
    keys = [*_as_cols(group_cols), *_as_cols(order_cols)]
    ranged = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                         .withColumn(_PID, F.spark_partition_id())
                         .withColumn(_MID, F.monotonically_increasing_id()), "ranked")
    counts = ranged.groupBy(_PID, *group_cols).agg(F.min(_MID).alias(_FIRST), F.count(F.lit(1)).alias(_CNT))
    by_group = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy()
    offsets = counts.select(
        _PID, *group_cols, _FIRST,
        F.coalesce(F.sum(_CNT).over(by_group.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias(_BEFORE),
        F.sum(_CNT).over(by_group).alias(size_col))
    r, o = ranged.alias("_r"), offsets.alias("_o")
    cond = [F.col(f"_r.{_PID}") == F.col(f"_o.{_PID}")] + \
        [F.col(f"_r.{c}").eqNullSafe(F.col(f"_o.{c}")) for c in group_cols]
    joined = r.join(o, cond, "inner")
    out_cols = [F.col(f"_r.`{c}`").alias(c) for c in df.columns]
    return joined.select(*out_cols, (F.col(f"_r.{_MID}") - F.col(f"_o.{_FIRST}") + F.col(f"_o.{_BEFORE}")).alias(pos_col),
                         F.col(f"_o.{size_col}").alias(size_col))


def cuts(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], take: Column, fan: dict[str, Column] | None = None) -> DataFrame:
    """``(*group_cols, *fan, _cut)``: the order key of each group's ``take``-th row, ``take`` being an expression of ``group_n``.

    Only group and order columns are ranked and written. ``fan`` adds columns (an ``explode``, say) that ``take`` may use.
    Rows of the table: groups times fan, to be joined by ``up_to``.
    """
    ranked = positions(df.select(*group_cols, *order_cols), group_cols, order_cols)
    for name, value in (fan or {}).items():
        ranked = ranked.withColumn(name, value)
    return ranked.filter(F.col("pos") == take - 1).select(*group_cols, *(fan or {}), F.struct(*order_cols).alias("_cut"))


def with_cuts(df: DataFrame, cut: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Every row beside the cuts of its group; null is a group like others."""
    named = cut.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)], *[c for c in cut.columns if c not in group_cols])
    same = F.lit(True)
    for i, c in enumerate(group_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return df.join(named, same).drop(*[f"_g{i}" for i in range(len(group_cols))])


def ntile_from_position(pos: Column, n: Column, k: int) -> Column:
    """SQL ``ntile(k)`` (1-based) from a 0-based position and group size: the first n % k tiles get one extra."""
    q = F.floor(n / k).cast("bigint")
    r = n - q * k
    big = r * (q + 1)
    return F.when(pos < big, F.floor(pos / (q + 1)) + 1).otherwise(r + F.floor((pos - big) / q) + 1).cast("bigint")


def top_k(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, k: int, rank_col: str = "rank") -> DataFrame:
    """First k rows per group; planned with a partial WindowGroupLimit (skew-safe for small k)."""
    w = Window.partitionBy(*group_cols).orderBy(*_as_cols(order_cols))
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value: str, probs: Sequence[float],
                    tie: str | None = None) -> DataFrame:
    """Linear-interpolated exact quantiles per group (numpy/DuckDB ``quantile_cont``) without
    holding a group in one task: rank values with ``positions`` and read the two order
    statistics around ``p * (n - 1)``."""
    order = [F.col(value)] + ([F.col(tie)] if tie else [])
    ranked = positions(df.filter(F.col(value).isNotNull()), group_cols, order)
    rows, needed = [], F.lit(False)
    for i, p in enumerate(probs):
        h = (F.col("group_n") - 1) * F.lit(float(p))
        lo = F.floor(h)
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), h.alias("h"), lo.alias("lo")))
        needed = needed | (F.col("pos") == lo) | (F.col("pos") == lo + 1)
    # keep only the (at most 2 per probability) order statistics, then fan out per probability
    exploded = ranked.filter(needed).withColumn("_q", F.explode(F.array(*rows)))
    picked = exploded.filter((F.col("pos") == F.col("_q.lo")) | (F.col("pos") == F.col("_q.lo") + 1))
    agg = picked.groupBy(*group_cols, F.col("_q.i").alias("qi"), F.col("_q.p").alias("p")).agg(
        F.max(F.when(F.col("pos") == F.col("_q.lo"), F.col(value))).alias("v_lo"),
        F.max(F.when(F.col("pos") == F.col("_q.lo") + 1, F.col(value))).alias("v_hi"),
        F.first(F.col("_q.h") - F.col("_q.lo")).alias("frac"),
        F.first("group_n").alias("n"))
    return agg.select(*group_cols, "qi", "p", "n",
                      F.when(F.col("v_hi").isNull(), F.col("v_lo"))
                      .otherwise(F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("q"))
