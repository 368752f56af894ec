"""Constraints that run inside the plan they guard (J4, J8, AG15; S10, S11).

The reference asserts that a lookup matches exactly one row and that a pivot has
no repeated cell, row by row as it goes. Here a broken constraint either raises
in the task that meets it, or becomes a status column and counts that are
observed while the result is written (``observed``); neither costs a job of its own, and
what is picked never depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

OK, MISSING, REPEATED = "ok", "missing", "repeated"


def status_of(n: Column) -> Column:
    """Status of a lookup that met ``n`` rows."""
    return F.when(n == 1, OK).when(n == 0, MISSING).otherwise(REPEATED)


def guarded(value: Column, broken: Column, message: Column, data_type: str) -> Column:
    """``value``; raises with ``message`` where ``broken`` is true."""
    return F.when(broken, F.raise_error(message).cast(data_type)).otherwise(value)


def the_only(cond: Column, value: Column, data_type: str, what: Column) -> Column:
    """Aggregate: the value of the one row of the group that fulfils ``cond`` (null without one); several rows raise.

    ``max`` instead of ``first``: a partial aggregate whose outcome depends on no order.
    """
    n = F.count(F.when(cond, 1))
    return guarded(F.max(F.when(cond, value)), n > 1, F.concat(what, F.lit(": "), n.cast("string"), F.lit(" rows for one cell")), data_type)


def lookup(labels: DataFrame, rows: DataFrame, keys: Sequence[str], on_broken: str = "raise") -> DataFrame:
    """The rows of ``labels``, each with its row of ``rows``; every label must be there, once.

    ``labels`` may name a key many times; ``rows`` are reduced to one per key
    first, with their number, so that the join fans nothing out. ``on_broken``: ``"raise"``, or
    ``"status"`` for a column ``status`` (ok, missing, repeated); a missing or repeated row's values are null.
    """
    values = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in values])
    j = labels.join(one, list(keys), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    if on_broken == "status":
        j = j.withColumn("status", status_of(F.col("_n")))
        return j.select(*labels.columns, *[F.when(F.col("_n") == 1, F.col(c)).alias(c) for c in values], "status")
    key = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    message = F.concat(F.lit("lookup of "), key, F.lit(": "), F.col("_n").cast("string"), F.lit(" rows"))
    types = dict(rows.dtypes)
    return j.select(*labels.columns, *[guarded(F.col(c), F.col("_n") != 1, message, types[c]).alias(c) for c in values])


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation with the number of rows that fulfil each condition, filled by the job that runs ``df``."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(k) for k, c in counts.items()]), o
