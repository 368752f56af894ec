"""Exact numeric helpers.

Reports round accuracies to 0.1 percentage points *before* averaging (trap
S1). Rounding a double is engine dependent on ties (S30), so the library
rounds exact rationals with integer arithmetic instead: a value is carried
as an integer number of tenths of a percent and rounded half-up, which
gives the same answer in Spark, DuckDB and by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pct_tenths(num, den) -> Column:
    """round(100 * num / den, 1) * 10 as an exact integer (half-up); null if den = 0."""
    num, den = _c(num), _c(den)
    return F.when(den > 0, F.floor((num * 2000 + den) / (den * 2)).cast("bigint"))


def mean_tenths(sum_tenths, n) -> Column:
    """round(mean of n values given in tenths, 1) * 10, exact half-up."""
    s, n = _c(sum_tenths), _c(n)
    return F.when(n > 0, F.floor((s * 2 + n) / (n * 2)).cast("bigint"))


def tenths_to_pct(t) -> Column:
    return _c(t) / F.lit(10.0)


def r6(x) -> Column:
    """Round to 6 decimals and normalise -0.0 (trap S25)."""
    return F.round(_c(x), 6) + F.lit(0.0)


def safe_ratio(num, den) -> Column:
    """num / den, null when den is 0 (trap S7; ANSI mode would raise)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def finalize(df: DataFrame) -> DataFrame:
    """Normalise result types: integral -> bigint, fractional -> double (6 dp).

    Keeps result schemas identical across engines (Spark's ``count`` is
    bigint, ``row_number``/``size`` int; DuckDB gives BIGINT for all).
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = r6(c.cast("double"))
        cols.append(c.alias(f.name))
    return df.select(*cols)
