"""Null-faithful predicates (trap S2) and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.dims import COMPLETELY_WRONG, GOOD_TRANSLATION, HUMAN_MARKER, TYPICAL


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ne_pandas(col, value) -> Column:
    """pandas ``!=``: a null cell is *not equal* to anything (True), never null."""
    return ~_c(col).eqNullSafe(value if isinstance(value, Column) else F.lit(value))


def eq_pandas(col, value) -> Column:
    """pandas ``==``: a null cell compares False, never null."""
    return F.coalesce(_c(col) == (value if isinstance(value, Column) else F.lit(value)), F.lit(False))


def is_human(approach="approach") -> Column:
    """Human translation rows: the approach text contains ``Human``."""
    return F.coalesce(_c(approach).contains(HUMAN_MARKER), F.lit(False))


def both_typical(a1="approp_1", a2="approp_2") -> Column:
    return eq_pandas(a1, TYPICAL) & eq_pandas(a2, TYPICAL)


def any_atypical(a1="approp_1", a2="approp_2") -> Column:
    return ne_pandas(a1, TYPICAL) | ne_pandas(a2, TYPICAL)


def neither_wrong(q1="quality_1", q2="quality_2") -> Column:
    return ne_pandas(q1, COMPLETELY_WRONG) & ne_pandas(q2, COMPLETELY_WRONG)


def either_not_wrong(q1="quality_1", q2="quality_2") -> Column:
    return ne_pandas(q1, COMPLETELY_WRONG) | ne_pandas(q2, COMPLETELY_WRONG)


def both_good(q1="quality_1", q2="quality_2") -> Column:
    return eq_pandas(q1, GOOD_TRANSLATION) & eq_pandas(q2, GOOD_TRANSLATION)
