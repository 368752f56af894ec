"""Text column functions (F7, F8, F9 helpers, F11).

Whitespace follows Python ``str.split()`` (S16): Unicode whitespace, leading
and trailing ignored, blank text has zero words. Java's ``\\s`` is ASCII
unless the ``(?U)`` flag is set, so every pattern here carries it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\S+"
SPACE = r"(?U)\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    """Whitespace tokens of a text (array<string>); null text gives an empty array.

    ``split`` on runs of Unicode whitespace, minus the empty edge strings that
    leading/trailing whitespace leaves (faster than extracting ``\\S+`` matches).
    """
    parts = F.array_remove(F.split(_c(text), SPACE), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def word_count(text, pandas_compat: bool = False) -> Column:
    """number of whitespace-separated words, counted in one pass over the text.

    ``pandas_compat`` counts a null cell as the single word "nan" like ``astype(str)`` does (S17).
    """
    n = F.regexp_count(_c(text), F.lit(WORD)).cast("bigint")
    return F.coalesce(n, F.lit(1 if pandas_compat else 0).cast("bigint"))


def initials(name) -> Column:
    """F8: "A-B" -> "A.B."; null stays null; a name without a hyphen gives null (the source raises)."""
    parts = F.split(_c(name), "-")
    first, second = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return F.when(second.isNotNull(), F.concat(first, F.lit("."), second, F.lit(".")))
