"""Ordered streaming over groups: bounded memory whatever a group's size.

``fold_groups`` deals rows out by key, sorts inside each partition and feeds
them to a fold one row at a time, so a group never has to fit in memory: the
state is the fold's own (for example a running SHA-256). Sorting spills.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

_OUT_ROWS = 2000


def arrow_schema(ddl: str | StructType) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl) if isinstance(ddl, str) else ddl)


def batched(rows: Iterator[tuple], schema: pa.Schema, n: int = _OUT_ROWS, most_bytes: int = 8 << 20,
            size: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``n`` rows (and about ``most_bytes`` where ``size`` is given)."""
    buf, held = [], 0
    for r in rows:
        buf.append(r)
        if size is not None:
            held += size(r)
        if len(buf) >= n or held >= most_bytes:
            yield _batch(buf, schema)
            buf, held = [], 0
    if buf:
        yield _batch(buf, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def fold_groups(df: DataFrame, key: str, order: list, out: str, start: Callable[[], object],
                step: Callable[[object, tuple], None], finish: Callable[[object, tuple], tuple]) -> DataFrame:
    """One output row per value of ``key`` (the first column of ``df``).

    ``start()`` makes a state, ``step(state, row)`` adds a row in order,
    ``finish(state, key)`` gives the output tuple. Null is a key like others.
    """
    schema = arrow_schema(out)

    def run(batches):
        def gen():
            state, current, open_ = None, None, False
            for row in rows_of(batches):
                if not open_ or row[0] != current:
                    if open_:
                        yield finish(state, current)
                    state, current, open_ = start(), row[0], True
                step(state, row)
            if open_:
                yield finish(state, current)

        yield from batched(gen(), schema)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)
