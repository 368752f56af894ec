"""Words of text columns by Arrow kernels, shared by the operators that work on word indices.

``slices`` cuts Arrow batches into pieces of bounded bytes (a single longer text
is a piece of its own), ``words`` turns a piece's texts into indices of distinct
words, ``segments`` and ``segment_sums`` reduce numbers word by word to numbers
per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``most_bytes`` of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most_bytes:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def words(texts: pa.Array, separators: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each word, its place in the dictionary, distinct words) of the texts, A-Z lower-cased, null as empty.

    ``separators`` is a pattern of what stands between words. The arrays are
    large (64-bit offsets), so a text may be of any length.
    """
    lower = pc.fill_null(pc.ascii_lower(texts), "").cast(pa.large_string())  # in this order: the kernel misreads a cast slice
    lists = pc.split_pattern_regex(lower, separators)
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    found = pc.dictionary_encode(flat.filter(some))
    return row.filter(some).to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def segments(rows: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal row numbers."""
    return np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)


def segment_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row, rows ascending; rows without a value get 0."""
    out = np.zeros((n, *values.shape[1:]), dtype=values.dtype)
    starts = segments(rows)
    if len(starts):
        out[rows[starts]] = np.add.reduceat(values, starts, axis=0)
    return out
