"""Bounded training samples of labelled documents, and the word splitting both classifiers use.

``training_sample`` takes at most ``per_class`` documents of each label (those
with the smallest hash of their id; fewer if there are fewer), reads their
texts in one scan with the ids broadcast (their number is bounded by the
parameter), and keeps one of each group of copies, so that copies do not count
as evidence many times. Copies are recognised by the smallest hash of their
three-word windows. The sample is a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.streams import arrow_schema, batched, rows_of
from evalframe.llm.tokens import _held
from evalframe.session import materialize

PER_CLASS = 10_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """word bytes -> 64-bit hash, remembered per worker process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    get = _held("word hashes", WordHashes).__getitem__
    return np.fromiter(map(get, words), dtype=np.uint64, count=len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-word windows of a sequence of word hashes."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out ^= out >> np.uint64(31)
        out *= _M1
        out += h[k: len(h) - n + 1 + k] * _M2
    out ^= out >> np.uint64(29)
    out *= _M1
    return out ^ (out >> np.uint64(32))


def sketch(text: str) -> int:
    """Smallest hash of the text's three-word windows (of the whole text, if shorter), as a signed number."""
    words = text.lower().split()
    w = windows(word_hashes([x.encode() for x in words]), 3)
    h = int(w.min()) if len(w) else xxhash.xxh3_64_intdigest(" ".join(words).encode())
    return h - (1 << 64) if h >= 1 << 63 else h


def training_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int = PER_CLASS,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, label int, text, sketch)``; ``keep`` is a condition on the key. Null labels and keys are left out."""
    y = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    y = y.filter(keep & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pick = y.filter("label = 1").orderBy(*order).limit(per_class).unionByName(y.filter("label = 0").orderBy(*order).limit(per_class))
    x = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    x = x.join(F.broadcast(pick), "doc_id").select("doc_id", "label", "text")
    out = "doc_id long, label int, text string, sketch long"
    schema = arrow_schema(out)

    def run(batches):
        rows = ((*r, sketch(r[2])) for r in rows_of(batches))
        yield from batched(rows, schema, n=500, size=lambda r: len(r[2]))

    return materialize(x.mapInArrow(run, out).dropDuplicates(["sketch", "label"]), "sample")
