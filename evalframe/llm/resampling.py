"""Resampling of documents towards a target distribution by hashed n-gram importance.

Words come from Arrow kernels (``kernels.words``): lower case, split, flatten,
dictionary encode. N-grams are built from dictionary indices shifted by one:
an index and its successor make a pair number, the distinct pairs are dictionary
encoded again, and a pair's place with the next index makes a triple. A CRC is
taken per distinct pair or triple only, from the CRCs of its parts (a CRC is
linear, so that of ``a b`` is that of ``a`` moved on by the length of `` b``,
xor that of `` b``); ``take`` spreads the result over all n-grams.

Pass one counts buckets, at most ``buckets`` numbers per task, for the documents
and for the target. A bucket's gain is the scaled log ratio of its smoothed
shares. Pass two takes the gains and sums them per document by segments. A
Gumbel term from a hash of the key makes the top scores a draw without
replacement; ranks come from range partitions with offsets.

Defined results: null, empty and wordless texts have no features and weight 0;
empty tables give no rows, an empty target only smoothed shares; a null key
counts as empty text in the hash and sorts first; equal rows get equal scores and ranks of their own;
extra columns are ignored by ``importance`` and kept by ``draw``.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.kernels import segment_sums, slices, words
from evalframe.llm.linking import as_stored
from evalframe.llm.streams import arrow_schema, batched
from evalframe.llm.tokens import _held
from evalframe.operators.ranking import positions
from evalframe.session import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST = 3
#: Words whose n-grams are built at once; a longer text is gone through in steps of this size.
STEP = 1 << 19
POLYNOMIAL = 0xEDB88320


def _apply(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit numbers, given by the images of the bits."""
    out = np.zeros_like(v)
    for k in range(32):
        out ^= np.where(v >> np.uint32(k) & np.uint32(1), matrix[k], np.uint32(0))
    return out


class Shifts(dict):
    """n -> tables (4, 256) by which a CRC moves on over n bytes."""

    def __init__(self):
        super().__init__()
        bit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        step = bit.copy()
        for _ in range(8):
            step = step >> np.uint32(1) ^ np.where(step & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
        self.bit, self.byte = bit, step

    def __missing__(self, n: int) -> np.ndarray:
        if len(self) > 2000:
            self.clear()
        out, square, left = self.bit.copy(), self.byte.copy(), n
        while left:
            if left & 1:
                out = _apply(square, out)
            square, left = _apply(square, square), left >> 1
        values = np.arange(256, dtype=np.uint32)
        self[n] = np.stack([_apply(out, values << np.uint32(8 * k)) for k in range(4)])
        return self[n]


def crc_joined(before: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of joined byte strings from the CRCs of both parts and the second's length."""
    sizes, which = np.unique(length, return_inverse=True)
    held = _held("crc shifts", Shifts)
    tables = np.concatenate([held[int(n)].ravel() for n in sizes]) if len(sizes) else np.zeros(0, np.uint32)
    at = which.astype(np.int64) * 1024
    out = after.copy()
    for k in range(4):
        out ^= tables[at + (256 * k) + (before >> np.uint32(8 * k) & np.uint32(255)).astype(np.int64)]
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the distinct keys, distinct keys)."""
    d = pc.dictionary_encode(pa.array(keys))
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_numpy(zero_copy_only=False)


def ngrams(row: np.ndarray, index: np.ndarray, dictionary: pa.Array, n: int = LONGEST):
    """For lengths 1 to ``n``, step by step: (row of each n-gram, place among the distinct ones, their CRCs)."""
    raw = dictionary.cast(pa.large_binary()).to_pylist()
    crc = np.fromiter((zlib.crc32(w) for w in raw), np.uint32, len(raw))
    spaced = np.fromiter((zlib.crc32(w, zlib.crc32(b" ")) for w in raw), np.uint32, len(raw))
    length = np.fromiter((len(w) + 1 for w in raw), np.int64, len(raw))
    for start in range(0, len(index), STEP):
        end = min(start + STEP, len(index))
        place, known = index[start:end + n - 1], crc
        r = row[start:end + n - 1]
        yield r[:end - start], place[:end - start], known
        for k in range(1, n):  # an (k+1)-gram: a k-gram and the word after it, in the same row
            m = min(end - start, len(r) - k)
            if m <= 0:
                break
            ahead = len(r) - k  # those that start behind the step are needed to build longer ones
            same = np.flatnonzero(r[:ahead] == r[k:])
            found, keys = _distinct(place[same] * len(raw) + index[start + k:][same])
            last = keys % len(raw)
            known = crc_joined(known[keys // len(raw)], spaced[last], length[last])
            place = np.full(ahead, -1, np.int64)
            place[same] = found
            inside = same[same < m]
            yield r[inside], place[inside], known


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """N-grams per bucket over all texts: counted per task, summed by an aggregate; ``buckets`` numbers reach the driver."""
    out = "bucket int, n long"
    schema = arrow_schema(out)

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for _, place, crc in ngrams(*words(part.column("text"), SEPARATORS)):
                    counts += np.bincount((crc % np.uint32(buckets))[place], minlength=buckets)
        yield from batched(((int(k), int(counts[k])) for k in np.flatnonzero(counts)), schema, n=buckets)

    rows = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, out).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Per bucket: floor(scale * ln of the target's smoothed share over the corpus')."""
    big_s, big_t, b = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(scale * math.log((float(t) + 1.0) * (big_s + b) / ((float(s) + 1.0) * (big_t + b))))
                     for s, t in zip(corpus, target)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, keys: list[str], text: str = "text") -> DataFrame:
    """``(*keys, n_words, n_features, weight)`` of every text."""
    x = docs.select(*keys, F.col(text).cast("string").alias("_text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema if f.name != "_text") + ", n_words long, n_features long, weight long"
    schema, buckets = arrow_schema(out), np.uint32(len(gain))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                n = part.num_rows
                row, index, dictionary = words(part.column("_text"), SEPARATORS)
                n_features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for r, place, crc in ngrams(row, index, dictionary):
                    n_features += np.bincount(r, minlength=n)
                    weight += segment_sums(gain[crc % buckets][place], r, n)
                counts = [np.bincount(row, minlength=n), n_features, weight]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *(pa.array(c, pa.int64()) for c in counts)], schema=schema)

    return x.mapInArrow(run, out)


def gumbel(key: Column, seed: int = 42, scale: int = 1000) -> Column:
    """Scaled Gumbel noise from the first 32 bits of a hash of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5,
               least_words: int = 20, buckets: int = BUCKETS, seed: int = 42, stored: bool = False) -> DataFrame:
    """``(uid, key, n_words, n_features, weight, score, rank)`` of every row; rank is null for rows not drawn.

    Drawn are the ``percent`` highest scores of the rows with ``least_words``
    words, rounded down, ties by key. ``uid`` is the row's number at the scan;
    ``stored`` tells that ``docs`` is a file table, otherwise a copy is written.
    """
    docs = as_stored(docs, stored)
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    x = weights(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.col(text).alias("text")), gain, ["uid", "key"])
    x = materialize(x.withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)).withColumn("open", F.col("n_words") >= least_words), "weights")
    ranked = positions(x, ["open"], [F.desc("score"), "key", "n_features", "weight", "uid"])
    drawn = F.col("open") & (F.col("pos") < F.floor(F.col("group_n") * percent / 100))
    return ranked.select("uid", F.col("key").alias(key), "n_words", "n_features", "weight", "score",
                         F.when(drawn, F.col("pos") + 1).cast("long").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", stored: bool = False, **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns."""
    docs = as_stored(docs, stored)
    picked = importance(docs, target, key, stored=True, **options).filter(F.col("rank").isNotNull()).select("uid")
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("uid"))
    return row.join(picked, "uid", "left_semi").select("_row.*")
