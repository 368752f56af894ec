"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text: its words and word pairs, and the same of the words'
shapes (letters by case, digits, signs; a word equal to the one before is a
shape of its own), in pairs and triples. Each is hashed to one of ``2**BITS``
slots; a slot's value is log(1 + count), divided by the vector's length.

Training: a bounded sample (``sampling.training_sample``) goes to ``SHARDS``
tasks; each runs FTRL-proximal over its documents, in hash order, ``EPOCHS``
times, both classes weighing the same. One task takes the whole sample, whose
size is a parameter; with more, the weights are averaged by slot, over the shards whose documents hold it. What
reaches the driver is the weights, at most ``2**BITS`` numbers whatever the
data. Scoring is a sparse dot product per document in the scan, without a shuffle.

Defined results: null and empty texts have no features and get the bias' score;
a sample that lacks a class gives the score 0.5 everywhere if it is empty, else
the class' frequency as learned; repeated rows get equal scores; extra columns
are ignored. Labels, language, source and ids are no features.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm.kernels import slices
from evalframe.llm.sampling import PER_CLASS, training_sample, windows, word_hashes
from evalframe.llm.streams import arrow_schema, batched, rows_of
from evalframe.llm.tokens import _held

BITS = 18
SHARDS = 1
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-4

_RUNS = re.compile(r"([A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ]))|([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)|([^\W\d_]+)|(\d+)")


def shape(word: str) -> bytes:
    """Runs of letters as A (capitals), B (capitalised) or a, runs of digits as 9, other signs as they are."""
    return _RUNS.sub(lambda m: "A" if m[1] else "B" if m[2] else "a" if m[3] else "9", word).encode()


class _Shapes(dict):
    def __missing__(self, word: str) -> bytes:
        if len(self) > 100_000:
            self.clear()
        s = shape(word)
        if len(word) <= 64:
            self[word] = s
        return s


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of a text; slot ids ascend."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = word_hashes([w.encode() for w in text.lower().split()])
    shapes = list(map(_held("shapes", _Shapes).__getitem__, words))
    s = word_hashes(shapes) ^ np.uint64(0x5851F42D4C957F2D)
    if len(h) == len(s):
        same = np.flatnonzero(h[1:] == h[:-1]) + 1
        s[same] = np.uint64(0x2545F4914F6CDD1D)
    parts = [windows(h, 1), windows(h, 2), windows(s, 1), windows(s, 2), windows(s, 3)]
    slots, counts = np.unique(np.concatenate(parts) >> np.uint64(64 - BITS), return_counts=True)
    return slots.astype(np.int64), counts


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text; slot ids ascend."""
    slots, counts = counted(text)
    x = np.log1p(counts)
    return slots, x / np.sqrt(np.dot(x, x)) if len(x) else x


class Examples:
    """Training examples as ``train`` takes them, with five or six bytes per feature instead of sixteen; values are worked out as they are read.

    Slots and counts lie in growing buffers, one for each width of counts.
    """

    def __init__(self):
        self.slots, self.counts, self.held = array("i"), {k: array(k) for k in "BHIQ"}, []

    def add(self, text: str, label: int) -> None:
        slots, counts = counted(text)
        kind = np.min_scalar_type(counts.max() if len(counts) else 0).char
        kind = kind if kind in self.counts else "Q"
        self.held.append((len(self.slots), len(self.counts[kind]), len(slots), kind, label))
        self.slots.frombytes(slots.astype("i").tobytes())
        self.counts[kind].frombytes(counts.astype(kind).tobytes())

    def __len__(self) -> int:
        return len(self.held)

    def labels(self) -> list[int]:
        return [y for *_, y in self.held]

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        slots, counts = np.frombuffer(self.slots, "i"), {k: np.frombuffer(c, k) for k, c in self.counts.items() if len(c)}
        for at, of, n, kind, y in self.held:
            x = np.log1p(counts[kind][of: of + n].astype(np.int64)) if n else np.zeros(0)
            yield slots[at: at + n].astype(np.int64), x / np.sqrt(np.dot(x, x)) if n else x, y


def train(examples: list[tuple[np.ndarray, np.ndarray, int]] | Examples, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights, the bias last. Both classes weigh the same, however many examples each has."""
    labels = examples.labels() if isinstance(examples, Examples) else [y for _, _, y in examples]
    of = np.bincount(labels, minlength=2)
    share = np.where(of > 0, len(examples) / np.maximum(2.0 * of, 1), 0) if (of > 0).all() else np.ones(2)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS])
    for _ in range(epochs):
        for slots, values, y in examples:
            i = np.concatenate([slots, bias])
            x = np.append(values, 1.0)
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = share[y] * (1.0 / (1.0 + np.exp(-np.clip(np.dot(w, x), -35, 35))) - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] = zi + g - sigma * w
            n[i] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(sample: DataFrame, shards: int = SHARDS) -> np.ndarray:
    """Weights of a sample ``(doc_id, label, text, sketch)``: per slot the mean over the shards that have seen it."""
    out = "slot int, w double"
    schema = arrow_schema(out)

    def run(batches):
        examples = Examples()
        for b in batches:
            for part in slices(b, "text"):
                for _, y, t in rows_of([part]):
                    examples.add(t, y)
        if len(examples):
            w = train(examples)
            seen = np.zeros((1 << BITS) + 1, dtype=bool)
            seen[np.frombuffer(examples.slots, "i")] = True
            seen[-1] = True
            yield from batched(((int(i), float(w[i])) for i in np.flatnonzero(seen)), schema, n=50_000)

    dealt = (sample.select(F.xxhash64("sketch").alias("o"), "label", "text").repartition(shards, "o")
             .sortWithinPartitions("o", "label"))
    got = dealt.mapInArrow(run, out).groupBy("slot").agg(F.avg("w").alias("w")).toPandas()
    weights = np.zeros((1 << BITS) + 1, dtype=np.float32)
    weights[got["slot"].to_numpy(dtype=np.int64)] = got["w"].to_numpy()
    return weights


def score(text: Column, weights: np.ndarray, spark: SparkSession) -> Column:
    """The score of a text column, whole texts; other columns of the row stay in the JVM."""
    held = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        w = held.value
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            slots, x = features(t or "")
            out[k] = 1.0 / (1.0 + np.exp(-np.clip(np.dot(w[slots], x) + w[-1], -35, 35)))
        return pd.Series(out)

    return of(text)


def crc_remainder(key: str, mod: int):
    """crc32 of the id written as text, modulo ``mod``; the fold rule of the held-out rows."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def held_out(key: str = "doc_id") -> Column:
    return crc_remainder(key, 5) == 0


def learn(corpus: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id") -> np.ndarray:
    """Weights from the labelled rows of ``corpus`` outside the held-out fold."""
    return fit(training_sample(corpus, labels, "quality", ~held_out("doc_id"), per_class, key))


def with_quality(docs: DataFrame, weights: np.ndarray, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score."""
    return docs.withColumn(column, score(F.coalesce(F.col(text), F.lit("")), weights, docs.sparkSession))
