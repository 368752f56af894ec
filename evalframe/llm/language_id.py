"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased and split at everything but letters and marks; subwords
are the byte n-grams (``SIZES``) of its words with their borders, each hashed to
one of ``2**BITS`` rows of an embedding table. A text's vector is the mean over
its subwords, its logits a linear map of that.

Training is stochastic gradient descent in numpy over a bounded sample: of each
of at most ``max_langs`` languages (the most frequent ones) at most ``per_lang``
texts, one per group of copies, each as a whole and as a short window of words.
An embedding row moves with the square root of its share in the text, so that long texts teach too. A fifth of the sample is kept apart to fit the temperature, by which logits
become calibrated probabilities, and the rejection limit: the share
``1 - coverage`` of rightly classified texts lies below it.

Scoring multiplies table and map once (one logit per subword and language), adds
them up per distinct word of a batch and per text by segments; no shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0;
so is every text if nothing could be learned. ``rejected`` marks texts whose
probability is below the limit; ``with_language(reject=True)`` calls them ``und`` too. Of
equal logits the first language by name counts; equal texts get equal results;
extra columns are kept, but for those named like a result, which it replaces. Language, source and id are no inputs of a prediction.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe.llm.kernels import segment_sums, segments, slices
from evalframe.llm.quality_clf import crc_remainder
from evalframe.llm.sampling import sketch
from evalframe.llm.streams import arrow_schema, batched, rows_of
from evalframe.session import materialize

SEPARATORS = r"[^\p{L}\p{M}]+"
LETTER = r"\p{L}"
BITS, DIM = 16, 16
SIZES = (2, 3, 4, 5)
EPOCHS, RATE = 5, 1.0
PER_LANG, MAX_LANGS = 500, 400
UNKNOWN = "und"
#: Parts in which a language's ids are cut down to ``per_lang`` each, before they meet.
SALTS = 16
#: Words whose logits are added up at once.
STEP = 1 << 16


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each word, its place in the dictionary, distinct lower-cased words)."""
    lower = pc.fill_null(pc.utf8_lower(texts), "").cast(pa.large_string())
    lists = pc.split_pattern_regex(lower, SEPARATORS)
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    found = pc.dictionary_encode(flat.filter(some))
    return row.filter(some).to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def subwords(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word of each subword, its slot) of the distinct words, words ascending: byte n-grams of ``<word>``."""
    closed = pc.binary_join_element_wise(pa.scalar("<", pa.large_string()), dictionary, pa.scalar(">", pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset:closed.offset + len(closed) + 1]
    raw = np.frombuffer(closed.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64) if len(closed) else np.zeros(0, np.uint64)
    length = np.diff(offsets)
    word = np.repeat(np.arange(len(closed)), length)
    left = np.repeat(offsets[1:] - offsets[0], length) - np.arange(len(raw))  # bytes from here to the word's end
    of, slot = [], []
    for n in SIZES:
        h = np.full(max(len(raw) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = (h ^ raw[k:k + len(h)]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        h = h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
        inside = np.flatnonzero(left[:len(h)] >= n)
        of.append(word[inside])
        slot.append(h[inside].astype(np.int64))
    of, slot = np.concatenate(of), np.concatenate(slot)
    order = np.argsort(of, kind="stable")
    return of[order], slot[order]


@dataclass
class Model:
    """Languages, logits per (slot, language), bias, temperature and rejection limit."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0


def logits(model_table: np.ndarray, bias: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(logits, number of subwords) of each text."""
    n = len(texts)
    row, index, dictionary = words(texts)
    total, size = np.zeros((n, model_table.shape[1])), np.zeros(n, np.int64)
    for a in range(0, len(index), STEP):
        distinct, which = np.unique(index[a:a + STEP], return_inverse=True)
        of, slot = subwords(dictionary.take(pa.array(distinct)))
        per_word = np.zeros((len(distinct), model_table.shape[1]))
        for b in range(0, len(of), STEP):
            starts = segments(of[b:b + STEP])
            per_word[of[b:b + STEP][starts]] += np.add.reduceat(model_table[slot[b:b + STEP]], starts, axis=0)
        total += segment_sums(per_word[which], row[a:a + STEP], n)
        size += segment_sums(np.bincount(of, minlength=len(distinct))[which], row[a:a + STEP], n)
    return total / np.maximum(size, 1)[:, None] + bias, size


def example(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct slots, their shares) of one text."""
    _, index, dictionary = words(pa.array([text], pa.large_string()))
    of, slot = subwords(dictionary)
    times = np.bincount(index, minlength=len(dictionary))
    slots, which = np.unique(slot, return_inverse=True)
    share = np.bincount(which, weights=times[of], minlength=len(slots))
    return slots, share / max(share.sum(), 1.0)


def window(text: str, most: int = 12) -> str:
    """A short run of a text's words, chosen by a hash of the text."""
    w = text.split()
    h = zlib.crc32(text.encode())
    n = 1 + h % most
    start = (h >> 8) % max(len(w) - n + 1, 1)
    return " ".join(w[start:start + n])


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int = EPOCHS, rate: float = RATE, seed: int = 42):
    """(embeddings, map, bias) by stochastic gradient descent with a falling rate, over the examples in a fixed random order."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (1 << BITS, DIM)) / DIM
    out, bias = np.zeros((DIM, n_langs)), np.zeros(n_langs)
    steps, done = max(epochs * len(examples), 1), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            slots, share, y = examples[k]
            step = rate * (1 - done / steps)
            done += 1
            if not len(slots):
                continue
            rows = table[slots]
            hidden = share @ rows
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1.0
            back = out @ g
            out -= step * np.outer(hidden, g)
            bias -= 0.1 * step * g
            table[slots] = rows - (step * np.sqrt(share))[:, None] * back
    return table, out, bias


def calibrate(z: np.ndarray, y: np.ndarray, coverage: float = 0.99) -> tuple[float, float]:
    """(temperature of the least log loss, limit below which ``1 - coverage`` of the right answers lie)."""
    if not len(y):
        return 1.0, 0.0

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean()
    t = min(np.geomspace(0.05, 20, 121), key=loss)
    p = probabilities(t)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    return float(t), float(np.quantile(right, 1 - coverage)) if len(right) else 0.0


def sample(docs: DataFrame, keep: Column, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS, key: str = "doc_id",
           text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, text, sketch)``: at most ``per_lang`` texts of each language, those with the smallest hash of their id.

    ``keep`` is a condition on ``doc_id``. The chosen ids, at most
    ``per_lang * max_langs``, are sent to the scan that reads their texts.
    """
    y = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).isNotNull().alias("has"))
    y = y.filter(keep & F.col("lang").isNotNull() & F.col("has")).select("doc_id", "lang")
    langs = y.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).select("lang")
    pick = y.join(F.broadcast(langs), "lang").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    for part in (["lang", "salt"], ["lang"]):  # a frequent language is first cut down in parts
        order = Window.partitionBy(*part).orderBy(F.xxhash64("doc_id"), "doc_id")
        pick = pick.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_lang).drop("k")
    pick = pick.select(F.col("doc_id").alias("pick_id"), F.col("lang").alias("pick_lang")).distinct()
    x = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    x = x.filter(F.col("text").isNotNull()).join(F.broadcast(pick), (F.col("doc_id") == F.col("pick_id")) & (F.col("lang") == F.col("pick_lang")), "left_semi")
    out = "lang string, text string, sketch long"
    schema = arrow_schema(out)

    def run(batches):
        yield from batched(((y, t, sketch(t)) for y, t in rows_of(batches)), schema, n=500, size=lambda r: len(r[1]))

    return materialize(x.select("lang", "text").mapInArrow(run, out).dropDuplicates(["lang", "sketch"]), "sample")


def fit(texts: DataFrame, coverage: float = 0.99) -> Model:
    """A model of a sample ``(lang, text, sketch)``, trained in one task, which holds the sample's slots, not its texts."""
    out = "part int, langs array<string>, data binary"
    schema = arrow_schema(out)

    def run(batches):
        examples, apart = {}, {}
        for lang, text, h in rows_of(batches):
            if not pc.match_substring_regex(pa.array([text]), LETTER)[0].as_py():
                continue
            into = apart if h % 5 == 0 else examples
            into.setdefault(lang, []).extend([example(text), example(window(text))])
        langs = sorted(examples)
        if not langs:
            return
        table, linear, bias = train([(*x, k) for k, y in enumerate(langs) for x in examples[y]], len(langs))
        held = [(*x, k) for k, y in enumerate(langs) for x in apart.get(y, []) if len(x[0])]
        z = np.array([share @ table[slots] @ linear + bias for slots, share, _ in held]).reshape(-1, len(langs))
        t, limit = calibrate(z, np.array([y for *_, y in held], dtype=np.int64), coverage)
        flat = (table @ linear).astype(np.float32)
        yield from batched(iter([(-1, langs, np.array([t, limit, *bias]).tobytes())]), schema)
        rows = (1 << 20) // (4 * len(langs)) + 1
        yield from batched(((a // rows, [], flat[a:a + rows].tobytes()) for a in range(0, len(flat), rows)), schema, n=4)

    got = texts.select("lang", "text", "sketch").repartition(1).sortWithinPartitions("sketch", "lang").mapInArrow(run, out).collect()  # the model's bytes
    if not got:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    got = sorted(got, key=lambda r: r["part"])
    head = np.frombuffer(got[0]["data"])
    table = np.frombuffer(b"".join(r["data"] for r in got[1:]), np.float32).reshape(1 << BITS, -1)
    return Model(list(got[0]["langs"]), table, head[2:].copy(), float(head[0]), float(head[1]))


def predict(text: Column, model: Model, spark: SparkSession) -> Column:
    """``struct(lang, score, rejected)`` of a text column; other columns of the row stay in the JVM."""
    held = spark.sparkContext.broadcast((model.langs, model.table, model.bias, model.temperature, model.limit))  # plain values only

    @F.pandas_udf("lang string, score double, rejected boolean")
    def of(texts: pd.Series) -> pd.DataFrame:
        langs, table, bias, temperature, limit = held.value
        lang, score = [], []
        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(texts, type=pa.large_string())], names=["text"])
        for part in slices(batch, "text"):
            t = pc.fill_null(part.column("text"), "")
            has = pc.match_substring_regex(t, LETTER).to_numpy(zero_copy_only=False)
            if not langs:
                lang += [UNKNOWN] * len(t)
                score += [0.0] * len(t)
                continue
            z, _ = logits(table, bias, t)
            e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
            p, best = 1.0 / e.sum(axis=1), z.argmax(axis=1)
            lang += [langs[k] if h else UNKNOWN for k, h in zip(best, has)]
            score += list(np.where(has, p, 0.0))
        score = np.array(score, dtype=float)
        return pd.DataFrame({"lang": lang, "score": score, "rejected": score < limit})

    return of(text)


def held_out(key: str = "doc_id") -> Column:
    return crc_remainder(key, 4) == 2


def learn(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS, key: str = "doc_id") -> Model:
    """A model from the rows of ``docs`` with a language, outside the held-out fold."""
    return fit(sample(docs, ~held_out("doc_id"), per_lang, max_langs, key))


def with_language(docs: DataFrame, model: Model, text: str = "text", column: str = "lang_pred", score: str = "score",
                  rejected: str = "rejected", reject: bool = False) -> DataFrame:
    """All columns of ``docs``, the predicted language, its probability, and whether that is below the limit."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), predict(F.col(f"`{text}`").cast("string"), model, docs.sparkSession).alias("_p"))
    lang = F.when(F.col("_p.rejected"), UNKNOWN).otherwise(F.col("_p.lang")) if reject else F.col("_p.lang")
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in (column, score, rejected)]
    return row.select(*kept, lang.alias(column), F.col("_p.score").alias(score), F.col("_p.rejected").alias(rejected))
