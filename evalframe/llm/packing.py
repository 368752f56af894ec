"""Sum-of-squares packing of documents into fixed-length sequences.

A document becomes its ids and a closing id. Longer ones are cut into pieces of
the sequence length, the first piece taking the rest. Whole-length pieces fill a
sequence each; the others are packed online by the sum-of-squares rule: with
N(g) open sequences of remaining gap g, a piece of size s goes where the sum of
N(g) squared becomes smallest (into a new sequence, or one of gap g >= s).
When all pieces of a shard are placed, the sequences left open (a few per
gap) are taken apart and packed again in falling order of size by the same
rule, and the better of both is kept.

Only (size, row identity) is shuffled, never tokens. Shards hold a bounded
number of pieces each (``per_shard``), dealt by a hash, so they all look like
the whole; the loss at a shard's end is a few sequences, whatever its size.

Defined results: a null text is empty (its closing id alone); repeated rows are
pieces of their own, told apart by ``uid``; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.streams import arrow_schema, batched, rows_of
from evalframe.llm.tokens import file_encoder
from evalframe.session import materialize

PIECES = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long, ids binary"
CAPACITY = 2048
PER_SHARD = 100_000


def tokenize(docs: DataFrame, path: str, ranks: str, pattern: str, key: str = "doc_id", text: str = "text",
             capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``PIECES``; ``ids`` are little-endian unsigned 32-bit numbers."""
    x = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = arrow_schema(PIECES)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = file_encoder(path, ranks, pattern)

        def gen():
            for doc_id, uid, t in rows_of(batches):
                ids = enc.encode(t) + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = n % capacity or capacity if at == 0 else capacity
                    part = ids[4 * at:4 * (at + size)]
                    yield doc_id, uid, k, at, size, zlib.crc32(part), part
                    at, k = at + size, k + 1

        yield from batched(gen(), schema, n=1000, size=lambda r: len(r[6]))

    return x.mapInArrow(run, PIECES)


def sum_of_squares(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece, in the order given, numbering sequences from 0."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, new = [], 0
    for s in sizes:
        # cost of gap g: 2 * (N(g - s) - N(g)) + 2, without N(0); a new sequence: 2 * N(capacity - s) + 1
        cost = counts[: capacity + 1 - s] - counts[s:]
        cost[0] = -counts[s]  # it fills up: only 1 - 2 N(s)
        cost = 2 * cost + 2
        cost[0] -= 1
        cost[counts[s:] == 0] = np.iinfo(np.int64).max
        cost[-1] = 2 * counts[capacity - s] + 1 if s < capacity else 0
        k = int(np.argmin(cost))
        gap = k + s
        if gap == capacity and not open_by_gap[capacity]:
            seq, offset, new = new, 0, new + 1
        else:
            seq = open_by_gap[gap].pop()
            counts[gap] -= 1
            offset = capacity - gap
        if k:
            counts[k] += 1
            open_by_gap[k].append(seq)
        placed.append((seq, offset))
    return placed


def falling(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Best fit over pieces in falling order of size: each goes to the smallest gap that holds it."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = np.zeros(capacity + 1, dtype=bool)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    new = 0
    for i in order:
        s = sizes[i]
        k = int(np.argmax(has[s:]))
        if has[s + k]:
            gap = s + k
            seq = open_by_gap[gap].pop()
            has[gap] = bool(open_by_gap[gap])
        else:
            gap, seq, new = capacity, new, new + 1
        out[i] = (seq, capacity - gap)
        if gap > s:
            open_by_gap[gap - s].append(seq)
            has[gap - s] = True
    return out


def pack_sizes(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Sum-of-squares placement; the sequences it leaves open are packed again where that saves some."""
    placed = sum_of_squares(sizes, capacity)
    fill: dict[int, int] = {}
    for (seq, _), s in zip(placed, sizes):
        fill[seq] = fill.get(seq, 0) + s
    loose = [i for i, (seq, _) in enumerate(placed) if fill[seq] < capacity]
    n_open = sum(v < capacity for v in fill.values())
    again = falling([sizes[i] for i in loose], capacity)
    if not again or max(q for q, _ in again) + 1 >= n_open:
        return placed
    base = len(fill)
    for i, (q, offset) in zip(loose, again):
        placed[i] = (base + q, offset)
    return placed


def pack(pieces: DataFrame, n_pieces: int, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """Places of narrow piece rows ``(doc_id, uid, piece, start, length, ids_crc32)``, adding ``sequence_id, offset``.

    Sequence ids are (shard * 2^32 + number in the shard). A shard's pieces are
    ordered by a hash first, so the same rows give the same packing.
    """
    shards = max(1, -(-n_pieces // per_shard))
    x = pieces.select("doc_id", "uid", "piece", "start", "length", "ids_crc32",
                      F.pmod(F.xxhash64("uid", "piece"), F.lit(shards)).alias("shard"))
    out = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(pdf):
        pdf = pdf.assign(_o=(pdf["uid"] * 2654435761 + pdf["piece"] * 40503) % 4294967291).sort_values(["_o", "uid", "piece"], kind="stable")
        placed = pack_sizes(pdf["length"].tolist(), capacity)
        base = int(pdf["shard"].iloc[0]) << 32
        pdf = pdf.assign(sequence_id=[base + q for q, _ in placed], offset=[o for _, o in placed])
        return pdf.drop(columns=["_o", "shard"])

    return x.groupBy("shard").applyInPandas(run, out)


def pack_documents(docs: DataFrame, path: str, ranks: str, pattern: str, capacity: int = CAPACITY,
                   per_shard: int = PER_SHARD, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(places, pieces): where each piece lies, and the pieces with their ids (a table in the shared folder)."""
    pieces = materialize(tokenize(docs, path, ranks, pattern, key=key, capacity=capacity), "pieces")
    n = pieces.count()
    return pack(pieces, n, capacity, per_shard), pieces


def sequences(places: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids binary, n_tokens)``: the packed sequences themselves; a group is one sequence."""
    x = places.select("uid", "piece", "sequence_id", "offset").join(pieces.select("uid", "piece", "ids"), ["uid", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return x.groupBy("sequence_id").agg(whole.alias("ids")).withColumn("n_tokens", F.octet_length("ids") / 4)
