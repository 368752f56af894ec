"""Byte-level BPE encoding and decoding in overlapping chunks.

Long texts are cut into chunks of ``chunk`` characters that overlap by
``overlap``; every chunk is pre-tokenised on its own, in parallel. A match of
the pattern never looks behind, so once two neighbouring chunks agree on a
match start inside their overlap they agree on everything after it: the first
such place is where the text is cut. The resulting pieces are encoded in
parallel; their ids, in order of the pieces, are the text's ids. If an overlap
holds no common start (a run longer than the overlap), the two chunks are
joined into one piece, so the result is exact for any text.

Output of ``encode``: one row per piece, ``(doc_id, piece, n_pieces, ids binary)``
with ids as little-endian unsigned 32-bit numbers. ``decode`` gives each
piece's bytes; a text's bytes are the pieces' bytes in order (a character may
begin in one token and end in the next, so bytes are joined, not strings).

Defined results: a null or empty text is one piece without ids; repeated rows
(same doc_id) are kept apart by ``uid``; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalframe.llm.linking import as_stored
from evalframe.llm.streams import arrow_schema, batched, rows_of
from evalframe.llm.tokens import _held, rank_encoder

#: A match can depend on this many characters behind its end (contractions: an apostrophe and two letters).
LOOKAHEAD = 3
CHUNK, OVERLAP = 32_768, 512

PIECES = "doc_id long, uid long, piece long, n_pieces long, ids binary"
DECODED = PIECES + ", raw binary"


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))


def match_starts(text: str, pattern: str, lo: int, hi: int) -> list[int]:
    """Starts in [lo, hi) of the pattern's matches over ``text`` that are safe places to cut.

    Safe: the character before is no white space, so the piece before ends in a
    match that the text behind it cannot change.
    """
    import regex

    found = []
    for m in _held(("regex", pattern), lambda: regex.compile(pattern)).finditer(text):
        s = m.start()
        if s >= hi:
            break
        if s >= lo and s > 0 and not text[s - 1].isspace():
            found.append(s)
    return found


def chunk_bounds(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``(uid, k, head, tail)`` per chunk: cut places (in the text) inside the overlaps with the chunk before and behind."""
    step = chunk - overlap
    n = F.ceil((F.length("text") - overlap) / step)
    out = "uid long, k int, head array<int>, tail array<int>"
    schema = arrow_schema(out)
    pieces = docs.select("uid", F.length("text").alias("n"), F.posexplode(
        F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.substring(F.col("text"), k * step + 1, F.lit(chunk)))).alias("k", "part"))

    def run(batches):
        def gen():
            for uid, n_chars, k, part in rows_of(batches):
                at, last = k * step, k * step + len(part) >= n_chars
                sure = len(part) if last else len(part) - LOOKAHEAD
                starts = match_starts(part, pattern, 0, sure)
                head = [at + s for s in starts if s < overlap] if k else []
                tail = [at + s for s in starts if s >= step] if not last else []
                yield uid, k, head, tail

        yield from batched(gen(), schema)

    return pieces.repartition("uid", "k").mapInArrow(run, out)


def cuts(bounds: DataFrame) -> DataFrame:
    """``(uid, cuts array<int>)``: for each text the places where neighbouring chunks resynchronise, in order."""
    w = Window.partitionBy("uid").orderBy("k")
    meet = F.array_min(F.array_intersect("tail", F.lead("head").over(w)))
    return (bounds.select("uid", meet.alias("cut")).groupBy("uid")
            .agg(F.array_sort(F.collect_list("cut")).alias("cuts")))


@dataclass(frozen=True)
class Step:
    """Work on encoded rows in the same pass: ``fn`` maps an iterator of row tuples, ``schema`` is what it gives."""

    schema: str
    fn: Callable[[Iterator[tuple]], Iterator[tuple]]


def _encode(pieces: DataFrame, path: str, pattern: str, steps: tuple[Step, ...]) -> DataFrame:
    """One Python pass over the pieces: encode, then the steps."""
    out = steps[-1].schema if steps else PIECES
    schema = arrow_schema(out)

    def encoded(rows):
        enc = rank_encoder(path, pattern)
        for doc_id, uid, piece, n_pieces, text in rows:
            yield doc_id, uid, piece, n_pieces, enc.encode(text)

    def run(batches):
        rows = encoded(rows_of(batches))
        for s in steps:
            rows = s.fn(rows)
        yield from batched(rows, schema, n=500, size=lambda r: sum(len(x) for x in r if isinstance(x, bytes)))

    return pieces.mapInArrow(run, out)


def decoding(path: str, pattern: str) -> Step:
    """Adds ``raw``, the bytes that the ids stand for, joined."""

    def fn(rows):
        table = rank_encoder(path, pattern).bytes_of
        for r in rows:
            yield *r, b"".join(map(table.__getitem__, np.frombuffer(r[4], "<u4").tolist()))

    return Step(DECODED, fn)


def encode_short(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK,
                 steps: tuple[Step, ...] = ()) -> DataFrame:
    """Texts of at most one chunk: encoded where they are scanned, no shuffle."""
    x = _source(docs, key, text).filter(F.length("text") <= chunk)
    return _encode(x.select("doc_id", "uid", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("n_pieces"), "text"),
                   path, pattern, steps)


def encode_long(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK,
                overlap: int = OVERLAP, steps: tuple[Step, ...] = (), stored: bool = False) -> DataFrame:
    """Texts of more than one chunk: chunked, pre-tokenised, stitched; the pieces are dealt out and encoded.

    ``stored`` says that ``docs`` is a table read from files, which need not be
    copied to be read twice.
    """
    docs = as_stored(docs if stored else docs.select(key, text).filter(F.length(text) > chunk), stored)
    x = _source(docs, key, text).filter(F.length("text") > chunk)
    at = x.join(cuts(chunk_bounds(x, pattern, chunk, overlap)), "uid")
    ends = F.concat("cuts", F.array(F.length("text")))
    starts = F.concat(F.array(F.lit(0)), "cuts")
    parts = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.substring(F.col("text"), z["s"] + 1, z["e"] - z["s"]))
    p = at.select("doc_id", "uid", F.size("cuts").cast("long").alias("_n"), F.posexplode(parts).alias("piece", "text"))
    p = p.select("doc_id", "uid", F.col("piece").cast("long").alias("piece"), (F.col("_n") + 1).alias("n_pieces"), "text")
    return _encode(p.repartition("uid", "piece"), path, pattern, steps)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK,
           overlap: int = OVERLAP, steps: tuple[Step, ...] = (), stored: bool = False) -> DataFrame:
    """All texts: ``(doc_id, uid, piece, n_pieces, ids)``, or what the last of the steps gives."""
    return (encode_short(docs, path, pattern, key, text, chunk, steps)
            .unionByName(encode_long(docs, path, pattern, key, text, chunk, overlap, steps, stored)))


def decode(pieces: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, uid, piece, n_pieces, ids, raw binary)`` of stored pieces."""
    schema, step = arrow_schema(DECODED), decoding(path, pattern)

    def run(batches):
        yield from batched(step.fn(rows_of(batches)), schema, n=500, size=lambda r: len(r[4]) + len(r[5]))

    return pieces.select("doc_id", "uid", "piece", "n_pieces", "ids").mapInArrow(run, DECODED)


def decimal(ids: bytes) -> bytes:
    """Decimal ids joined by commas."""
    return ",".join(map(str, np.frombuffer(ids, "<u4").tolist())).encode()
