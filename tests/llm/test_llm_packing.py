import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from evalframe.llm import packing, registry
from llm_util import SF, table

ARGS = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def check(rows, texts, capacity):
    lib = Tokenizer.from_file(ARGS[0])
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in texts.items():
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.length <= capacity and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for v in seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(seq), sum(r.length for r in rows)


def test_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    rows = registry.queries()["op6_pack_sequences"](spark, SF).collect()
    n, total = check(rows, texts, 2048)
    assert n <= 1.02 * total / 2048 + 2


def test_edges_and_sequences(spark):
    texts = {0: None, 1: "", 2: "a", 3: "long words here " * 60, 4: "mid " * 9, 5: "mid " * 9}
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, uid int, length string")
    places, pieces = packing.pack_documents(docs, *ARGS, capacity=32, per_shard=4)
    check(places.collect(), texts, 32)
    seqs = {r.sequence_id: r for r in packing.sequences(places, pieces).collect()}
    for q, r in seqs.items():
        assert r.n_tokens == sum(p.length for p in places.filter(f"sequence_id = {q}").collect()) <= 32
    twice = docs.unionByName(docs)
    places, _ = packing.pack_documents(twice, *ARGS, capacity=32)
    assert places.count() == 2 * packing.pack_documents(docs, *ARGS, capacity=32)[0].count()
    assert packing.pack_documents(docs.limit(0), *ARGS)[0].count() == 0


def slow_rule(sizes, capacity):
    """The rule by its definition: try every place, take the smallest sum of squares (fullest place on a tie)."""
    gaps, seqs = [], []
    for s in sizes:
        best = None
        for g in sorted({x for x in gaps if x >= s} | {capacity}):
            after = [x for x in gaps]
            if g in gaps and g != capacity:
                after.remove(g)
            after.append(g - s)
            cost = sum(sum(1 for x in after if x == y) ** 2 for y in set(after) if y > 0)
            if best is None or cost < best[0]:
                best = (cost, g)
        g = best[1]
        if g != capacity:
            gaps.remove(g)
        gaps.append(g - s)
        gaps = [x for x in gaps if x > 0]
        seqs.append(capacity - g)
    return seqs


@pytest.mark.parametrize("seed", range(6))
def test_rule_equals_its_definition(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 20) for _ in range(80)]
    assert [o for _, o in packing.sum_of_squares(sizes, 20)] == slow_rule(sizes, 20)


def test_all_sizes_equal_and_whole():
    assert len({q for q, _ in packing.pack_sizes([10] * 20, 20)}) == 10
    assert [o for _, o in packing.pack_sizes([20] * 3, 20)] == [0, 0, 0]
    assert packing.pack_sizes([], 20) == []
