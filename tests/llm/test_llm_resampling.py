import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evalframe.llm import registry, resampling as r
from evalframe.llm.kernels import segment_sums, slices, words
from llm_util import SF, same


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return w, [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, least=20, percent=5, buckets=10_000):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(of, features(x)[1]))
    for x in target:
        t.update(map(of, features(x)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for d, x in docs:
        w, f = features(x)
        weight = sum(gain[of(g)] for g in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    open_ = sorted((x for x in rows if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(open_[:percent * len(open_) // 100])}
    return sorted((repr((*x, rank.get(id(x)))) for x in rows))


DOCS = [(1, None), (2, ""), (3, "  \n"), (4, "A"), (5, "Ä b\x00C über 漢字 İstanbul"), (6, "one two THREE one two three " * 30), (6, "one two THREE one two three " * 30),
        (None, "null key " * 20), (7, "x" * 70_000 + " y " + "word " * 4000), *[(k, f"text {k % 7} with some {k} words and a tail of plain words that goes on until it has enough of them "
                                                                           f"for number {k * k}") for k in range(100, 160)]]
TARGET = [None, "", "plain words that goes on", "one two three"]


def got(spark, docs, target, **options):
    d = spark.createDataFrame([(*x, 9, "x") for x in docs], "doc_id long, text string, weight long, uid string")  # names as the operator's own
    t = spark.createDataFrame([(x,) for x in target], "text string")
    x = r.importance(d, t, **options).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    return sorted(repr(tuple(v)) for v in x.collect())


@pytest.mark.parametrize("step", [7, 1 << 19])
def test_equals_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(r, "STEP", step)
    assert got(spark, DOCS if step > 7 else [d for d in DOCS if d[0] != 7], TARGET) == brute(DOCS if step > 7 else [d for d in DOCS if d[0] != 7], TARGET)


def test_empty_target_and_empty_documents(spark):
    assert got(spark, DOCS[:6], [], least_words=1, percent=50) == brute(DOCS[:6], [], 1, 50)
    assert got(spark, [], TARGET) == []


def test_draw_keeps_all_columns(spark):
    d = spark.createDataFrame([(*x, 9, "x") for x in DOCS], "doc_id long, text string, weight long, uid string")
    t = spark.createDataFrame([(x,) for x in TARGET], "text string")
    rows = r.draw(d, t, percent=20).collect()
    assert rows and rows[0].asDict().keys() == {"doc_id", "text", "weight", "uid"}
    ranked = [x for x in r.importance(d, t, percent=20).collect() if x["rank"]]
    assert sorted(x.doc_id for x in rows) == sorted(x.doc_id for x in ranked) and sorted(x["rank"] for x in ranked) == list(range(1, len(ranked) + 1))


def test_crc_of_joined_parts():
    rng = np.random.default_rng(1)
    parts = [(rng.bytes(int(n)), rng.bytes(int(m))) for n, m in rng.integers(0, 300, (200, 2))] + [(b"a", b"b" * 100_001)]
    a, b = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    out = r.crc_joined(a, b, np.array([len(p[1]) for p in parts]))
    assert list(out) == [zlib.crc32(x + y) for x, y in parts]


def test_kernels():
    row, index, dictionary = words(pa.array(["B a", None, "", "a  c b "]), r.SEPARATORS)
    assert [(int(x), dictionary[int(k)].as_py()) for x, k in zip(row, index)] == [(0, "b"), (0, "a"), (3, "a"), (3, "c"), (3, "b")]
    assert segment_sums(np.array([1, 2, 3]), np.array([0, 2, 2]), 4).tolist() == [1, 0, 5, 0]
    b = pa.record_batch({"text": ["aa", None, "bbb", "c" * 10, ""]})
    assert [p.num_rows for p in slices(b, "text", 5)] == [3, 1, 1] and sum(p.num_rows for p in slices(b, "text", 1)) == 5


def test_words_of_slices():
    texts = [f"Aa B{k} Ü" if k % 7 else None for k in range(3000)]
    for kind in (pa.string(), pa.large_string()):
        b = pa.record_batch({"text": pa.array(texts, kind)})
        found = []
        for part in slices(b, "text", 999):
            row, index, dictionary = words(part.column("text"), r.SEPARATORS)
            dictionary.validate(full=True)
            names = dictionary.to_pylist()
            got = [[] for _ in range(part.num_rows)]
            for x, k in zip(row, index):
                got[x].append(names[k])
            found += got
        assert found == [features(t)[0] for t in texts]


def test_several_slices_equal_brute_force(spark, monkeypatch):
    import evalframe.llm.kernels as kernels

    monkeypatch.setattr(kernels.slices, "__defaults__", (200,))
    assert got(spark, DOCS, TARGET) == brute(DOCS, TARGET)


def test_query_equals_sql(spark):
    rows = same(registry.queries()["op11_resample_kernels"](spark, SF), registry.oracle_sql()["op11_resample_kernels"])
    assert any(x[4] for x in rows)
