"""The classifiers against plain Python twins, workers without the package, and clashing column names."""

import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.llm import fuzzy_lines, language_id, quality_clf as q, resampling, sampling
from evalframe.llm import toxicity as t
from llm_util import SF, table


# --- FTRL ---------------------------------------------------------------------------------------

def plain_features(text):
    """{slot: value} one n-gram at a time."""
    words, low = text.split(), text.lower().split()
    h = [int(sampling.word_hashes([w.encode()])[0]) for w in low]
    s = [int(sampling.word_hashes([q.shape(w)])[0]) ^ 0x5851F42D4C957F2D for w in words]
    s = [0x2545F4914F6CDD1D if k and h[k] == h[k - 1] else x for k, x in enumerate(s)]
    slots = Counter()
    for seq, sizes in ((h, (1, 2)), (s, (1, 2, 3))):
        for n in sizes:
            for k in range(len(seq) - n + 1):
                slots[int(sampling.windows(np.array(seq[k:k + n], dtype=np.uint64), n)[0]) >> (64 - q.BITS)] += 1
    x = {k: math.log1p(c) for k, c in slots.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {k: v / norm for k, v in x.items()}


def plain_ftrl(rows, epochs):
    """One weight at a time, as the published update reads."""
    z, n, bias = Counter(), Counter(), 1 << q.BITS
    of = Counter(y for _, y in rows)
    share = {y: len(rows) / (2 * of[y]) if len(of) > 1 else 1.0 for y in of}

    def weight(i):
        if abs(z[i]) <= q.L1:
            return 0.0
        return -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    for _ in range(epochs):
        for text, y in rows:
            x = plain_features(text) | {bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = share[y] * (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_the_plain_update():
    rows = [(r.text or "", k % 3 > 0) for k, r in enumerate(_texts(40))]
    rows = [(x, int(y)) for x, y in rows]
    w = q.train([(*q.features(x), y) for x, y in rows], epochs=3)
    want = plain_ftrl(rows, 3)
    assert np.flatnonzero(w).size == sum(1 for v in want.values() if v)
    assert all(abs(w[i] - v) < 1e-9 for i, v in want.items())


class _Row:
    def __init__(self, text):
        self.text = text


def _texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "OF", "x9", "of%%%", "Häuser", "a" * 90, "!!", "und", "words", "12", "ok"]
    return [_Row(" ".join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for _ in range(n)]


def test_long_words_are_read_whole():
    a, b = "x" * 70 + "9", "x" * 70 + "Y"
    assert q.shape(a) == b"a9" and q.shape("a1" * 40) == b"a9" * 40
    assert set(q.features(a)[0]) != set(q.features(b)[0])


def test_quality_stage_equals_scores_one_by_one(spark, tmp_path):
    docs = table(spark, "documents")
    weights = q.learn(docs, table(spark, "labels"))
    kept = {r.doc_id for r in cp.quality(spark, docs, SF).select("doc_id").collect()}
    rows = docs.select("doc_id", "text").collect()
    want = set()
    for r in rows:
        x = plain_features(r.text or "") if (r.text or "").split() else {}
        z = sum(float(weights[i]) * v for i, v in x.items()) + float(weights[-1])
        if 1 / (1 + math.exp(-max(-35, min(35, z)))) >= cp.QUALITY:
            want.add(r.doc_id)
    assert kept == want and 0 < len(kept) < len(rows)


# --- toxicity -----------------------------------------------------------------------------------

def plain_hits(lex, folded):
    """For each place where a word begins, the longest entry; entries under an exception phrase do not count."""
    covered = [(m.start(), m.start() + len(e) + 2) for e in lex.exceptions for m in re.finditer(f"(?= {re.escape(e)} )", folded)]
    out = []
    for s in range(len(folded)):
        found = [e for e in lex.weights if folded.startswith(e, s)]
        if found:
            e = max(found, key=len)
            if not any(a <= s and s + len(e.rstrip()) <= b for a, b in covered):
                out.append((s, e, lex.weights[e]))
    return out


def plain_measure(lex, text):
    f, g = t.fold(text), t.fold_substitutes(text)
    total = sum(w for _, _, w in plain_hits(lex, f)) + (sum(w for _, _, w in plain_hits(lex, g)) if g else 0)
    return math.log1p(total), math.log1p(100.0 * total / (len(f.split()) + 10))


def test_lexicon_equals_plain_search():
    lex = t.Lexicon({" tra": 1.0, " trash ": 5.0, " idiot ": 4.0, " id": 0.5, " bad ": 2.0}, ("trash metal", "bad", "not idiot"))
    rng = random.Random(5)
    vocabulary = ["trash", "Trаsh", "tr4sh", "1d10t", "idiot", "not", "metal", "bad", "tram", "id", "fine", "b4d", "x" * 60, "tra-sh", "​trash"]
    for _ in range(300):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 14)))
        assert lex.hits(t.fold(text)) == plain_hits(lex, t.fold(text))
        assert np.allclose(lex.measure(text), plain_measure(lex, text))


def test_toxic_stage_equals_scores_one_by_one(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    lex, curve = t.learn(docs, labels)
    assert lex.weights
    kept = {r.doc_id for r in cp.toxic(spark, docs, sf).select("doc_id").collect()}
    rows = docs.select("doc_id", "text").collect()
    for r in rows[::4]:  # the plain search is slow
        z = float(np.dot([*plain_measure(lex, r.text or ""), 1.0], curve))
        assert (r.doc_id in kept) == (1 / (1 + math.exp(-max(-35, min(35, z)))) < cp.TOXIC)
    assert 0 < len(kept) < len(rows)


def test_workers_need_no_package(tmp_path):
    """Driver with the package on its own path only; workers start elsewhere and have none."""
    code = f"""
import sys
sys.path.insert(0, {str(cp.__file__.rsplit('/', 1)[0])!r})
import numpy as np
from pyspark.sql import SparkSession, functions as F
from evalframe.llm import language_id, quality_clf, toxicity
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
@F.udf("boolean")
def lacks(x):
    import importlib.util
    return importlib.util.find_spec("evalframe") is None
df = spark.createDataFrame([(1, "so b4d"), (2, None)], "doc_id long, text string")
assert all(r[0] for r in df.select(lacks("doc_id")).collect())
lex = toxicity.Lexicon({{" bad ": 5.0}}, ("bad luck",))
assert [r.score > 0.5 for r in toxicity.with_toxicity(df, lex, np.array([1.0, 1.0, -3.0])).collect()] == [True, False]
assert quality_clf.with_quality(df, np.zeros((1 << quality_clf.BITS) + 1, dtype=np.float32)).count() == 2
m = language_id.Model(["en"], np.zeros((1 << language_id.BITS, 1), np.float32), np.zeros(1))
assert [r.lang_pred for r in language_id.with_language(df, m).collect()] == ["en", "und"]
print("done")
"""
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items()
                                                                                                               if k not in ("PYTHONPATH", "SPARK_CONF_DIR")} | {"PYTHONPATH": _without_repo()})
    assert "done" in r.stdout, r.stderr[-2000:]


def _without_repo():
    import os

    repo = cp.__file__.rsplit("/", 1)[0]
    return os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != repo)


# --- clashing names -----------------------------------------------------------------------------

NAMES = ("uid", "n_lines", "n_removed", "_row", "_l", "lost", "score", "label", "rank", "key", "weight", "n_words", "lang_pred", "rejected", "component", "id", "value")


def clashing(spark):
    docs = spark.createDataFrame([(1, "One line here now\nsame old line again"), (2, "Another line here\nsame old line again"), (3, None), (4, ""), (4, "")],
                                 "doc_id long, text string")
    return docs.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit("own").alias(c) for c in NAMES])


def test_lines_with_clashing_names(spark, tmp_path):
    docs = clashing(spark)
    docs.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    out = fuzzy_lines.dedup_lines(docs, stored=True)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.uid) for r in out.filter("doc_id < 4").collect()}
    assert got == {1: (2, 0, "own"), 2: (2, 1, "own"), 3: (0, 0, "own")} and out.columns == [c for c in docs.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    stage = cp.lines(spark, docs, str(tmp_path))
    assert stage.columns == docs.columns and {r.n_removed for r in stage.collect()} == {"own"} and stage.count() == 5


def test_new_operators_with_clashing_names(spark):
    docs = clashing(spark)
    target = spark.createDataFrame([("same old line",)], "text string")
    assert resampling.importance(docs, target).count() == 5
    assert resampling.draw(docs, target, least_words=1, percent=100).columns == docs.columns
    m = language_id.Model(["en"], np.zeros((1 << language_id.BITS, 1), np.float32), np.zeros(1))
    assert language_id.with_language(docs, m).count() == 5
    assert zlib.crc32(b"4") % 4 in range(4)


@pytest.mark.parametrize("stage", [cp.quality, cp.toxic])
def test_filters_with_clashing_names(spark, tmp_path, stage):
    table(spark, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(spark)
    docs.write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert stage(spark, docs, str(tmp_path)).columns == docs.columns
