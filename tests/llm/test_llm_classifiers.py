import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.llm import quality_clf as q
from evalframe.llm import registry, sampling
from evalframe.llm import toxicity as t
from llm_util import SF, duck, table

SF01 = "/root/testdata/sf0.01"


def scored(spark, name, label):
    y = {r.doc_id: r[label] for r in table(spark, "labels", SF01).collect()}
    rows = registry.queries()[name](spark, SF01).collect()
    assert len(rows) == table(spark, "documents", SF01).count()
    assert all(0 <= r.score <= 1 for r in rows)
    h = [(r.score, y[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in y]
    wins = [(a > b) + 0.5 * (a == b) for a, la, _ in h if la for b, lb, _ in h if not lb]
    return rows, sum(wins) / len(wins), sum(p == la for _, la, p in h) / len(h)


def test_quality_on_held_out_rows(spark):
    rows, auc, accuracy = scored(spark, "op9_quality_ftrl", "quality")
    assert auc > 0.97 and accuracy > 0.93
    crc = duck("SELECT 1")  # noqa: F841
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    rows, auc, accuracy = scored(spark, "op4_toxicity", "toxic")
    assert auc > 0.85 and accuracy > 0.93
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)


def test_scores_of_null_empty_repeated_and_long_texts(spark):
    w = np.zeros((1 << q.BITS) + 1, dtype=np.float32)
    w[-1] = 1.0
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", "b"), (3, "x y", "b"), (4, "word " * 200_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = q.with_quality(df, w, column="s").collect()
    assert len(got) == 5 and abs(got[0].s - 1 / (1 + np.exp(-1.0))) < 1e-9 and got[0].s == got[1].s and got[2].s == got[3].s
    lex = t.Lexicon({" bad ": 5.0})
    got = t.with_toxicity(df.unionByName(spark.createDataFrame([(5, "so b4d, Bаd!", "x")], df.schema)), lex, np.array([1.0, 1.0, -4.0]), column="s").collect()
    assert got[0].s == got[1].s == got[2].s < 0.1 and got[-1].s > 0.5
    assert q.with_quality(df.limit(0), w).count() == 0 and t.with_toxicity(df.limit(0), lex, np.zeros(3)).count() == 0


def test_learning_without_a_class(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not q.learn(docs, none).any()
    lex, curve = t.learn(docs, none)
    assert not lex.weights and 1 / (1 + np.exp(-curve[2])) < 1e-6
    clean = spark.createDataFrame([(k, 1, 0) for k in range(6)] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert not t.learn(docs, clean)[0].weights


def test_sample_is_bounded_and_without_copies(spark):
    docs = spark.createDataFrame([(k, "one copy of the same text" if k < 50 else f"own text number {k} with words", k) for k in range(100)], "doc_id long, text string, label long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(1, 1)], "doc_id long, quality int")
    s = sampling.training_sample(docs, labels, "quality", F.lit(True), per_class=20).collect()
    assert len(s) <= 40 and sum(r.text.startswith("one") for r in s) <= 2


def test_folding():
    assert t.fold("Тrаsh, TRASH​! ｔrash") == " trash trash trash "
    assert t.fold_substitutes("an 1d10t, tr@sh and $tupid") == " idiot trash stupid "
    assert t.fold_substitutes("nothing here 2024 1,000") is None


def test_longest_entry_counts_and_exceptions_cover():
    lex = t.Lexicon({" tra": 1.0, " trash ": 5.0}, ("trash metal",))
    assert [h[1:] for h in lex.hits(t.fold("trash tram trash metal"))] == [(" trash ", 5.0), (" tra", 1.0)]
    a, b = lex.measure("trash " + "word " * 10)
    c, d = lex.measure("trash " + "word " * 1000)
    assert a == c and b > d


def test_ftrl_learns_a_separable_toy():
    texts = [("good fine words", 1), ("bad junk !!", 0)] * 30
    w = q.train([(*q.features(x), y) for x, y in texts])
    p = [1 / (1 + np.exp(-(w[q.features(x)[0]] @ q.features(x)[1] + w[-1]))) for x, _ in texts[:2]]
    assert p[0] > 0.9 and p[1] < 0.1


@pytest.mark.parametrize("word,want", [("EDTH!!", b"A!!"), ("Shti", b"B"), ("of%%%", b"a%%%"), ("|", b"|"), ("x9", b"a9")])
def test_shapes(word, want):
    assert q.shape(word) == want


def test_training_examples_are_held_compactly():
    """At most six bytes a feature, values and weights bit by bit those of ``features``; a count above a byte's range is kept."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 400)) for _ in range(40)] + ["", " \n", "again " * 700, "one"]
    examples = q.Examples()
    for k, t in enumerate(texts):
        examples.add(t, k % 2)
    plain = [(*q.features(t), k % 2) for k, t in enumerate(texts)]
    for (s, x, y), (slots, values, label) in zip(examples, plain, strict=True):
        assert s.tolist() == slots.tolist() and x.tolist() == values.tolist() and y == label
    assert q.train(examples, epochs=2).tolist() == q.train(plain, epochs=2).tolist()
    held = sum(len(a) * a.itemsize for a in (examples.slots, *examples.counts.values()))
    assert len(examples) == len(texts) and held <= 6 * sum(len(slots) for slots, _, _ in plain)
