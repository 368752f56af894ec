import zlib

import numpy as np
import pyarrow as pa
import pytest

from evalframe.llm import language_id as g
from evalframe.llm import registry
from llm_util import table

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return g.learn(table(spark, "documents", SF01))


def test_held_out_rows(spark):
    lang = {r.doc_id: r.lang for r in table(spark, "documents", SF01).select("doc_id", "lang").collect()}
    rows = registry.queries()["op13_language_id"](spark, SF01).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)
    assert sum(r.rejected for r in held) < 0.05 * len(held)


def test_defined_results(spark, model):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 % 34", "de"), (4, "the and of with", "fr"), (4, "the and of with", "fr"), (5, "the " * 300_000, "x"), (6, "漢字", None)]
    df = spark.createDataFrame([(*r, "kept", 7.0) for r in rows], "doc_id long, text string, lang string, other string, score double")
    out = {r.doc_id: r for r in g.with_language(df, model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(out[k].score == 0 for k in (1, 2, 3))
    assert out[4].lang_pred == out[5].lang_pred == "en" and out[6].lang_pred in model.langs and out[4].other == "kept"
    assert g.with_language(df, model).count() == 7 and g.with_language(df.limit(0), model).count() == 0
    assert all(r.lang_pred == "und" for r in g.with_language(df, model, reject=True).filter("rejected").collect())
    assert g.with_language(df, model).columns == ["doc_id", "text", "lang", "other", "lang_pred", "score", "rejected"]


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, None, "en"), (2, "12", "en"), (3, "text", None)]):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        m = g.learn(df)
        assert m.langs == [] and all(r.lang_pred == "und" and r.score == 0 for r in g.with_language(df, m).collect())


def test_labels_of_held_out_rows_are_not_learned(spark):
    df = spark.createDataFrame([(k, f"word number {k}", "held" if zlib.crc32(str(k).encode()) % 4 == 2 else "seen") for k in range(200)],
                               "doc_id long, text string, lang string")
    assert g.learn(df).langs == ["seen"]


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(k, f"own text {k} of its language" if k % 2 else "one copy", f"l{k % 5}") for k in range(400)], "doc_id long, text string, lang string")
    rows = g.sample(df, g.F.lit(True), per_lang=10, max_langs=3).collect()
    assert len({r.lang for r in rows}) <= 3 and len(rows) <= 30 and sum(r.text == "one copy" for r in rows) <= 3


def naive_logits(table, bias, text):
    n, total = 0, np.zeros(table.shape[1])
    for w in __import__("regex").findall(r"[\p{L}\p{M}]+", text.lower()):
        _, slots = g.subwords(pa.array([w], pa.large_string()))
        total += table[slots].sum(axis=0)
        n += len(slots)
    return total / max(n, 1) + bias


@pytest.mark.parametrize("step", [3, 1 << 16])
def test_logits_equal_word_by_word(monkeypatch, step):
    monkeypatch.setattr(g, "STEP", step)
    rng = np.random.default_rng(0)
    table, bias = rng.normal(size=(1 << g.BITS, 3)), rng.normal(size=3)
    texts = ["Ein Wort, noch ein WORT", "", "1 2", "éa " * 40, "x"]
    z, size = g.logits(table, bias, pa.array(texts, pa.large_string()))
    assert np.allclose(z, [naive_logits(table, bias, t) for t in texts]) and size[1] == size[2] == 0
    slots, share = g.example(texts[0])
    assert np.allclose(share @ table[slots] + bias, z[0])


def test_slices_of_texts():
    texts = pa.array([None if k % 5 == 0 else f"Wort é{k} {chr(97 + k % 26) * 3}" for k in range(400)])
    rng = np.random.default_rng(0)
    table = rng.normal(size=(1 << g.BITS, 2))
    whole, n = g.logits(table, np.zeros(2), texts)
    parts = [g.logits(table, np.zeros(2), texts.slice(a, 37)) for a in range(0, 400, 37)]
    assert np.allclose(np.concatenate([z for z, _ in parts]), whole) and (np.concatenate([c for _, c in parts]) == n).all()
    large = texts.cast(pa.large_string())
    assert np.allclose(np.concatenate([g.logits(table, np.zeros(2), large.slice(a, 37))[0] for a in range(0, 400, 37)]), whole)


def test_subwords_are_byte_runs_of_closed_words():
    of, slots = g.subwords(pa.array(["ab", "c"], pa.large_string()))
    assert np.bincount(of).tolist() == [3 + 2 + 1, 2 + 1]  # <ab>: 2-, 3-, 4-grams; <c>: 2-, 3-grams
    assert set(g.subwords(pa.array(["xab"], pa.large_string()))[1]) != set(slots)


def test_calibration():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 4000)
    z = np.zeros((4000, 2))
    wrong = rng.random(4000) < 0.2
    z[np.arange(4000), np.where(wrong, 1 - y, y)] = 8.0  # far too sure: right in four of five
    t, limit = g.calibrate(z, y)
    assert abs(1 / (1 + np.exp(-8 / t)) - 0.8) < 0.02 and limit > 0.7
    assert g.calibrate(np.zeros((0, 2)), np.zeros(0, int)) == (1.0, 0.0)
