"""One small test per semantic trap."""

import math

from pyspark.sql import functions as F

from evalframe.functions import numeric as N
from evalframe.functions import predicates as P
from evalframe.functions import scoring as sc
from evalframe.functions import text as tx
from evalframe.operators import accuracy as acc
from evalframe.operators.rouge import rouge1


def test_s2_null_is_not_equal_like_pandas(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    got = [r[0] for r in df.select(P.ne_pandas("x", "a")).collect()]
    assert got == [False, True]
    got = [r[0] for r in df.select(P.eq_pandas("x", "a")).collect()]
    assert got == [True, False]


def test_s5_letter_scorer_edge_cases(spark):
    cases = [("m-on-af-belebele-1-answer-B", "(B) since", True),
             ("m-on-af-belebele-1-answer-C", " c", True),
             ("m-on-af-belebele-1-answer-A", "", False),
             ("m-on-af-belebele-1-answer-A", "()", False),
             ("m-on-af-belebele-1-answer-A", "( A", False),   # strip happens before bracket removal: first char is blank
             ("m-on-af-belebele-1-answer-A", " a", True),  # Unicode-aware strip
             ("m-on-af-belebele-1-answer-A", None, False)]
    df = spark.createDataFrame([(c, g) for c, g, _ in cases], "cid string, gen string")
    got = [r[0] for r in df.select(sc.score_letter("cid", "gen")).collect()]
    assert got == [e for _, _, e in cases]


def test_s4_two_binary_scorers(spark):
    df = spark.createDataFrame([("x-answer-1", "1 or 2"), ("x-answer-2", "Option 2."), ("x-answer-1", "neither")],
                               "cid string, gen string")
    strict = [r[0] for r in df.select(sc.score_binary_strict("cid", "gen")).collect()]
    lenient = [r[0] for r in df.select(sc.score_binary_lenient("cid", "gen")).collect()]
    assert strict == [False, True, False]
    assert lenient == [True, True, False]


def test_s16_unicode_whitespace_words(spark):
    df = spark.createDataFrame([("a b  c",), ("   ",), ("",), (None,), ("x　y\nz",)], "t string")
    got = [r[0] for r in df.select(tx.word_count("t")).collect()]
    assert got == [3, 0, 0, 0, 3]
    assert [r[0] for r in df.select(tx.word_count("t", pandas_compat=True)).collect()][3] == 1
    toks = [r[0] for r in df.select(tx.tokens("t")).collect()]
    assert toks[0] == ["a", "b", "c"] and toks[1] == [] and toks[3] == []


def test_s18_rouge_is_multiset_and_symmetric(spark):
    pairs = spark.createDataFrame([
        ("1", "the the cat", "the cat cat"),
        ("2", "a b c", "a b c"),
        ("3", "", "a"),
        ("4", "x y", "z"),
    ], "id string, a string, b string")
    r = {row["id"]: row for row in rouge1(pairs, "id", "a", "b").collect()}
    # multiset overlap: min(2,1)+min(1,2) = 2 of 3 and 3 tokens
    assert r["1"]["overlap"] == 2 and math.isclose(r["1"]["rouge1"], 2 / 3)
    assert r["2"]["rouge1"] == 1.0 and r["3"]["rouge1"] == 0.0 and r["4"]["rouge1"] == 0.0
    swapped = {row["id"]: row["rouge1"] for row in rouge1(pairs, "id", "b", "a").collect()}
    assert all(math.isclose(swapped[k], r[k]["rouge1"]) for k in r)


def test_s1_s30_exact_half_up_rounding(spark):
    df = spark.createDataFrame([(1, 400), (1, 8), (49, 400), (0, 0)], "c long, n long")
    got = [r[0] for r in df.select(N.pct_tenths("c", "n")).collect()]
    assert got == [3, 125, 123, None]   # 0.25 % -> 0.3, 12.5 % exact, 12.25 % -> 12.3, empty -> null


def test_s8_one_trial_std_is_null(spark):
    rows = [("m", "en", 1, 1), ("m", "en", 1, 0)]
    df = spark.createDataFrame(rows, "train_data string, eval_lang string, trial int, correct int")
    out = acc.mean_std_over_trials(df, ["train_data", "eval_lang"]).collect()[0]
    assert out["n_trials"] == 1 and out["std_pct"] is None and out["mean_pct"] == 50.0


def test_s6_sentinel_for_untested_language(spark):
    from evalframe.plans import catalog
    q = catalog.queries()["score_generations"](spark, "/root/testdata/sf0.001")
    am = q.filter(F.col("lang") == "am").select("score_pct", "n_answers").distinct().collect()
    assert [(r[0], r[1]) for r in am] == [(-100.0, 0)]


def test_s9_last_answer_wins(spark):
    df = spark.createDataFrame([("id1", "A", 1), ("id1", "B", 2), ("id2", "C", 1)], "custom_id string, content string, o int")
    got = dict(df.groupBy("custom_id").agg(F.max_by("content", "o")).collect())
    assert got == {"id1": "B", "id2": "C"}


def test_f8_initials(spark):
    df = spark.createDataFrame([("Ann-Bo",), (None,), ("Solo",)], "n string")
    assert [r[0] for r in df.select(tx.initials("n")).collect()] == ["Ann.Bo.", None, None]


def test_parse_custom_id_with_hyphenated_benchmark(spark):
    df = spark.createDataFrame([("gpt-4o-2024-05-13-on-nso-mmlu-college_medicine-17-answer-C",)], "c string")
    p = sc.parse_custom_id("c")
    row = df.select(*[v.alias(k) for k, v in p.items()]).collect()[0]
    assert (row["model"], row["lang"], row["benchmark"], row["n"], row["gold"]) == (
        "gpt-4o-2024-05-13", "nso", "mmlu-college_medicine", 17, "C")  # S23: 3-letter code kept


def test_g6_inserted_model_sits_directly_above_flagship(spark):
    from evalframe import dims
    from evalframe.plans import catalog
    rows = catalog.queries()["insert_ranked_rows"](spark, "/root/testdata/sf0.001").orderBy("position").collect()
    labels = [r["row_label"] for r in rows]
    ins, flag = dims.FIXTURE_MODEL_LABELS[dims.FIXTURE_INSERTED_MODEL], dims.FIXTURE_MODEL_LABELS[dims.FIXTURE_FLAGSHIP_MODEL]
    for i, lab in enumerate(labels):
        if lab.startswith(ins + " ("):
            bench = lab[len(ins):]
            assert labels[i + 1] == flag + bench
    assert [r["position"] for r in rows] == list(range(1, len(rows) + 1))


def test_s12_missing_run_gives_null_mean_but_keeps_denominator(spark):
    from evalframe.operators import lift
    rows = [(i, i % 500, "winogrande", "m", "en", t, 1, False, "Human") for i, t in [(0, 1), (500, 2), (1000, 3), (1, 1), (501, 2)]]
    df = spark.createDataFrame(rows, "response_id long, item_id long, benchmark string, model string, eval_lang string, trial int, "
                                     "correct int, was_ft boolean, approach string")
    out = {r["item_id"]: r for r in lift.aligned_runs(lift.item_runs(df)).collect()}
    assert out[0]["n_runs"] == 3 and out[0]["mean_correct"] == 1.0
    assert out[1]["n_runs"] == 2 and out[1]["mean_correct"] is None


def test_s21_histogram_top_edge_in_last_bin(spark):
    from evalframe.operators import curation as cu
    rows = [(f"gpt-4o-on-af-winogrande-train_s-{i}_vs_belebele_{t}", str(v)) for i, v in [(1, 10), (2, 1)] for t in range(3)]
    s = cu.rating_scores(spark.createDataFrame(rows, "custom_id string, content string"))
    bins = {r["row_id"]: r["bin"] for r in s.select("row_id", cu.histogram_bin(F.col("score_sum")).alias("bin")).collect()}
    assert bins == {"1": 26, "2": 0}   # a mean of exactly 10 lands in the last (closed) bin
