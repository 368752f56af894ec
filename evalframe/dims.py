"""Dimension constants and small dimension DataFrames.

Dimensions are tiny and fixed by the study design (languages, benchmarks,
trials, ...), so they are built with ``createDataFrame`` and joined with a
broadcast hint: their size is bounded by the constants below, not by data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the study design (do not edit).
# ---------------------------------------------------------------------------
RUNS = [1, 2, 3]
QUALITIES = ["low", "high"]
QUANTITIES = ["25%", "50%", "75%", "100%"]
LANGUAGES = {
    "en": "English", "af": "Afrikaans", "zu": "Zulu", "xh": "Xhosa",
    "am": "Amharic", "bm": "Bambara", "ig": "Igbo", "nso": "Sepedi",
    "sn": "Shona", "st": "Sesotho", "tn": "Setswana", "ts": "Tsonga",
}
LANGUAGE_SUFFIX = {code: ("" if code == "en" else f"_{code}") for code in LANGUAGES}
BENCHMARKS = ["belebele", "mmlu-college_medicine", "mmlu-clinical_knowledge", "mmlu-virology", "winogrande"]
TABLE2_BENCHMARK_ORDER = ["winogrande", "mmlu-college_medicine", "mmlu-clinical_knowledge", "mmlu-virology", "belebele"]
FT_TRAIN_BENCHMARKS = ["mmlu-college_medicine", "winogrande"]
FT_EVAL_BENCHMARKS = [b for b in BENCHMARKS if b != "mmlu-college_medicine"]
MMLU_SPLITS = ["dev", "test", "val"]
HUMAN_MARKER = "Human"
TYPICAL = "No, the sentence is typical"
COMPLETELY_WRONG = "Completely wrong"
GOOD_TRANSLATION = "Good translation"
# Appropriateness answer categories in the order statsmodels sorts them, with short labels.
APPROPRIATENESS_CATEGORIES = [
    ("Do not understand", "D.U."),
    ("Maybe", "Not sure"),
    ("No, the sentence is typical", "Typical"),
    ("Yes", "Strange"),
]
QUALITY_CATEGORIES = ["Completely wrong", "Good translation", "Understandable"]
RANDOM_BASELINE_PCT = {"winogrande": 50.0}  # every other benchmark: 4 options -> 25.0
LIFT_THRESHOLD_PCT = 5
ANSWER_LETTERS = ["A", "B", "C", "D"]
# ---------------------------------------------------------------------------

# The driver fixtures (FIXTURES.md §C) express models as event types. These
# are the roles each event type plays in the fixture-backed queries.
FIXTURE_LANGUAGES = ["en", "af", "zu", "xh"]
FIXTURE_MODEL_LABELS = {
    "click": "GPT-4o",
    "purchase": "GPT-4",
    "view": "Llama 3 70B IT",
    "error": "Aya 101",
    "signup": "o1-mini",
}
FIXTURE_BASELINE_MODEL = "view"       # plays the un-tuned fine-tuning base model
FIXTURE_FLAGSHIP_MODEL = "click"      # plays GPT-4o in the headline table
FIXTURE_INSERTED_MODEL = "signup"     # plays o1-mini, inserted above GPT-4o


def language_dim(spark: SparkSession, codes: list[str] | None = None) -> DataFrame:
    codes = codes or list(LANGUAGES)
    rows = [(c, LANGUAGES[c], i) for i, c in enumerate(codes)]
    return spark.createDataFrame(rows, "lang string, language string, lang_order int")


def benchmark_dim(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    names = names or BENCHMARKS
    rows = [(b, i, RANDOM_BASELINE_PCT.get(b, 25.0)) for i, b in enumerate(names)]
    return spark.createDataFrame(rows, "benchmark string, bench_order int, random_pct double")


def model_label_dim(spark: SparkSession, labels: dict[str, str] | None = None) -> DataFrame:
    labels = labels or FIXTURE_MODEL_LABELS
    rows = [(m, lab, i) for i, (m, lab) in enumerate(labels.items())]
    return spark.createDataFrame(rows, "model string, model_label string, model_order int")


def literal_array(values):
    """Column holding a fixed list — lets us enumerate small grids with ``explode``."""
    return F.array(*[F.lit(v) for v in values])
