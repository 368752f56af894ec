"""Answer parsing and scoring as column expressions.

No Python UDFs: every scorer is a composition of built-in string
functions, so it runs inside whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Compound request id: {model}-on-{lang}-{benchmark}-{n}-answer-{gold}
CUSTOM_ID_PATTERN = r"^(.*)-on-([a-z]+)-(.+)-([0-9]+)-answer-(.+)$"
# Rating id: gpt-4o-on-{lang}-{train}-{id}_vs_{eval}_{trial}
RATING_ID_PATTERN = r"^(.*)-on-([a-z]+)-(mmlu-college_medicine-dev|winogrande-train_s|[^-]+)-([^_]+)_vs_(.+)_([0-9]+)$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Characters Python's ``str.strip()`` removes (``str.isspace``), as a fixed set.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")


def unicode_strip(text) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of exactly Python's set (no regex)."""
    return F.btrim(_c(text), F.lit(PY_WHITESPACE))


def score_letter(custom_id, generation) -> Column:
    """strip, delete all brackets, upper-case, first char == last char of the id.

    An empty parsed answer scores False; a null generation scores False.
    """
    parsed = F.upper(F.replace(F.replace(unicode_strip(generation), F.lit("("), F.lit("")), F.lit(")"), F.lit("")))
    gold = F.substring(_c(custom_id), -1, 1)
    return F.coalesce((F.length(parsed) > 0) & (F.substring(parsed, 1, 1) == gold), F.lit(False))


def score_binary_strict(custom_id, generation) -> Column:
    """gold option number present AND the other option number absent."""
    gold = F.substring(_c(custom_id), -1, 1)
    other = (F.lit(3) - gold.try_cast("int")).cast("string")  # a gold that is no number scores False
    g = _c(generation)
    return F.coalesce(g.contains(gold) & ~g.contains(other), F.lit(False))


def lenient_binary_answer(generation) -> Column:
    """F3 parsing: "1" wins if present, else "2", else the raw answer."""
    g = _c(generation)
    return F.when(g.contains("1"), F.lit("1")).when(g.contains("2"), F.lit("2")).otherwise(g)


def score_binary_lenient(custom_id, generation) -> Column:
    """lenient parse compared with the gold digit."""
    return F.coalesce(lenient_binary_answer(generation) == F.substring(_c(custom_id), -1, 1), F.lit(False))


def parse_custom_id(custom_id) -> dict[str, Column]:
    """model, lang, benchmark, n, gold of ``{model}-on-{lang}-{benchmark}-{n}-answer-{gold}``.

    One ``rlike`` validates the id; the parts are then cut with
    ``substring_index`` (last ``-on-``, last ``-answer-``), which equals the
    greedy regex groups on valid ids and costs no backtracking. Invalid ids
    give empty strings (and a null ``n``), like a failed ``regexp_extract``.
    """
    c = _c(custom_id)
    ok = c.rlike(CUSTOM_ID_PATTERN)
    rest = F.substring_index(c, "-on-", -1)                       # {lang}-{benchmark}-{n}-answer-{gold}
    lang = F.substring_index(rest, "-", 1)
    mid = F.substring_index(rest, "-answer-", 1)                  # {lang}-{benchmark}-{n}
    n = F.substring_index(mid, "-", -1)
    bench = F.substring(mid, F.length(lang) + 2, F.length(mid) - F.length(lang) - F.length(n) - 2)
    model = F.substring(c, F.lit(1), F.length(c) - F.length(rest) - 4)
    gold = F.substring_index(c, "-answer-", -1)

    def guard(x: Column) -> Column:
        return F.when(ok, x).otherwise(F.lit(""))

    return {"model": guard(model), "lang": guard(lang), "benchmark": guard(bench),
            "n": F.when(ok, n.try_cast("bigint")), "gold": guard(gold)}


def dataset_of(custom_id) -> Column:
    """Benchmark family of a request id (``-mmlu-``, ``-winogrande-``, ``-belebele-``)."""
    c = _c(custom_id)
    return (F.when(c.contains("-mmlu-"), "mmlu").when(c.contains("-winogrande-"), "winogrande")
            .when(c.contains("-belebele-"), "belebele"))


def score_generation(custom_id, generation, benchmark) -> Column:
    """Scorer dispatch: strict binary for Winogrande, letter scorer otherwise."""
    return F.when(_c(benchmark) == "winogrande", score_binary_strict(custom_id, generation)) \
        .otherwise(score_letter(custom_id, generation))


def packed_score(order, custom_id, generation) -> Column:
    """Load order and both scores of an answer in one number, so that ``max`` keeps the last answer (S9) in a hash aggregate.

    Which score counts depends on the id alone (``unpacked_score``). ``order`` is below 2^61.
    """
    bits = F.when(score_binary_strict(custom_id, generation), 2).otherwise(0) + F.when(score_letter(custom_id, generation), 1).otherwise(0)
    return F.shiftleft(_c(order).cast("bigint"), 2) + bits


def unpacked_score(packed, benchmark) -> Column:
    """The score (0 or 1) of the answer that ``packed_score`` kept, by the scorer of its benchmark."""
    p = _c(packed)
    return F.when(_c(benchmark) == "winogrande", F.shiftright(p, 1).bitwiseAND(F.lit(1))).otherwise(p.bitwiseAND(F.lit(1))).cast("int")


def substitute_model(template, model) -> Column:
    """replace the ``<|MODEL|>`` placeholder (every occurrence)."""
    return F.replace(_c(template), F.lit("<|MODEL|>"), model if isinstance(model, Column) else F.lit(model))


def parse_rating_id(custom_id) -> dict[str, Column]:
    """Parts of ``{rater}-on-{lang}-{train}-{row_id}_vs_{eval}_{trial}``.

    Validated by one ``rlike`` against the named-part pattern (instead of the
    source's "text up to the 2nd underscore"), then cut with
    ``substring_index``; invalid ids give empty strings and a null trial.
    """
    c = _c(custom_id)
    ok = c.rlike(RATING_ID_PATTERN)
    rest = F.substring_index(c, "-on-", -1)                  # {lang}-{train}-{row_id}_vs_{eval}_{trial}
    lang = F.substring_index(rest, "-", 1)
    trial = F.substring_index(c, "_", -1)
    left = F.substring_index(rest, "_vs_", 1)                # {lang}-{train}-{row_id}
    right = F.substring_index(rest, "_vs_", -1)              # {eval}_{trial}
    ev = F.substring(right, F.lit(1), F.length(right) - F.length(trial) - 1)
    row_id = F.substring_index(left, "-", -1)
    train = F.substring(left, F.length(lang) + 2, F.length(left) - F.length(lang) - F.length(row_id) - 2)
    rater = F.substring(c, F.lit(1), F.length(c) - F.length(rest) - 4)

    def guard(x: Column) -> Column:
        return F.when(ok, x).otherwise(F.lit(""))

    return {"rater": guard(rater), "lang": guard(lang), "train": guard(train), "row_id": guard(row_id),
            "eval": guard(ev), "trial": F.when(ok, trial.try_cast("bigint"))}
