"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts to
Latin ones, invisible signs dropped, and inside words with letters digits and
signs that stand for letters (``1d10t``). Everything but letters and digits
becomes one blank, so that an entry `` trash `` is a whole word and `` vequ`` a
word's beginning.

The lexicon is learned from a bounded labelled sample: entries are words and
word beginnings of ``PREFIXES`` letters that occur in enough toxic texts and
hardly in others; the weight is the log odds of cautious counts. Exception phrases are
words and word pairs around an entry that occur in clean texts of the sample
and in no toxic one; entries inside them do not count.

All entries and phrases are matched in one pass of an Aho-Corasick automaton
over the whole text (at most ``MAX_TERMS`` entries, broadcast). Per word the
longest entry counts. The sum of weights, and that sum per word of text, go
into a two-variable logistic curve fitted on the sample.

Defined results: null and empty texts have no hits and get the curve's base
score; without toxic or without clean rows in the sample the lexicon is empty
and the score is the toxic share of the sample (0 if there is none); words above
``LONGEST_WORD`` letters are no entries, and in runs of signs above that length
no substitutes are undone; repeated rows get equal scores; extra columns are ignored. Labels, language, source and
ids are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm.quality_clf import crc_remainder
from evalframe.llm.sampling import PER_CLASS, training_sample
from evalframe.llm.streams import arrow_schema, batched, rows_of

PREFIXES = (3, 4, 5, 6, 7, 8)
MAX_TERMS = 5000
MIN_WEIGHT = 2.3
#: Longer words are no words of a lexicon, and longer blank-separated runs are no disguised words (addresses, keys, tables).
LONGEST_WORD = 40

#: Look-alike letters -> Latin letters (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
#: Digits and signs that stand for letters inside words (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): None for c in INVISIBLE}
_FOLD |= {0xFF01 + k: chr(0x21 + k) for k in range(94)}  # full-width forms
_NEEDS = re.compile("[" + "".join(map(re.escape, [*HOMOGLYPHS, *INVISIBLE])) + "！-～]")
_SUBST = str.maketrans(SUBSTITUTES)
_OTHER = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """The folded text, words separated by one blank, with a blank at either end."""
    t = text.lower()
    if _NEEDS.search(t):
        t = t.translate(_FOLD)
    return " " + _OTHER.sub(" ", t).strip() + " "


def fold_substitutes(text: str) -> str | None:
    """As ``fold`` with substitutes inside words undone; None if the text has no such word."""
    t = text.lower().translate(_FOLD) if _NEEDS.search(text.lower()) else text.lower()
    out = [w.strip("!|").translate(_SUBST) for w in t.split() if _mixed(w)]
    return " " + _OTHER.sub(" ", " ".join(out)).strip() + " " if out else None


_LETTER, _STANDS = re.compile(r"[^\W\d_]"), re.compile(r"[0134578@$!|](?=[\w@$!|]*[^\W\d_])")


def _mixed(word: str) -> bool:
    """A word of letters with substitutes inside (not only behind), of a length that words have."""
    return 3 <= len(word) <= LONGEST_WORD and _LETTER.search(word) is not None and _STANDS.search(word) is not None


def terms(folded: str) -> set[str]:
    """Candidate entries of a folded text: whole words and word beginnings, with their blanks."""
    out = set()
    for w in set(folded.split()):
        if len(w) <= LONGEST_WORD:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in PREFIXES if len(w) >= k)
    return out


class Lexicon:
    """Entries and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = ()):
        self.weights, self.exceptions = weights, tuple(exceptions)
        self._auto = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "_auto": None}

    def _automaton(self):
        if self._auto is None:
            import ahocorasick

            self._auto = ahocorasick.Automaton()
            for t, w in self.weights.items():
                self._auto.add_word(t, (t, w))
            for e in self.exceptions:
                self._auto.add_word(f" {e} ", (f" {e} ", None))
            self._auto.make_automaton()
        return self._auto

    def hits(self, folded: str) -> list[tuple[int, str, float]]:
        """(place, entry, weight), one per word: the longest entry, if no exception phrase covers it."""
        if not self.weights:
            return []
        best: dict[int, tuple[str, float]] = {}
        spans = []
        for end, (t, w) in self._automaton().iter(folded):
            start = end - len(t) + 1
            if w is None:
                spans.append((start, end))
            elif start not in best or len(t) > len(best[start][0]):
                best[start] = (t, w)
        return [(s, t, w) for s, (t, w) in sorted(best.items())
                if not any(a <= s and s + len(t.rstrip()) <= b for a, b in spans)]

    def measure(self, text: str) -> tuple[float, float]:
        """(sum of weights, sum of weights per word), as logarithms of one plus them."""
        f = fold(text)
        total = sum(w for _, _, w in self.hits(f))
        g = fold_substitutes(text)
        if g is not None:
            total += sum(w for _, _, w in self.hits(g))
        words = f.count(" ") - 1
        return math.log1p(total), math.log1p(100.0 * total / (words + 10))


def _counts(sample: DataFrame, of, least: int) -> DataFrame:
    """Texts per (term, label) with at least ``least`` toxic texts; summed inside each task first."""
    out = "term string, toxic long, clean long"
    schema = arrow_schema(out)

    def run(batches):
        toxic, clean = Counter(), Counter()
        for label, t in rows_of(batches):
            (toxic if label else clean).update(of(t))
        yield from batched(((k, toxic[k], clean[k]) for k in toxic.keys() | clean.keys()), schema, n=20_000)

    x = sample.select("label", "text").mapInArrow(run, out)
    return x.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= least)


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, max_terms: int = MAX_TERMS) -> Lexicon:
    """Entries with their log odds, then the exception phrases around them."""
    if not n_toxic or not n_clean:
        return Lexicon({})
    least = max(3, round(0.003 * n_toxic))
    toxic, clean = F.col("toxic"), F.col("clean")  # counts less (more) one standard deviation: few texts are weak evidence
    weight = F.log((toxic - F.sqrt(toxic)) / n_toxic) - F.log((clean + F.sqrt(clean) + 1) / (n_clean + 1.0))
    found = (_counts(sample, lambda t: terms(fold(t)), least).withColumn("w", weight).filter(F.col("w") >= MIN_WEIGHT)
             .orderBy(F.desc(F.col("w") * F.log1p("toxic")), "term").limit(max_terms).collect())
    first = Lexicon({r["term"]: float(r["w"]) for r in found})
    if not first.weights:
        return first

    def phrases(t: str) -> set[str]:
        f, out = fold(t), set()
        for s, _, _ in first.hits(f):
            before, after = f[:s].rsplit(" ", 1)[-1], f[s + 1: s + 90].split(" ")[:2]
            out.add(after[0])
            if before:
                out.add(f"{before} {after[0]}")
            if len(after) > 1 and after[1]:
                out.add(f"{after[0]} {after[1]}")
        return out

    clean = (_counts(sample, phrases, 0).filter((F.col("toxic") == 0) & (F.col("clean") >= 2))
             .orderBy(F.desc("clean"), "term").limit(max_terms).collect())
    return Lexicon(first.weights, tuple(r["term"] for r in clean))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 30) -> np.ndarray:
    """Logistic curve over two measures and a constant, by Newton steps with a ridge."""
    if not len(y):
        return np.array([0.0, 0.0, -30.0])
    a = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, ridge, 1e-3])
        b = b - np.linalg.solve(h, a.T @ (p - y) + np.array([ridge, ridge, 1e-3]) * b)
    return b


def fit(sample: DataFrame, max_terms: int = MAX_TERMS) -> tuple[Lexicon, np.ndarray]:
    """(lexicon, curve). To the driver come at most ``max_terms`` entries and phrases, and a count table of measures."""
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    lex = learn_lexicon(sample, n.get(1, 0), n.get(0, 0), max_terms)
    out = "a double, b double, label int"
    schema = arrow_schema(out)

    def run(batches):
        yield from batched(((*lex.measure(t), y) for y, t in rows_of(batches)), schema)

    m = sample.select("label", "text").mapInArrow(run, out).toPandas()  # at most two numbers per sample row
    return lex, fit_curve(m[["a", "b"]].to_numpy(), m["label"].to_numpy(dtype=float))


def score(text: Column, lexicon: Lexicon, curve: np.ndarray, spark: SparkSession) -> Column:
    """The score of a text column, whole texts; other columns of the row stay in the JVM."""
    held = spark.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, curve))  # plain values: workers may lack this package

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, exceptions, c = held.value
        lex = Lexicon(weights, exceptions)  # the automaton is built once a task
        for texts in batches:
            m = np.array([lex.measure(t or "") for t in texts]).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(m @ c[:2] + c[2], -35, 35))))

    return of(text)


def held_out(key: str = "doc_id") -> Column:
    return crc_remainder(key, 3) == 1


def learn(corpus: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id") -> tuple[Lexicon, np.ndarray]:
    """(lexicon, curve) from the labelled rows of ``corpus`` outside the held-out fold."""
    return fit(training_sample(corpus, labels, "toxic", ~held_out("doc_id"), per_class, key))


def with_toxicity(docs: DataFrame, lexicon: Lexicon, curve: np.ndarray, text: str = "text", column: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score."""
    return docs.withColumn(column, score(F.coalesce(F.col(text), F.lit("")), lexicon, curve, docs.sparkSession))
