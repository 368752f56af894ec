import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalframe.llm import divergence as v
from evalframe.llm import registry
from llm_util import same


def brute(docs, least, top=50):
    rows = [tuple(x or "" for x in d) for d in docs]
    words = [(lang, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))) for lang, s, t in rows]
    df, groups = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for lang, s, w in words:
        df[lang].update(set(w))
        groups[lang][s].update(w)
    out = []
    for lang, by in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        total = {s: sum(c[t] for t in kept) for s, c in by.items()}
        p = lambda n, size: 1 + 10**9 * (n + 5) // (size + 5 * len(kept))
        for s, c in by.items():
            pair = [(sum(abs(p(c[t], total[s]) - p(by[o][t], total[o])) for t in kept), o) for o in by if o != s]
            over = [(p(c[t], total[s]) - p(sum(x[t] for x in by.values()), sum(total.values())), t) for t in kept if c[t]]
            for part, found in (("pair", pair), ("term", [x for x in over if x[0] > 0])):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, val, k + 1) for k, (val, i) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in ("Wa", "be", "ço", "漢", "zu") for b in "abcdefghij"]
    docs = []
    for k in range(400):
        lang = ("en", "de", None)[k % 3]
        source = f"s{min(int(rng.geometric(0.15)), 12)}"
        words = [vocabulary[min(int(x), 49)] for x in rng.geometric(0.08, rng.integers(0, 40))]
        docs.append((lang, source, "1".join(words)))
    return docs + [("en", None, None), ("en", "only digits", "12 34"), ("fr", "a", "rare words"), ("fr", "b", ""), ("fr", "Ä", None), ("lone", "x", "w"),
                   ("en", "s1", "Wa " * 5000), *[("de", "same", "be be ço")] * 3]


@pytest.mark.parametrize("terms,groups,columns", [(1024, 64, 2048), (6, 2, 5), (50, 3, 2048)])
def test_equals_brute_force(spark, monkeypatch, terms, groups, columns):
    for name, value in (("COLUMNS", columns), ("HELD", 40)):
        monkeypatch.setattr(v, name, value)
    plain = v.source_pairs
    monkeypatch.setattr(v, "source_pairs", lambda kept, g: plain(kept, g, terms, groups))
    df = spark.createDataFrame([(*d, "x", 1) for d in corpus()], "lang string, source string, text string, term string, n int")
    assert sorted(map(tuple, v.audit(df, least_docs=5, top_terms=7).collect())) == brute(corpus(), 5, 7)


def test_empty_table(spark):
    assert v.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_of_huge_counts(spark):
    row = spark.range(1).select(v.share(*[v.F.lit(x).cast("long") for x in (10**15, 10**16, 10**6)]).alias("a"), v.share(*[v.F.lit(x).cast("long") for x in (3, 7, 0)]).alias("b")).first()
    assert row.a == 1 + 10**9 * (10**15 + 5) // (10**16 + 5 * 10**6) and row.b == 0


def test_joint_tables_are_products_of_indicators():
    counts = np.array([[0, 2, 1], [1, 2, 0], [1, 0, 0]])
    x, price, starts = v.one_hot(counts, counts * 10)
    assert starts.tolist() == [0, 2, 4] and price.tolist() == [0, 10, 0, 20, 0, 10] and (x.sum(axis=1) == 3).all()
    assert (x.T @ x)[:2, 2:4].tolist() == [[0, 1], [1, 1]]
    assert v.distances(counts, counts * 10, np.array([1, 1, 4]), 3)[0].tolist() == [0, 20 + 10 + 40, 10 + 10 + 40]


def test_query_equals_sql(spark):
    rows = same(registry.queries()["op12_source_divergence"](spark, "/root/testdata/sf0.001"), registry.oracle_sql()["op12_source_divergence"])
    assert {x[2] for x in rows} >= {"pair"}
