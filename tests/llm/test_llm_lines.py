import random
import re

import pytest

from evalframe.llm import fuzzy_lines, line_quality, registry
from llm_util import SF, Union, duck, same, table, words


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return prev[-1]


def norm(line):
    return re.sub("[0-9]+", "0", " ".join(words(line))).lower()


def test_lines_equal_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, "documents").orderBy("doc_id").limit(25).collect()}
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix boxes of jam number"
    docs |= {1000 + k: f"{base} {k}\nshort {k}\n{base.replace('fox', 'f' + 'o' * (k % 5) + 'x')}\n" for k in range(30)}
    docs |= {2000: None, 2001: "", 2002: "\n\n", 2003: " \n a b \n", 2004: base.upper(), 2005: "é à ü ö\nE a U o"}
    df = spark.createDataFrame([(d, t, 3, "k") for d, t in docs.items()], "doc_id long, text string, line int, lost string").coalesce(2)
    got = fuzzy_lines.dedup_lines(df).collect()
    want = by_edits({d: t for d, t in docs.items() if t is not None}, lines_linked) | {2000: None}
    assert {r.doc_id: r.text for r in got} == want and sum(r.n_removed for r in got) > 60
    assert all((r.line, r.lost) == (3, "k") for r in got)


def test_simhash_is_the_majority_of_bits(spark):
    text = " ".join(f"word{k}" for k in range(9)) + "\n" + "a b c d"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for r in fuzzy_lines.line_profiles(df).collect():
        hashes = [x[0] & (2**64 - 1) for x in spark.createDataFrame([(w,) for w in norm(text.split("\n")[r.line]).split()], "w string").selectExpr("xxhash64(w)").collect()]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r.sig & (2**64 - 1) == want


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f")] * 2, "doc_id long, text string").coalesce(1)
    assert sorted(r.text for r in fuzzy_lines.dedup_lines(df).collect()) == ["", "a b c\nd e f"]
    assert fuzzy_lines.dedup_lines(df.limit(0)).count() == 0


def test_quality_query_matches_sql(spark):
    same(registry.queries()["op8_line_quality"](spark, SF), registry.oracle_sql()["op8_line_quality"])


def test_quality_edges_match_sql(spark, tmp_path):
    import pyarrow.parquet as pq

    own = lambda k: " ".join(chr(97 + (7 * k + j) % 26) * (1 + j % 9) + chr(97 + k % 26) + chr(97 + k // 26) for j in range(60))
    shared = " ".join(chr(97 + j % 26) * 3 + chr(97 + j // 26) for j in range(80))
    rows = [(k, f"{own(k)} {k} only here\n" + "Common 12 line of the host\n" * (k % 3), f"h{k % 2}", 1) for k in range(80)]
    rows += [(100 + k, "Common 7 line of the  HOST\n" * 30, "h0", 1) for k in range(3)]
    rows += [(200, None, None, 1), (201, "", "h0", 1), (202, " \t\n\x0b", "h1", 1), (203, "a b a b a b a b", "h1", 1), (204, "x y", "h1", 1),
             (205, "#*$%&|<> é z " * 30, None, 1), (206, "same same same " * 40, "h1", 1), (0, rows[0][1], "h0", 1)]
    rows += [(300 + k, "boiler plate of a host that comes again\n" * 1 + " ".join(f"b{j}" for j in range(k, k + 20)) + "\n" + " ".join(f"q{j}" for j in range(50)), "h2", 1) for k in range(40)]
    rows += [(400 + k, f"{shared}\nfew words of its own {chr(97 + k % 26)}{chr(97 + k // 26)}", "h3", 1) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lines int").coalesce(1)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = same(registry.queries()["op8_line_quality"](spark, str(tmp_path)), registry.oracle_sql()["op8_line_quality"], documents=pq.read_table(f"{tmp_path}/documents.parquet"))
    assert {r[-1] for r in got} == {True, False} and any(not r[-2] and not r[-1] for r in got)


def test_removing_frequent_lines(spark):
    rows = [(k, f"boiler 1\nown {k} line", "h", "c") for k in range(30)] + [(99, None, "h", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h string")
    frequent = line_quality.frequent_lines(line_quality.text_counts(df))
    assert [(r.host, r.n_docs) for r in frequent.collect()] == [("h", 30)] or frequent.count() == 2
    out = line_quality.remove_lines(df, frequent).collect()
    assert all("boiler" not in (r.text or "") for r in out) and {r.h for r in out} == {"c"} and len(out) == 31


@pytest.mark.parametrize("name", ["op7_fuzzy_lines", "op8_line_quality"])
def test_native_plans_run_no_python(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert duck("SELECT 1")[1] == [(1,)]


def by_edits(docs, linked):
    """{doc: text} by comparing all pairs of lines with ``linked(a, b)`` on their normal texts."""
    occ = [(d, i, norm(x)) for d, t in sorted(docs.items()) for i, x in enumerate(t.split("\n")) if words(x)]
    ids = sorted({t for *_, t in occ})
    u = Union(ids)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if linked(a, b):
                u.join(a, b)
    seen, lost = set(), set()
    for d, i, t in occ:
        if u.find(t) in seen:
            lost.add((d, i))
        seen.add(u.find(t))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in lost) for d, t in docs.items()}


def word_linked(a, b, edit=0.85):
    p, q = a.split(), b.split()
    limit = int((1 - edit) * max(len(p), len(q)) + 1e-9)
    return abs(len(p) - len(q)) <= limit and distance(p, q) <= limit


def lines_linked(a, b):
    """Near in words, or in characters if both are short; one or two words match exactly only."""
    if min(len(a.split()), len(b.split())) < 3:
        return False
    short = all(len(x.split()) <= 8 for x in (a, b))
    limit = int(0.15 * max(len(a), len(b)) + 1e-9)
    return word_linked(a, b) or short and abs(len(a) - len(b)) <= limit and distance(a, b) <= limit


def test_pairs_at_the_threshold_are_all_found(spark):
    """Near copies with as many edited words as the threshold allows (SimHashes far apart), and one word more."""
    rng, docs = random.Random(3), {}
    for k in range(60):
        n = rng.choice((9, 13, 14, 20, 40, 41, 200))
        line = [f"{rng.choice('abcdefg')}{rng.choice('xyz')}{rng.choice('mnopq')}" for _ in range(n)]
        copy, d = list(line), int(0.15 * n + 1e-9) + k % 5 // 4
        for i in sorted(rng.sample(range(n), d), reverse=True):
            kind = rng.randrange(3)
            copy[i:i + 1] = [["new" + chr(97 + i % 26)], [], [copy[i], "more"]][kind]
        docs |= {2 * k: " ".join(line), 2 * k + 1: " ".join(copy)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(2)
    want = by_edits(docs, word_linked)
    assert sum(not t for t in want.values()) > 40
    assert {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(df).collect()} == want


def test_short_lines_are_compared_by_characters(spark):
    rng = random.Random(4)
    lines = ["Sign up for our newsletter today", "Sign up for our newsletters today", "Sign up for our news letter today",
             "sign up for her newspaper soon", "a b c d", "a b c e", "a b cd e", "read more of it", "read more of lt", "“read more of it”"]
    for _ in range(40):
        line = " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(3, 10)))
        copy = list(line)
        for i in rng.sample([i for i, c in enumerate(line) if c != " "], rng.randrange(1, 2 + int(0.15 * len(line)))):
            copy[i] = rng.choice(["", "x", copy[i] + "y"])
        lines += [line, "".join(copy)]
    docs = dict(enumerate(lines))

    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(2)
    want = by_edits(docs, lines_linked)
    assert want[1] == want[2] == "" and 20 < sum(not t for t in want.values()) < 45
    assert {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(df).collect()} == want


def test_lines_of_any_length(spark):
    """Lines below and above the SimHash's word counts, and one without blanks."""
    rng = random.Random(5)
    long = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(17_000)]
    near, far = list(long), list(long)
    near[::8], far[::5] = ["new"] * len(near[::8]), ["other"] * len(far[::5])
    chinese = "我们都是好人" * 40
    lines = ["Les.", "LES.", "Lea.", "two words", "two  words", chinese, chinese, " ".join(long), " ".join(near), " ".join(far), " "]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(2)
    gone = {r.doc_id for r in fuzzy_lines.dedup_lines(df).collect() if r.n_removed}
    assert gone == {1, 4, 6, 8}


def test_posts_are_shuffled_once(spark, monkeypatch):
    """Both sides of the semi-join of each kind of posts read one shuffle."""
    from evalframe.llm import linking

    plans, write = [], linking.materialize

    def kept(df, name):
        if name == "posts":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(linking, "materialize", kept)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(k, f"one line of ten words that comes again and again {chr(97 + k)}") for k in range(4)], "doc_id long, text string").coalesce(2)
        assert sum(r.n_removed for r in fuzzy_lines.dedup_lines(df).collect()) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plans[0].count("LeftSemi") == plans[0].count("ReusedExchange") == 3


def test_lines_of_a_block_need_near_words(spark):
    """Lines of equal SimHashes are no candidates if more words differ than the edits allowed can change."""
    both = [f"{p}_{b}" for p in "xy" for b in (*fuzzy_lines.BITS, "mk")]
    mk = 20 << 2  # twenty words: three edits
    rows = [(5, 0, 0b111, 0, mk, 5, 0b111, 0, 0, mk), (5, 0, 0b1111, 0, mk, 5, 0, 0, 0, mk), (5, 0, 0, 0, mk, 5, 0, 0, 0b1111, mk),
            (5, 7, 7, 7, mk, 0xFFF5, 7, 7, 7, mk), (5, 7, 7, 7, mk, 5, 7, 7, 7, 16 << 2)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c.endswith('mk') else 'long'}" for c in both))
    got = df.select(fuzzy_lines.near_lines("x", "y", 8, 0.85).alias("near")).collect()
    assert [r.near for r in got] == [True, False, False, False, False]


def test_posts_are_joined_by_a_merge(spark, monkeypatch):
    """Lines under their SimHash blocks are many rows of a small file: Spark would send them to the driver, and to every task."""
    from evalframe.llm import linking

    plans, write = [], linking.materialize

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString() if name == "posts" else "")
        return write(df, name)

    monkeypatch.setattr(linking, "materialize", kept)
    df = spark.createDataFrame([(k, f"one line of ten words that comes again and again {chr(97 + k)}") for k in range(4)], "doc_id long, text string").coalesce(2)
    assert sum(r.n_removed for r in fuzzy_lines.dedup_lines(df).collect()) == 3
    met = [p for p in plans if "LeftSemi" in p]
    assert met[0].count("SortMergeJoin") == 3 and "BroadcastExchange" not in met[0]


def test_normal_lines_are_their_words(spark):
    rows = [" a  b\t\tC 12\x0b", "\t\r", "", "x\x0c y 1a22 \x0b\x0c Z", "É  ß  007", "one two", "  lead", "trail \t"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k long, t string")
    assert [r.n for r in df.select("k", fuzzy_lines.normal("t").alias("n")).orderBy("k").collect()] == [norm(t) for t in rows]
    lines = fuzzy_lines.line_profiles(df.withColumnRenamed("k", "doc_id"), text="t", min_words=1).collect()
    assert sorted((r.doc_id, r.n_words) for r in lines) == [(k, len(words(t))) for k, t in enumerate(rows) if words(t)]
