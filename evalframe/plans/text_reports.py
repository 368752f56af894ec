"""Text reports: ROUGE-1, key-rewrite joins, word counts, initials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions.text import initials as initials_fn
from evalframe.functions.text import word_count
from evalframe.operators import checks, ranking
from evalframe.operators.pairing import consecutive_turns, translation_triples
from evalframe.operators.rouge import rouge1, rouge1_many, rouge1_pairs_of
from evalframe.plans.catalog import register
from evalframe.sources.tables import read_table, v_translations, v_workflow

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]
BOX = ["p_min", "p_q1", "p_median", "p_q3", "p_max"]


def _rouge_sql(pairs_cte: str) -> str:
    """DuckDB ROUGE-1 over a CTE ``pairs(pair_id, a, b)``: exploded multiset overlap."""
    return f"""pairs AS ({pairs_cte}),
ta AS (SELECT pair_id, unnest(regexp_extract_all(a, '\\S+')) AS w FROM pairs),
tb AS (SELECT pair_id, unnest(regexp_extract_all(b, '\\S+')) AS w FROM pairs),
ca AS (SELECT pair_id, w, COUNT(*) AS c FROM ta GROUP BY ALL),
cb AS (SELECT pair_id, w, COUNT(*) AS c FROM tb GROUP BY ALL),
ov AS (SELECT ca.pair_id, SUM(least(ca.c, cb.c)) AS o FROM ca JOIN cb ON ca.pair_id = cb.pair_id AND ca.w = cb.w GROUP BY ALL),
la AS (SELECT pair_id, SUM(c) AS n FROM ca GROUP BY ALL),
lb AS (SELECT pair_id, SUM(c) AS n FROM cb GROUP BY ALL),
rouge AS (
  SELECT p.pair_id, CAST(coalesce(la.n, 0) AS BIGINT) AS len_a, CAST(coalesce(lb.n, 0) AS BIGINT) AS len_b,
    CAST(coalesce(ov.o, 0) AS BIGINT) AS overlap,
    CASE WHEN coalesce(la.n, 0) = 0 OR coalesce(lb.n, 0) = 0 OR coalesce(ov.o, 0) = 0 THEN 0.0
      ELSE 2 * ((ov.o * 1.0 / la.n) * (ov.o * 1.0 / lb.n)) / ((ov.o * 1.0 / la.n) + (ov.o * 1.0 / lb.n)) END AS rouge1
  FROM pairs p LEFT JOIN la USING (pair_id) LEFT JOIN lb USING (pair_id) LEFT JOIN ov USING (pair_id))"""


CONV_PAIRS_SQL = """SELECT CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR) AS pair_id, u.text AS a, r.text AS b
  FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1
  WHERE u.role = 'user' AND r.role = 'assistant'"""


@register("rouge1_pairs", f"""
WITH {_rouge_sql(CONV_PAIRS_SQL)}
SELECT pair_id, len_a, len_b, overlap, round(rouge1, 6) AS rouge1 FROM rouge
""")
def rouge1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1 between each user turn and the assistant reply that follows it (whole texts).

    Turns are paired by one aggregate on (conv_id, pair turn); the ROUGE job
    reuses that clustering, so the texts are shuffled exactly once."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = consecutive_turns(c)
    r = rouge1(pairs, ["conv_id", "turn"], "a", "b", partition=False)
    return r.select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("pair_id"),
                    "len_a", "len_b", "overlap", "rouge1")


def _translation_pairs(spark: SparkSession, sf_dir: str, raise_on: tuple[str, ...] = ()) -> DataFrame:
    """Each human (non-English) row with its English original and its machine translation —
    the source's id rewrite (``-{lang}-`` → ``-en-`` / ``-gt-{lang}-``) as one grouping pass."""
    return translation_triples(v_translations(spark, sf_dir), raise_on=raise_on)


TRANSLATION_PAIRS_SQL = """h AS (
  SELECT question_id, target_lang, benchmark, question,
    replace(question_id, '-' || target_lang || '-', '-en-') AS en_key,
    replace(question_id, '-' || target_lang || '-', '-gt-' || target_lang || '-') AS mt_key
  FROM v_translations WHERE contains(approach, 'Human') AND target_lang <> 'en'),
en AS (SELECT question_id AS en_id, question AS en_text FROM v_translations WHERE contains(approach, 'Human') AND target_lang = 'en'),
mt AS (SELECT question_id AS mt_id, question AS mt_text FROM v_translations WHERE contains(question_id, '-gt-') AND target_lang <> 'en'),
tp AS (SELECT h.*, en.en_id, en.en_text, mt.mt_id, mt.mt_text FROM h LEFT JOIN en ON h.en_key = en.en_id LEFT JOIN mt ON h.mt_key = mt.mt_id)"""


@register("join_key_rewrite", f"""
WITH {TRANSLATION_PAIRS_SQL}
SELECT question_id, en_key, mt_key, COUNT(DISTINCT en_id) AS n_en, COUNT(DISTINCT mt_id) AS n_mt,
  CASE WHEN COUNT(DISTINCT en_id) = 1 AND COUNT(DISTINCT mt_id) = 1 THEN 'ok' ELSE 'missing' END AS status
FROM tp GROUP BY question_id, en_key, mt_key
""")
def join_key_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten keys of every human row and the exactly-one check (n_en, n_mt must be 1)."""
    p = _translation_pairs(spark, sf_dir)
    tag = F.concat(F.lit("-"), F.col("target_lang"), F.lit("-"))
    return p.select("question_id", F.replace("question_id", tag, F.lit("-en-")).alias("en_key"),
                    F.replace("question_id", tag, F.concat(F.lit("-gt-"), F.col("target_lang"), F.lit("-"))).alias("mt_key"),
                    "n_en", "n_mt", "status")


def _box(scores: DataFrame, group_cols: list[str], value: str, tie: str) -> DataFrame:
    """Exact five-number summary per group via skew-safe ranking (no group held in one task)."""
    q = ranking.exact_quantiles(scores, group_cols, value, PROBS, tie=tie)
    wide = q.groupBy(*group_cols, "n").pivot("qi", list(range(len(PROBS)))).agg(F.first("q"))
    return wide.select(*group_cols, "n", *[F.col(str(i)).alias(b) for i, b in enumerate(BOX)])


def _box_sql(src: str, group_cols: str, value: str) -> str:
    return f"""SELECT {group_cols}, COUNT(*) AS n,
  {", ".join(f"round(quantile_cont({value}, {p}), 6) AS {b}" for p, b in zip(PROBS, BOX))}
FROM {src} GROUP BY {group_cols}"""


def _translation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human text scored against its MT and its English original in one tokenisation pass."""
    p = _translation_pairs(spark, sf_dir, raise_on=(checks.REPEATED,)).filter(F.col("status") == checks.OK)  # items without a partner are left out
    ids = ["canon", "target_lang"]  # clustered by canon since the pairing aggregate: no new exchange for texts
    r = rouge1_many(p, ids, "question", ["mt_text", "en_text"], partition=False)
    meta = p.select(*ids, "question_id", "benchmark")  # id columns only, joined after the word counts
    r = r.join(meta, ids)
    long = r.select("question_id", "target_lang", "benchmark", F.explode(F.array(
        F.struct(F.lit("vs_machine_translation").alias("measure"), F.col("rouge1_mt_text").alias("rouge1")),
        F.struct(F.lit("vs_original_english").alias("measure"), F.col("rouge1_en_text").alias("rouge1")))).alias("m"))
    return long.select("question_id", "target_lang", "benchmark", "m.measure", "m.rouge1")


TRANSLATION_SCORES_SQL = f"""{TRANSLATION_PAIRS_SQL},
{_rouge_sql("SELECT question_id || '|m' AS pair_id, question AS a, mt_text AS b FROM tp WHERE en_id IS NOT NULL AND mt_id IS NOT NULL UNION ALL SELECT question_id || '|e', question, en_text FROM tp WHERE en_id IS NOT NULL AND mt_id IS NOT NULL")},
scores AS (
  SELECT tp.question_id, tp.target_lang, tp.benchmark, CASE WHEN right(r.pair_id, 1) = 'm' THEN 'vs_machine_translation' ELSE 'vs_original_english' END AS measure, r.rouge1
  FROM rouge r JOIN tp ON tp.question_id = left(r.pair_id, length(r.pair_id) - 2))"""


@register("rouge_by_language", f"""
WITH {TRANSLATION_SCORES_SQL}
{_box_sql('scores', 'target_lang, measure', 'rouge1')}
""")
def rouge_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-RG1: ROUGE-1 of human translations vs machine translation and vs the English original, by language."""
    s = _translation_scores(spark, sf_dir)
    return _box(s, ["target_lang", "measure"], "rouge1", "question_id")


@register("rouge_by_benchmark", f"""
WITH {TRANSLATION_SCORES_SQL}
{_box_sql('scores', 'target_lang, benchmark, measure', 'rouge1')}
""")
def rouge_by_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-RG1: the same distributions by language and benchmark."""
    return _box(_translation_scores(spark, sf_dir), ["target_lang", "benchmark", "measure"], "rouge1", "question_id")


WORKFLOW_KEY_SQL = """CASE WHEN wkey % 3 = 1 THEN concat('q-', CASE CAST(FLOOR(wkey / 3) AS BIGINT) % 3 WHEN 0 THEN 'af' WHEN 1 THEN 'zu' ELSE 'xh' END, '-',
    CAST(CAST(FLOOR(wkey / 3) AS BIGINT) AS VARCHAR)) END"""


def _workflow_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow rows of human translations, under the id their question has among the translations."""
    item = F.floor(F.col("wkey") / 3)
    lang = F.when(item % 3 == 0, "af").when(item % 3 == 1, "zu").otherwise("xh")
    w = v_workflow(spark, sf_dir).filter(F.col("wkey") % 3 == 1)
    return w.withColumn("question_id", F.concat(F.lit("q-"), lang, F.lit("-"), item.cast("string")))


@register("rouge_by_translator", f"""
WITH {TRANSLATION_SCORES_SQL},
w AS (SELECT {WORKFLOW_KEY_SQL} AS question_id, CASE WHEN regexp_matches(translator, '^\\D+\\d+$')
        THEN regexp_extract(translator, '^(\\D+)(\\d+)$', 1) || '.' || regexp_extract(translator, '^(\\D+)(\\d+)$', 2) || '.' ELSE 'unknown' END AS translator FROM v_workflow),
t AS (SELECT coalesce(w.translator, 'unknown') AS translator, s.measure, s.rouge1 FROM scores s LEFT JOIN w ON w.question_id = s.question_id)
{_box_sql('t', 'translator, measure', 'rouge1')}
""")
def rouge_by_translator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-RG3: the same ROUGE-1 distributions by translator: looked up by key in the workflow (J5), named by initials (F8),
    ``unknown`` where the workflow has no name."""
    s = _translation_scores(spark, sf_dir)
    name = F.regexp_replace("translator", r"^(\D+)(\d+)$", "$1-$2")
    w = _workflow_by_question(spark, sf_dir).select("question_id", initials_fn(name).alias("translator"))
    t = s.join(w, "question_id", "left").na.fill({"translator": "unknown"})
    return _box(t, ["translator", "measure"], "rouge1", "question_id")


@register("rouge_before_after", f"""
WITH {TRANSLATION_PAIRS_SQL},
w AS (SELECT {WORKFLOW_KEY_SQL} AS question_id, initial_text, coalesce(correction, initial_text) AS final_text FROM v_workflow),
x AS (SELECT tp.question_id, tp.target_lang, w.initial_text, w.final_text, tp.mt_text, tp.en_text FROM tp JOIN w ON w.question_id = tp.question_id
      WHERE tp.en_id IS NOT NULL AND tp.mt_id IS NOT NULL),
{_rouge_sql("SELECT question_id || '|bm' AS pair_id, initial_text AS a, mt_text AS b FROM x UNION ALL SELECT question_id || '|am', final_text, mt_text FROM x UNION ALL SELECT question_id || '|be', initial_text, en_text FROM x UNION ALL SELECT question_id || '|ae', final_text, en_text FROM x")},
s AS (SELECT x.target_lang, CASE WHEN substr(right(r.pair_id, 2), 1, 1) = 'b' THEN 'before' ELSE 'after' END AS round,
        CASE WHEN right(r.pair_id, 1) = 'm' THEN 'vs_machine_translation' ELSE 'vs_original_english' END AS measure, r.rouge1
      FROM rouge r JOIN x ON x.question_id = left(r.pair_id, length(r.pair_id) - 3))
{_box_sql('s', 'target_lang, round, measure', 'rouge1')}
""")
def rouge_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-RG2: translations before and after the verifier's correction, each against the machine translation and the English
    original, by language. All texts of a row are scored in one pass; only scores leave it."""
    p = _translation_pairs(spark, sf_dir, raise_on=(checks.REPEATED,)).filter(F.col("status") == checks.OK)
    w = _workflow_by_question(spark, sf_dir).select("question_id", "initial_text", F.coalesce("correction", "initial_text").alias("final_text"))
    x = p.select("question_id", "target_lang", "mt_text", "en_text").join(w, "question_id")
    ids = ["question_id", "target_lang"]
    kinds = [(r, text, m, other) for r, text in (("before", "initial_text"), ("after", "final_text"))
             for m, other in (("vs_machine_translation", "mt_text"), ("vs_original_english", "en_text"))]
    r = rouge1_pairs_of(x, ids, [(text, other) for _, text, _, other in kinds])
    long = r.select(*ids, F.explode(F.array(*[
        F.struct(F.lit(name).alias("round"), F.lit(m).alias("measure"), F.col(f"rouge1_{k}").alias("rouge1"))
        for k, (name, _, m, _) in enumerate(kinds)])).alias("m")).select("question_id", "target_lang", "m.*")
    return _box(long, ["target_lang", "round", "measure"], "rouge1", "question_id")


WORKFLOW_PAIRS_SQL = "SELECT CAST(wkey AS VARCHAR) AS pair_id, initial_text AS a, correction AS b FROM v_workflow WHERE correction IS NOT NULL"


@register("rouge_by_round", f"""
WITH {_rouge_sql(WORKFLOW_PAIRS_SQL)},
scores AS (SELECT w.lang, r.rouge1 FROM rouge r JOIN v_workflow w ON CAST(w.wkey AS VARCHAR) = r.pair_id)
{_box_sql('scores', 'lang', 'rouge1')}
""")
def rouge_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-RG2: ROUGE-1 between the initial translation and its verified correction, by language."""
    w = v_workflow(spark, sf_dir).filter(F.col("correction").isNotNull())
    pairs = w.select(F.col("wkey").cast("string").alias("pair_id"), F.col("initial_text").alias("a"),
                     F.col("correction").alias("b"))
    r = rouge1(pairs, "pair_id", "a", "b")
    s = r.join(w.select(F.col("wkey").cast("string").alias("pair_id"), "lang"), "pair_id")
    return _box(s, ["lang"], "rouge1", "pair_id")


WC_SQL = r"length(regexp_replace(regexp_replace(text, '\S+', 'x', 'g'), '\s+', '', 'g'))"


@register("word_count_rollup", f"""
SELECT lang, source, CAST(SUM(coalesce({WC_SQL}, 0)) AS BIGINT) AS words, COUNT(*) AS n_docs
FROM documents GROUP BY ROLLUP (lang, source)
""")
def word_count_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7 / AG12 / A-WC: whitespace words per (language, source) with subtotals and the grand total (rollup)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return d.rollup("lang", "source").agg(F.sum(word_count("text")).alias("words"), F.count(F.lit(1)).alias("n_docs"))


@register("initials", """
SELECT o_orderkey, CASE WHEN len(string_split(o_orderpriority, '-')) >= 2
  THEN string_split(o_orderpriority, '-')[1] || '.' || string_split(o_orderpriority, '-')[2] || '.' END AS initials
FROM orders
""")
def initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: initials of hyphenated names ("4-NOT SPECIFIED" → "4.NOT SPECIFIED.")."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return o.select("o_orderkey", initials_fn("o_orderpriority").alias("initials"))
