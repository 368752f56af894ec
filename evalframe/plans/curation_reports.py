"""Curation jobs: request tables, ratings → tertile buckets, samples, training sets
(SURVEY M6: W1–W4, SP1–SP6, ST6–ST8, F9, F11, F12, J11, J12, U1, PF6, PF10, SNK4, SNK5, A-REQ, A-RAT, A-BUK, A-FT)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe import dims
from evalframe.functions import prompts as pr
from evalframe.operators import curation as cu
from evalframe.operators import gains as g
from evalframe.operators import ranking
from evalframe.operators.pairing import consecutive_turns
from evalframe.plans.accuracy_reports import cells as acc_cells
from evalframe.plans.catalog import register
from evalframe.sources import files, json_objects
from evalframe.sources.tables import read_table, v_items, v_ratings

SEED = 42
BASE = dims.FIXTURE_BASELINE_MODEL


def q(s: str) -> str:
    """SQL string literal (newlines kept, quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def printf(template: str, *args: str) -> str:
    return f"printf({q(template)}, {', '.join(args)})"


# --- item views ------------------------------------------------------------------
ITEM_KEY = ["lang", "split", "item_no"]


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense position of each item inside its (language, split) file, by item order: keys and position only."""
    items = v_items(spark, sf_dir).select(*ITEM_KEY)
    return ranking.positions(items, ["lang", "split"], ["item_no"], pos_col="position").select(*ITEM_KEY, "position")


#: Input sets of the request tables (A-REQ): human texts, their machine translations, and those translated back to English. The latter two
#: have no English part, and keep the language the items came from in their ids.
INPUTS = ["human", "mt", "bt"]


def _input_items(spark: SparkSession, sf_dir: str, source: str = "human") -> DataFrame:
    """Items of an input set; on the fixture the machine's texts are the human ones with a mark."""
    items = v_items(spark, sf_dir)
    if source == "human":
        return items
    marked = [F.concat(F.lit(f"{source} "), F.col(c)).alias(c) if c in ("question", "opt_a", "opt_b") else F.col(c) for c in items.columns]
    return items.filter(F.col("lang") != "en").select(*marked)


def _positioned(spark: SparkSession, sf_dir: str, source: str = "human", pos: DataFrame | None = None) -> DataFrame:
    """Whole items with their positions, met by key after the ranking."""
    pos = pos if pos is not None else _positions(spark, sf_dir)
    return _input_items(spark, sf_dir, source).join(pos, ITEM_KEY)


POS_SQL = """pos AS (SELECT *, row_number() OVER (PARTITION BY lang, split ORDER BY item_no) - 1 AS position FROM v_items)"""


@register("position_index", f"WITH {POS_SQL} SELECT item_no, lang, split, position FROM pos")
def position_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sort_values().reset_index`` per (language, split) — same position = same item across languages."""
    return _positions(spark, sf_dir).select("item_no", "lang", "split", "position")


@register("union_splits", """
SELECT lang, split, COUNT(*) AS n_rows FROM (
  SELECT lang, 'dev' AS split FROM v_items WHERE split = 'dev'
  UNION ALL SELECT lang, 'test' FROM v_items WHERE split = 'test'
  UNION ALL SELECT lang, 'val' FROM v_items WHERE split = 'val') GROUP BY ALL
""")
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union-all of the per-split frames, each tagged with a literal split column."""
    items = v_items(spark, sf_dir)
    parts = [items.filter(F.col("split") == s).select("lang", F.lit(s).alias("split")) for s in dims.MMLU_SPLITS]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("tag_split_index", f"""
WITH {POS_SQL}
SELECT lang, split, item_no, position AS index_value, 'mmlu-college_medicine-' || split || '-' || CAST(position AS VARCHAR) AS row_key
FROM pos
""")
def tag_split_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF10: literal split tag plus 0-based index inside each split file; the pair keys a training row."""
    p = _positions(spark, sf_dir)
    return p.select("lang", "split", "item_no", F.col("position").alias("index_value"),
                    F.concat(F.lit("mmlu-college_medicine-"), "split", F.lit("-"),
                             F.col("position").cast("string")).alias("row_key"))


# --- W4 / F9: multiple-choice 5-shot ------------------------------------------
def _topic(section: str = "section"):
    return F.replace(F.col(section), F.lit("_"), F.lit(" "))


def _mc_blocks(spark: SparkSession, sf_dir: str, source: str = "human") -> DataFrame:
    dev = _input_items(spark, sf_dir, source).filter(F.col("split") == "dev")
    shot = pr.fmt(pr.MC_SHOT, F.col("shot_no").cast("string"), "question", "opt_a", "opt_b", "opt_c", "opt_d", "answer")
    return cu.few_shot_blocks(dev, ["section", "lang"], ["item_no"], shot)


MC_BLOCK_SQL = f"""dev AS (
  SELECT *, row_number() OVER (PARTITION BY section, lang ORDER BY item_no) AS shot_no FROM v_items WHERE split = 'dev'),
blocks AS (
  SELECT section, lang, string_agg({printf(pr.MC_SHOT, 'CAST(shot_no AS VARCHAR)', 'question', 'opt_a', 'opt_b', 'opt_c', 'opt_d', 'answer')}, '' ORDER BY shot_no) AS block,
    COUNT(*) AS n_shots FROM dev WHERE shot_no <= 5 GROUP BY section, lang)"""


@register("few_shot_block", f"WITH {MC_BLOCK_SQL} SELECT section, lang, block, n_shots FROM blocks")
def few_shot_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five dev rows per (section, language) rendered as the 5-shot block; shorter groups tell their number."""
    return _mc_blocks(spark, sf_dir)


def _mc_requests(spark: SparkSession, sf_dir: str, pos: DataFrame | None = None, source: str = "human") -> DataFrame:
    test = _positioned(spark, sf_dir, source, pos).filter(F.col("split") == "test")
    blocks = _mc_blocks(spark, sf_dir, source)
    j = cu.with_block(test, blocks, ["section", "lang"])
    content = F.concat(pr.fmt(pr.MC_HEADER, _topic()), F.col("block"),
                       pr.fmt(pr.MC_QUESTION, "question", "opt_a", "opt_b", "opt_c", "opt_d"))
    cid = F.concat(F.lit(pr.MODEL_PLACEHOLDER + "-on-"), "lang", F.lit("-mmlu-"), "section", F.lit("-"),
                   F.col("position").cast("string"), F.lit("-answer-"), "answer")
    return j.select(cid.alias("custom_id"), content.alias("content"), "status")


MC_REQ_SQL = f"""{POS_SQL},
{MC_BLOCK_SQL},
mc AS (
  SELECT '{pr.MODEL_PLACEHOLDER}-on-' || p.lang || '-mmlu-' || p.section || '-' || CAST(p.position AS VARCHAR) || '-answer-' || p.answer AS custom_id,
    {printf(pr.MC_HEADER, "replace(p.section, '_', ' ')")} || coalesce(b.block, '') || {printf(pr.MC_QUESTION, 'p.question', 'p.opt_a', 'p.opt_b', 'p.opt_c', 'p.opt_d')} AS content,
    CASE WHEN coalesce(b.n_shots, 0) < 5 THEN 'short' ELSE 'ok' END AS status
  FROM pos p LEFT JOIN blocks b ON p.section = b.section AND p.lang = b.lang WHERE p.split = 'test')"""


@register("render_prompt_mc", f"WITH {MC_REQ_SQL} SELECT custom_id, content, status FROM mc")
def render_prompt_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MMLU-style 5-shot prompt for every test item, id carries language, section, index and gold letter."""
    return _mc_requests(spark, sf_dir)


# --- SP1 / PF6 / F9: cloze 5-shot with a fixed sampled dev set ---------------
def _cloze_answer():
    return (F.col("item_no") % 2 + 1).cast("string")


def _sampled_dev_positions(spark: SparkSession, sf_dir: str, pos: DataFrame | None = None) -> DataFrame:
    """SP1: five English dev items by md5 order; their positions are reused in every language."""
    pos = pos if pos is not None else _positions(spark, sf_dir)
    dev_en = pos.filter((F.col("split") == "dev") & (F.col("lang") == "en"))
    keyed = dev_en.withColumn("h", cu.md5_key(SEED, "item_no"))
    return ranking.top_k(keyed, [], ["h", "item_no"], 5, rank_col="sample_rank").select(
        "item_no", "position", "sample_rank")


SAMPLE_SQL = f"""{POS_SQL},
smp AS (
  SELECT item_no, position, row_number() OVER (ORDER BY md5('{SEED}-' || CAST(item_no AS VARCHAR)), item_no) AS sample_rank
  FROM pos WHERE split = 'dev' AND lang = 'en' QUALIFY sample_rank <= 5)"""


@register("sample_fixed_ids", f"WITH {SAMPLE_SQL} SELECT item_no, position, sample_rank FROM smp")
def sample_fixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP1: fixed-n (5) deterministic sample of the English dev split."""
    return _sampled_dev_positions(spark, sf_dir)


@register("semi_dev_pool", f"""
WITH {SAMPLE_SQL}
SELECT p.item_no, p.lang, p.position FROM pos p WHERE p.split = 'dev' AND p.position IN (SELECT position FROM smp)
""")
def semi_dev_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF6: dev rows of every language whose position is in the sampled set (left-semi join, not a Python set)."""
    pos = _positions(spark, sf_dir)
    dev = pos.filter(F.col("split") == "dev")
    return dev.join(_sampled_dev_positions(spark, sf_dir, pos).select("position"), "position", "left_semi") \
        .select("item_no", "lang", "position")


def _cloze_requests(spark: SparkSession, sf_dir: str, pos: DataFrame | None = None, source: str = "human") -> DataFrame:
    pos = pos if pos is not None else _positions(spark, sf_dir)
    items = _positioned(spark, sf_dir, source, pos)
    dev = items.filter(F.col("split") == "dev").join(
        _sampled_dev_positions(spark, sf_dir, pos).select("position"), "position", "left_semi")  # sampled from the human English items
    shot = pr.fmt(pr.CLOZE_SHOT, F.col("shot_no").cast("string"), "question", "opt_a", "opt_b", _cloze_answer())
    blocks = cu.few_shot_blocks(dev, ["lang"], ["item_no"], shot)
    test = cu.with_block(items.filter(F.col("split") == "test"), blocks, ["lang"])
    content = F.concat(F.lit(pr.CLOZE_HEADER), F.col("block"), pr.fmt(pr.CLOZE_QUESTION, "question", "opt_a", "opt_b"))
    cid = F.concat(F.lit(pr.MODEL_PLACEHOLDER + "-on-"), "lang", F.lit("-winogrande-"),
                   F.col("position").cast("string"), F.lit("-answer-"), _cloze_answer())
    return test.select(cid.alias("custom_id"), content.alias("content"), "status")


CLOZE_REQ_SQL = f"""{SAMPLE_SQL},
cdev AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY item_no) AS shot_no
  FROM pos WHERE split = 'dev' AND position IN (SELECT position FROM smp)),
cblocks AS (
  SELECT lang, string_agg({printf(pr.CLOZE_SHOT, 'CAST(shot_no AS VARCHAR)', 'question', 'opt_a', 'opt_b', 'CAST(item_no % 2 + 1 AS VARCHAR)')}, '' ORDER BY shot_no) AS block,
    COUNT(*) AS n_shots FROM cdev WHERE shot_no <= 5 GROUP BY lang),
cloze AS (
  SELECT '{pr.MODEL_PLACEHOLDER}-on-' || p.lang || '-winogrande-' || CAST(p.position AS VARCHAR) || '-answer-' || CAST(p.item_no % 2 + 1 AS VARCHAR) AS custom_id,
    {q(pr.CLOZE_HEADER)} || coalesce(b.block, '') || {printf(pr.CLOZE_QUESTION, 'p.question', 'p.opt_a', 'p.opt_b')} AS content,
    CASE WHEN coalesce(b.n_shots, 0) < 5 THEN 'short' ELSE 'ok' END AS status
  FROM pos p LEFT JOIN cblocks b ON p.lang = b.lang WHERE p.split = 'test')"""


@register("render_prompt_cloze", f"WITH {CLOZE_REQ_SQL} SELECT custom_id, content, status FROM cloze")
def render_prompt_cloze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winogrande-style 5-shot prompt; the same sampled dev items (by position) in every language."""
    return _cloze_requests(spark, sf_dir)


def _passage_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.positions(v_items(spark, sf_dir).select("lang", "item_no"), ["lang"], ["item_no"], pos_col="position").select("lang", "item_no", "position")


def _passage_requests(spark: SparkSession, sf_dir: str, pos: DataFrame | None = None, source: str = "human") -> DataFrame:
    pos = pos if pos is not None else _passage_positions(spark, sf_dir)
    items = _input_items(spark, sf_dir, source).join(pos, ["lang", "item_no"])
    content = pr.fmt(pr.PASSAGE_PROMPT, "question", "section", "opt_a", "opt_b", "opt_c", "opt_d")
    cid = F.concat(F.lit(pr.MODEL_PLACEHOLDER + "-on-"), "lang", F.lit("-belebele-"),
                   F.col("position").cast("string"), F.lit("-answer-"), "answer")
    return items.select(cid.alias("custom_id"), content.alias("content"), F.lit("ok").alias("status"))


PASSAGE_REQ_SQL = f"""passage AS (
  SELECT '{pr.MODEL_PLACEHOLDER}-on-' || lang || '-belebele-' || CAST(row_number() OVER (PARTITION BY lang ORDER BY item_no) - 1 AS VARCHAR) || '-answer-' || answer AS custom_id,
    {printf(pr.PASSAGE_PROMPT, 'question', 'section', 'opt_a', 'opt_b', 'opt_c', 'opt_d')} AS content, 'ok' AS status
  FROM v_items)"""


@register("render_prompt_passage", f"WITH {PASSAGE_REQ_SQL} SELECT custom_id, content, status FROM passage")
def render_prompt_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Belebele-style zero-shot passage prompt (passage = item text, query = section)."""
    return _passage_requests(spark, sf_dir)


def _body_json(model: str = pr.MODEL_PLACEHOLDER) -> str:
    return (f"CAST(to_json({{'model': '{model}', 'messages': [{{'role': 'user', 'content': content}}], "
            f"'max_tokens': {pr.MAX_TOKENS}, 'temperature': CAST({pr.TEMPERATURE} AS DOUBLE), 'top_p': CAST({pr.TOP_P} AS DOUBLE)}}) AS VARCHAR)")


@register("build_eval_requests", f"""
WITH {MC_REQ_SQL},
{CLOZE_REQ_SQL.replace(POS_SQL + ',', '', 1)},
{PASSAGE_REQ_SQL},
allreq AS (SELECT * FROM mc UNION ALL SELECT * FROM cloze UNION ALL SELECT * FROM passage)
SELECT custom_id, 'POST' AS method, '/v1/chat/completions' AS url, {_body_json()} AS body, status FROM allreq
""")
def build_eval_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-REQ: the full evaluation request table (5-shot MC, 5-shot cloze, 0-shot passage) in batch-API shape."""
    return _as_batch(_all_requests(spark, sf_dir, "human", _positions(spark, sf_dir), _passage_positions(spark, sf_dir)))


def _all_requests(spark: SparkSession, sf_dir: str, source: str, pos: DataFrame, passage_pos: DataFrame) -> DataFrame:
    return (_mc_requests(spark, sf_dir, pos, source).unionByName(_cloze_requests(spark, sf_dir, pos, source))
            .unionByName(_passage_requests(spark, sf_dir, passage_pos, source)))


def _as_batch(reqs: DataFrame, *more: str) -> DataFrame:
    body = pr.request_body(F.lit(pr.MODEL_PLACEHOLDER), F.col("content"))
    return reqs.select(*more, "custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"),
                       F.to_json(body).alias("body"), "status")


def _input_sql(source: str) -> str:
    """The three request tables of an input set; its own items everywhere but in the sample of English examples."""
    req = f"""{MC_REQ_SQL},
{CLOZE_REQ_SQL.replace(POS_SQL + ',', '', 1)},
{PASSAGE_REQ_SQL}"""
    req = req.replace("FROM pos WHERE split = 'dev' AND lang = 'en'", "FROM pos_human WHERE split = 'dev' AND lang = 'en'")
    marked = ", ".join(f"'{source} ' || {c} AS {c}" for c in ("question", "opt_a", "opt_b"))
    items = "items_in AS (SELECT * FROM v_items)" if source == "human" else f"items_in AS (SELECT * REPLACE ({marked}) FROM v_items WHERE lang <> 'en')"
    return f"""SELECT '{source}' AS input, * FROM (WITH {items}, {POS_SQL.replace('pos AS', 'pos_human AS')}, {req.replace('FROM v_items', 'FROM items_in')}
  SELECT * FROM mc UNION ALL SELECT * FROM cloze UNION ALL SELECT * FROM passage)"""


@register("build_input_requests", f"""
WITH r AS ({" UNION ALL ".join(_input_sql(x) for x in INPUTS)})
SELECT input, custom_id, 'POST' AS method, '/v1/chat/completions' AS url, {_body_json()} AS body, status FROM r
""")
def build_input_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-REQ: the request tables of all input sets: human, machine-translated, translated back. Positions, and the sampled
    English examples, are those of the human items, so an id means the same item in each; they are ranked once."""
    pos, passage = _positions(spark, sf_dir), _passage_positions(spark, sf_dir)
    out = None
    for source in INPUTS:
        r = _all_requests(spark, sf_dir, source, pos, passage).withColumn("input", F.lit(source))
        out = r if out is None else out.unionByName(r)
    return _as_batch(out, "input")


@register("explode_trials", "SELECT item_no, lang, CAST(t.trial AS BIGINT) AS trial FROM v_items, (VALUES (0), (1), (2)) AS t(trial)")
def explode_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample asked three times — ``explode(sequence(0, 2))`` instead of a cross join."""
    return v_items(spark, sf_dir).select("item_no", "lang", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("trial"))


# --- ratings → scores → tertiles (A-BUK) ----------------------------------------------
RATING_RE = r"^(.*)-on-([a-z]+)-(mmlu-college_medicine-dev|winogrande-train_s|[^-]+)-([^_]+)_vs_(.+)_([0-9]+)$"


def _rx(i: int) -> str:
    return f"regexp_extract(custom_id, '{RATING_RE}', {i})"


PARSED_RATINGS_SQL = f"""pr AS (
  SELECT {_rx(2)} AS lang, {_rx(3)} AS train, {_rx(4)} AS row_id, {_rx(5)} AS eval,
    CAST({_rx(6)} AS BIGINT) AS trial, TRY_CAST(content AS INTEGER) AS score FROM v_ratings)"""

SCORES_SQL = f"""{PARSED_RATINGS_SQL},
sc AS (
  SELECT lang, train, eval, row_id,
    max(CASE WHEN trial = 0 THEN score END) AS run_1, max(CASE WHEN trial = 1 THEN score END) AS run_2,
    max(CASE WHEN trial = 2 THEN score END) AS run_3, COUNT(score) AS n_runs, SUM(score) AS score_sum,
    SUM(score * score) AS score_sumsq, AVG(score) AS mean, stddev_samp(score) AS std
  FROM pr GROUP BY lang, train, eval, row_id),
tert AS (
  SELECT *, ntile(3) OVER (PARTITION BY lang, train, eval
    ORDER BY score_sum, n_runs * score_sumsq - score_sum * score_sum, row_id) AS tile FROM sc)"""


@register("parse_rating_id", f"WITH {PARSED_RATINGS_SQL} SELECT lang, train, row_id, eval, trial, CAST(score AS BIGINT) AS score FROM pr")
def parse_rating_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating ids split with named parts (no "second underscore" arithmetic)."""
    from evalframe.functions import scoring as sc
    p = sc.parse_rating_id("custom_id")
    r = v_ratings(spark, sf_dir)
    return r.select(p["lang"].alias("lang"), p["train"].alias("train"), p["row_id"].alias("row_id"),
                    p["eval"].alias("eval"), p["trial"].alias("trial"), F.col("content").try_cast("int").alias("score"))


@register("rating_mean_std", f"""
WITH {SCORES_SQL}
SELECT lang, train, eval, row_id, CAST(run_1 AS BIGINT) AS run_1, CAST(run_2 AS BIGINT) AS run_2,
  CAST(run_3 AS BIGINT) AS run_3, round(mean, 6) AS mean, round(std, 6) AS std FROM sc
""")
def rating_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8: three runs side by side, mean and sample std per rated sample."""
    s = cu.rating_scores(v_ratings(spark, sf_dir))
    return s.select("lang", "train", "eval", "row_id", "run_1", "run_2", "run_3", "mean", "std")


@register("quality_tertiles", f"""
WITH {SCORES_SQL}
SELECT lang, train, eval, row_id, round(mean, 6) AS mean, round(std, 6) AS std, CAST(tile AS BIGINT) AS tile,
  CASE tile WHEN 1 THEN 'low' WHEN 2 THEN 'med' ELSE 'high' END AS bucket FROM tert
""")
def quality_tertiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-BUK / W1: ratings → per-sample mean/std → tertile buckets per (language, train set, eval benchmark)."""
    t = cu.tertiles(cu.rating_scores(v_ratings(spark, sf_dir)))
    return t.select("lang", "train", "eval", "row_id", "mean", "std", "tile", "bucket")


@register("tertile_ranges", f"""
WITH {SCORES_SQL}
SELECT lang, train, eval, CASE tile WHEN 1 THEN 'low' WHEN 2 THEN 'med' ELSE 'high' END AS bucket,
  COUNT(*) AS n, round(min(mean), 6) AS first_mean, round(max(mean), 6) AS last_mean
FROM tert GROUP BY ALL
""")
def tertile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last score of each bucket (buckets are contiguous in the sort order)."""
    t = cu.tertiles(cu.rating_scores(v_ratings(spark, sf_dir)))
    return t.groupBy("lang", "train", "eval", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("mean").alias("first_mean"), F.max("mean").alias("last_mean"))


THRESH_SQL = f"""{SCORES_SQL},
th AS (SELECT lang, train, eval, COUNT(*) AS n, quantile_cont(mean, 1.0 / 3) AS lower_t, quantile_cont(mean, 2.0 / 3) AS upper_t
       FROM sc GROUP BY ALL)"""


def _thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cu.rating_scores(v_ratings(spark, sf_dir))
    qs = ranking.exact_quantiles(s.withColumn("rid", F.col("row_id")), ["lang", "train", "eval"], "mean",
                                 [1.0 / 3, 2.0 / 3], tie="rid")
    return qs.groupBy("lang", "train", "eval", "n").agg(
        F.max(F.when(F.col("qi") == 0, F.col("q"))).alias("lower_t"),
        F.max(F.when(F.col("qi") == 1, F.col("q"))).alias("upper_t"))


@register("tertile_thresholds", f"""
WITH {THRESH_SQL}
SELECT lang, train, eval, n, round(lower_t, 6) AS lower_t, round(upper_t, 6) AS upper_t FROM th
""")
def tertile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7: linear-interpolated 1/3 and 2/3 percentiles of the mean scores (exact, skew-safe)."""
    return _thresholds(spark, sf_dir)


@register("score_histogram", f"""
WITH {THRESH_SQL},
bins AS (SELECT lang, train, eval, least(score_sum - 3, 26) AS bin, COUNT(*) AS n FROM sc WHERE n_runs = 3 GROUP BY ALL),
grid AS (SELECT th.*, b.bin FROM th, range(27) AS b(bin))
SELECT g.lang, g.train, g.eval, g.bin, round((g.bin + 3) / 3.0, 6) AS left_edge, coalesce(b.n, 0) AS n,
  CASE WHEN (g.bin + 3) / 3.0 < g.lower_t THEN 'low' WHEN (g.bin + 3) / 3.0 < g.upper_t THEN 'mid' ELSE 'high' END AS tertile_class
FROM grid g LEFT JOIN bins b ON g.lang = b.lang AND g.train = b.train AND g.eval = b.eval AND g.bin = b.bin
""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6 / S21: 27 bins of width 1/3 on [1, 10], last bin closed; each bin classed by the tertile thresholds.

    With three integer runs, (mean − 1)·3 = score_sum − 3 exactly, so the bin
    index needs no floating-point edge comparisons.
    """
    s = cu.rating_scores(v_ratings(spark, sf_dir)).filter(F.col("n_runs") == 3)
    counts = s.groupBy("lang", "train", "eval", cu.histogram_bin(F.col("score_sum")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    th = _thresholds(spark, sf_dir)
    grid = th.select("lang", "train", "eval", "lower_t", "upper_t",
                     F.explode(F.sequence(F.lit(0), F.lit(26))).alias("bin"))
    j = grid.join(counts, ["lang", "train", "eval", "bin"], "left")
    edge = (F.col("bin") + 3) / 3.0
    return j.select("lang", "train", "eval", "bin", edge.alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"),
                    F.when(edge < F.col("lower_t"), "low").when(edge < F.col("upper_t"), "mid").otherwise("high")
                    .alias("tertile_class"))


# --- training rows, rating requests, training sets ---------------------------------------
def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture training rows: items split into the two training sets by size parity (matches v_ratings ids)."""
    it = v_items(spark, sf_dir)
    train = F.when(F.col("opt_c").try_cast("int") % 2 == 0, "mmlu-college_medicine-dev").otherwise("winogrande-train_s")
    user = F.when(train.startswith("mmlu"), pr.fmt(pr.FT_MC_PROMPT, "question", "opt_a", "opt_b", "opt_c", "opt_d")) \
        .otherwise(pr.fmt(pr.FT_CLOZE_PROMPT, "question", "opt_a", "opt_b"))
    assistant = F.when(train.startswith("mmlu"), F.col("answer")).otherwise(_cloze_answer())
    return it.select("lang", train.alias("train"), F.col("item_no").cast("string").alias("row_id"),
                     F.when(train.startswith("mmlu"), "mmlu-college_medicine").otherwise("winogrande").alias("train_data"),
                     user.alias("user"), assistant.alias("assistant"))


TRAIN_ROWS_SQL = f"""tr AS (
  SELECT lang, CASE WHEN CAST(opt_c AS INTEGER) % 2 = 0 THEN 'mmlu-college_medicine-dev' ELSE 'winogrande-train_s' END AS train,
    CAST(item_no AS VARCHAR) AS row_id,
    CASE WHEN CAST(opt_c AS INTEGER) % 2 = 0 THEN 'mmlu-college_medicine' ELSE 'winogrande' END AS train_data,
    CASE WHEN CAST(opt_c AS INTEGER) % 2 = 0 THEN {printf(pr.FT_MC_PROMPT, 'question', 'opt_a', 'opt_b', 'opt_c', 'opt_d')}
      ELSE {printf(pr.FT_CLOZE_PROMPT, 'question', 'opt_a', 'opt_b')} END AS "user",
    CASE WHEN CAST(opt_c AS INTEGER) % 2 = 0 THEN answer ELSE CAST(item_no % 2 + 1 AS VARCHAR) END AS assistant
  FROM v_items)"""


def _py_repr_sql(x: str) -> str:
    esc = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return (f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END")


def _messages_repr_sql() -> str:
    parts = [f"'{{''role'': ''system'', ''content'': ' || {_py_repr_sql(q(pr.SYSTEM_MESSAGE))} || '}}'",
             f"'{{''role'': ''user'', ''content'': ' || {_py_repr_sql('t.\"user\"')} || '}}'",
             f"'{{''role'': ''assistant'', ''content'': ' || {_py_repr_sql('t.assistant')} || '}}'"]
    return "'[' || " + " || ', ' || ".join(parts) + " || ']'"


def _rating_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-RAT: training rows × eligible eval benchmarks (lift ≥ 5 in that language) × 3 trials."""
    elig = g.eligible_combos(acc_cells(spark, sf_dir), BASE).select("train_data", F.col("benchmark").alias("eval"), "lang")
    t = _training_rows(spark, sf_dir).join(elig, ["train_data", "lang"])
    lang_name = F.lit(None).cast("string")
    for code, name in dims.LANGUAGES.items():
        lang_name = F.when(F.col("lang") == code, F.lit(name)).otherwise(lang_name)
    msgs = pr.messages_repr(F.lit(pr.SYSTEM_MESSAGE), F.col("user"), F.col("assistant"))
    content = F.lit(None).cast("string")
    for b, template in pr.RATING_PROMPTS.items():
        content = F.when(F.col("eval") == b, pr.fmt(template, lang_name, msgs)).otherwise(content)
    trials = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("trial"))
    cid = F.concat(F.lit(pr.RATER_MODEL + "-on-"), "lang", F.lit("-"), "train", F.lit("-"), "row_id", F.lit("_vs_"),
                   "eval", F.lit("_"), F.col("trial").cast("string"))
    return trials.select(cid.alias("custom_id"), "lang", "train", "row_id", "eval", "trial", content.alias("content"))


def _rating_prompt_sql(col: str, lang_sql: str, msgs_sql: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{b}' THEN printf({q(t)}, {lang_sql}, {msgs_sql})"
                              for b, t in pr.RATING_PROMPTS.items()) + " END"


LANG_NAME_SQL = "CASE " + " ".join(f"WHEN t.lang = '{c}' THEN '{n}'" for c, n in dims.LANGUAGES.items()) + " END"


def _eligible_sql() -> str:
    from evalframe.plans.gain_reports import ELIGIBLE_SQL
    return ELIGIBLE_SQL


RATING_REQ_SQL = f"""{_eligible_sql()},
{TRAIN_ROWS_SQL},
rr AS (
  SELECT '{pr.RATER_MODEL}-on-' || t.lang || '-' || t.train || '-' || t.row_id || '_vs_' || e.benchmark || '_' || CAST(x.trial AS VARCHAR) AS custom_id,
    t.lang, t.train, t.row_id, e.benchmark AS eval, CAST(x.trial AS BIGINT) AS trial,
    {_rating_prompt_sql('e.benchmark', LANG_NAME_SQL, _messages_repr_sql())} AS content
  FROM tr t JOIN elig e ON t.train_data = e.train_data AND t.lang = e.lang
  CROSS JOIN (VALUES (0), (1), (2)) AS x(trial))"""


@register("render_prompt_rating", f"WITH {RATING_REQ_SQL} SELECT custom_id, content FROM rr")
def render_prompt_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality-rating prompt embedding the chat sample (Python-repr form) for each eligible combination."""
    return _rating_requests(spark, sf_dir).select("custom_id", "content")


@register("build_rating_requests", f"""
WITH {RATING_REQ_SQL},
ordered AS (SELECT *, row_number() OVER (ORDER BY lang, train, row_id, trial, eval) - 1 AS pos, COUNT(*) OVER () AS n FROM rr)
SELECT custom_id, CAST(CASE WHEN pos < n // 2 THEN 0 ELSE 1 END AS BIGINT) AS shard, 'POST' AS method, '/v1/chat/completions' AS url,
  {_body_json(pr.RATER_MODEL)} AS body
FROM ordered
""")
def build_rating_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-RAT + SNK4: rating request table split into two equal halves (shard 0 / 1) for the batch size limit."""
    r = _rating_requests(spark, sf_dir)
    keys = ["lang", "train", "row_id", "trial", "eval"]
    ranked = ranking.positions(r.select(*keys), [], keys)  # keys only; the prompts meet one key, that of the middle row
    middle = ranked.filter(F.col("pos") == F.floor(F.col("group_n") / 2)).agg(F.max(F.struct(*keys))).scalar()
    body = pr.request_body(F.lit(pr.RATER_MODEL), F.col("content"))
    return r.select("custom_id", F.when(F.struct(*keys) < middle, 0).otherwise(1).alias("shard"), F.lit("POST").alias("method"),
                    F.lit("/v1/chat/completions").alias("url"), F.to_json(body).alias("body"))


SHARD_LIMIT = 1000


@register("snk_shard_by_limit", f"""
WITH {RATING_REQ_SQL}
SELECT custom_id, (row_number() OVER (ORDER BY lang, train, row_id, trial, eval) - 1) // {SHARD_LIMIT} AS shard FROM rr
""")
def snk_shard_by_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4 general form: shard = floor(position / limit) in request order (write with partitionBy('shard'))."""
    keys = ["lang", "train", "row_id", "trial", "eval"]
    r = _rating_requests(spark, sf_dir).select("custom_id", *keys)  # ids only: prompts are not ranked/written
    ranked = ranking.positions(r, [], keys)
    return ranked.select("custom_id", F.floor(F.col("pos") / SHARD_LIMIT).cast("bigint").alias("shard"))


@register("snk_request_shards", f"""
WITH {RATING_REQ_SQL},
s AS (SELECT custom_id, (row_number() OVER (ORDER BY lang, train, row_id, trial, eval) - 1) // {SHARD_LIMIT} AS shard FROM rr)
SELECT shard, COUNT(*) AS n_requests, md5(string_agg(custom_id, ',' ORDER BY custom_id)) AS ids_md5 FROM s GROUP BY shard
""")
def snk_request_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: request files of at most ``SHARD_LIMIT`` requests, written as JSON lines by shard and read back (batches of the
    published runs hold 50,000; a smaller limit makes several here)."""
    keys = ["lang", "train", "row_id", "trial", "eval"]
    r = _rating_requests(spark, sf_dir)
    ranked = ranking.positions(r.select("custom_id", *keys), [], keys)  # ids only; the prompts are met by id
    shards = ranked.select("custom_id", F.floor(F.col("pos") / SHARD_LIMIT).cast("bigint").alias("shard"))
    rows = r.select("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"),
                    pr.request_body(F.lit(pr.RATER_MODEL), F.col("content")).alias("body")).join(shards, "custom_id")
    path = files.scratch_path(spark, "request-shards")
    files.write_sharded_jsonl(rows, path, "shard")
    back = spark.read.schema("custom_id string, method string, url string, shard long").json(path)
    ids = F.array_join(F.sort_array(F.collect_list("custom_id")), ",")  # at most SHARD_LIMIT ids
    return back.filter(F.col("method") == "POST").groupBy("shard").agg(F.count(F.lit(1)).alias("n_requests"), F.md5(ids.cast("binary")).alias("ids_md5"))


BUCKET_ROWS_SQL = f"""{SCORES_SQL},
{TRAIN_ROWS_SQL},
br AS (
  SELECT tert.lang, tert.train, tert.eval, CASE tert.tile WHEN 1 THEN 'low' WHEN 2 THEN 'med' ELSE 'high' END AS quality, tr.row_id,
    tr."user", tr.assistant
  FROM tert JOIN tr ON tr.lang = tert.lang AND tr.train = tert.train AND tr.row_id = tert.row_id
  WHERE tert.tile IN (1, 3))"""


def _bucket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows in the low / high bucket of their (language, train, eval) combination."""
    t = cu.tertiles(cu.rating_scores(v_ratings(spark, sf_dir))).filter(F.col("bucket").isin("low", "high"))
    rows = _training_rows(spark, sf_dir)
    return t.select("lang", "train", "eval", F.col("bucket").alias("quality"), "row_id").join(
        rows, ["lang", "train", "row_id"])


@register("join_bucket_rows", f"WITH {BUCKET_ROWS_SQL} SELECT lang, train, eval, quality, row_id FROM br")
def join_bucket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi join of training rows with bucket ids built from (language, train set, row id)."""
    return _bucket_rows(spark, sf_dir).select("lang", "train", "eval", "quality", "row_id")


FRACTIONS = [25, 50, 75, 100]
FRACTIONS_SQL = f"""{BUCKET_ROWS_SQL},
fr AS (
  SELECT *, row_number() OVER (PARTITION BY lang, train, eval, quality ORDER BY md5('{SEED}-' || row_id), row_id) - 1 AS pos,
    COUNT(*) OVER (PARTITION BY lang, train, eval, quality) AS n FROM br),
smp AS (
  SELECT fr.*, f.pct FROM fr, (VALUES {", ".join(f"({p})" for p in FRACTIONS)}) AS f(pct)
  WHERE fr.pos < round_even(fr.n * f.pct / 100.0, 0))"""


@register("sample_fractions", f"""
WITH {FRACTIONS_SQL}
SELECT lang, train, eval, quality, CAST(pct AS BIGINT) AS pct, row_id FROM smp
""")
def sample_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP2: nested 25/50/75/100 % samples of each quality bucket (md5 order, one seed)."""
    s = cu.fraction_samples(_bucket_rows(spark, sf_dir), ["lang", "train", "eval", "quality"], "row_id", FRACTIONS, SEED)
    return s.select("lang", "train", "eval", "quality", "pct", "row_id")


def _chat_json_sql(user: str, assistant: str) -> str:
    return (f"CAST(to_json({{'messages': [{{'role': 'system', 'content': {q(pr.SYSTEM_MESSAGE)}}}, "
            f"{{'role': 'user', 'content': {user}}}, {{'role': 'assistant', 'content': {assistant}}}]}}) AS VARCHAR)")


@register("build_training_sets", f"""
WITH {FRACTIONS_SQL}
SELECT lang, train, CAST(NULL AS VARCHAR) AS eval, CAST(NULL AS VARCHAR) AS quality, CAST(NULL AS BIGINT) AS pct, row_id,
  {_chat_json_sql('"user"', 'assistant')} AS messages
FROM tr
UNION ALL
SELECT lang, train, eval, quality, CAST(pct AS BIGINT), row_id, {_chat_json_sql('"user"', 'assistant')} FROM smp
""")
def build_training_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-FT: full chat training sets per (language, train set) and quality × quantity sets per eligible
    combination; partition columns (lang, train, eval, quality, pct) drive the partitioned sink (SNK3)."""
    full = _training_rows(spark, sf_dir).select(
        "lang", "train", F.lit(None).cast("string").alias("eval"), F.lit(None).cast("string").alias("quality"),
        F.lit(None).cast("bigint").alias("pct"), "row_id", "user", "assistant")
    qq = cu.fraction_samples(_bucket_rows(spark, sf_dir), ["lang", "train", "eval", "quality"], "row_id", FRACTIONS, SEED) \
        .select("lang", "train", "eval", "quality", F.col("pct").cast("bigint").alias("pct"), "row_id", "user", "assistant")
    u = full.unionByName(qq)
    row = pr.chat_row(F.lit(pr.SYSTEM_MESSAGE), F.col("user"), F.col("assistant"))
    return u.select("lang", "train", "eval", "quality", "pct", "row_id", F.to_json(row).alias("messages"))


@register("chat_training_rows", f"""
SELECT u.conv_id, u.turn,
  {_chat_json_sql('u.text', 'r.text')} AS messages
FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 1
WHERE u.role = 'user' AND r.role = 'assistant'
""")
def chat_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fine-tuning chat rows [system, user, assistant] — each user turn with the reply that follows.

    Turns are paired by one aggregate on (conv_id, pair turn) — a group of at
    most two rows — so every output row has exactly three messages and no
    conversation is gathered into one row.
    """
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pairs = consecutive_turns(c)
    row = pr.chat_row(F.lit(pr.SYSTEM_MESSAGE), F.col("a"), F.col("b"))
    return pairs.select("conv_id", "turn", F.to_json(row).alias("messages"))


@register("snk_bucket_json", f"""
WITH {SCORES_SQL}
SELECT lang, train, eval, CASE tile WHEN 1 THEN 'low' WHEN 2 THEN 'med' ELSE 'high' END AS bucket,
  CAST(to_json({{'lang': lang, 'train': train, 'eval': eval, 'bucket': CASE tile WHEN 1 THEN 'low' WHEN 2 THEN 'med' ELSE 'high' END, 'id': row_id}}) AS VARCHAR) AS line
FROM tert
""")
def snk_bucket_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5: the nested object lang → train → eval → bucket → ids, written in range-sorted parts that join to one valid
    object, and read back from its lines (a line per id)."""
    t = cu.tertiles(cu.rating_scores(v_ratings(spark, sf_dir)))
    path = files.scratch_path(spark, "buckets")
    levels = ["lang", "train", "eval", "bucket"]
    json_objects.write_nested(t, path, levels, "row_id")
    back = json_objects.read_nested(spark, path, levels, "id")
    return back.select(*levels, F.to_json(F.struct(*levels, "id")).alias("line"))
