"""Parsing and scoring nested answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe import dims
from evalframe.functions import scoring as sc
from evalframe.functions.numeric import pct_tenths
from evalframe.operators import costs, ranking
from evalframe.plans.catalog import register
from evalframe.session import materialize
from evalframe.sources import answers, files, json_objects
from evalframe.sources.tables import v_generations, v_items

ID_RE = sc.CUSTOM_ID_PATTERN
STRIP_SQL = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
LETTER_SQL = ("coalesce(length(upper(replace(replace(" + STRIP_SQL.format(x="content") + ", '(', ''), ')', ''))) > 0 "
              "AND substr(upper(replace(replace(" + STRIP_SQL.format(x="content") + ", '(', ''), ')', '')), 1, 1) "
              "= right(custom_id, 1), false)")
STRICT_SQL = ("coalesce(contains(content, right(custom_id, 1)) AND NOT contains(content, "
              "CAST(3 - CAST(right(custom_id, 1) AS INTEGER) AS VARCHAR)), false)")
LENIENT_ANSWER_SQL = "CASE WHEN contains(content, '1') THEN '1' WHEN contains(content, '2') THEN '2' ELSE content END"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = v_generations(spark, sf_dir)
    p = sc.parse_custom_id(F.col("custom_id"))
    return g.select("event_id", "custom_id", "content", *[c.alias(k) for k, c in p.items()])


def _parsed_sql() -> str:
    return f"""parsed AS (
  SELECT event_id, custom_id, content,
    regexp_extract(custom_id, '{ID_RE}', 1) AS model, regexp_extract(custom_id, '{ID_RE}', 2) AS lang,
    regexp_extract(custom_id, '{ID_RE}', 3) AS benchmark,
    CAST(regexp_extract(custom_id, '{ID_RE}', 4) AS BIGINT) AS n, regexp_extract(custom_id, '{ID_RE}', 5) AS gold
  FROM v_generations)"""


@register("parse_custom_id", f"WITH {_parsed_sql()} SELECT event_id, model, lang, benchmark, n, gold FROM parsed")
def parse_custom_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split the compound request id into typed columns once."""
    return _parsed(spark, sf_dir).drop("custom_id", "content")


@register("score_letter", f"""
SELECT event_id, custom_id, {LETTER_SQL} AS correct
FROM v_generations WHERE NOT contains(custom_id, '-winogrande-')
""")
def score_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1: multiple-choice letter scorer on MMLU / Belebele generations."""
    g = v_generations(spark, sf_dir).filter(~F.col("custom_id").contains("-winogrande-"))
    return g.select("event_id", "custom_id", sc.score_letter("custom_id", "content").alias("correct"))


@register("score_binary_strict", f"""
SELECT event_id, custom_id, {STRICT_SQL} AS correct
FROM v_generations WHERE contains(custom_id, '-winogrande-')
""")
def score_binary_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: strict Winogrande scorer (gold present and the other option absent)."""
    g = v_generations(spark, sf_dir).filter(F.col("custom_id").contains("-winogrande-"))
    return g.select("event_id", "custom_id", sc.score_binary_strict("custom_id", "content").alias("correct"))


@register("score_binary_lenient", f"""
SELECT event_id, custom_id, {LENIENT_ANSWER_SQL} AS parsed_answer,
  coalesce({LENIENT_ANSWER_SQL} = right(custom_id, 1), false) AS correct
FROM v_generations WHERE contains(custom_id, '-winogrande-')
""")
def score_binary_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lenient Winogrande scorer ("1" wins if present, else "2", else raw)."""
    g = v_generations(spark, sf_dir).filter(F.col("custom_id").contains("-winogrande-"))
    return g.select("event_id", "custom_id", sc.lenient_binary_answer("content").alias("parsed_answer"),
                    sc.score_binary_lenient("custom_id", "content").alias("correct"))


ALL_LANGS_SQL = ", ".join(f"('{x}')" for x in dims.LANGUAGES)


@register("score_generations", f"""
WITH {_parsed_sql()},
last AS (SELECT model, benchmark, lang, custom_id, arg_max(content, event_id) AS content FROM parsed GROUP BY ALL),
scored AS (
  SELECT model, benchmark, lang,
    CASE WHEN benchmark = 'winogrande' THEN {STRICT_SQL} ELSE {LETTER_SQL} END AS correct
  FROM last),
agg AS (SELECT model, benchmark, lang, COUNT(*) AS n, SUM(CASE WHEN correct THEN 1 ELSE 0 END) AS c
  FROM scored GROUP BY ALL),
grid AS (SELECT DISTINCT model, benchmark FROM parsed)
SELECT g.model, g.benchmark, l.lang, coalesce(a.n, 0) AS n_answers,
  round(coalesce(CAST(FLOOR((a.c * 2000 + a.n) / (a.n * 2.0)) AS BIGINT) / 10.0, -100.0), 6) AS score_pct
FROM grid g CROSS JOIN (VALUES {ALL_LANGS_SQL}) AS l(lang)
LEFT JOIN agg a ON a.model = g.model AND a.benchmark = g.benchmark AND a.lang = l.lang
""")
def score_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-SCO: score the last answer of every request (S9), accuracy per (model, benchmark, language); −100 for untested languages."""
    g = v_generations(spark, sf_dir)
    last = g.groupBy("custom_id").agg(F.max(sc.packed_score("event_id", "custom_id", "content")).alias("s"))  # texts stay in the scan
    p = sc.parse_custom_id(F.col("custom_id"))
    scored = last.select(p["model"].alias("model"), p["benchmark"].alias("benchmark"), p["lang"].alias("lang"),
                         sc.unpacked_score("s", p["benchmark"]).alias("correct"))
    langs = list(dims.LANGUAGES)
    # one aggregate per (model, benchmark) with a count pair per language of the fixed list: the
    # sentinel grid needs no second pass and no join
    per = scored.groupBy("model", "benchmark").agg(*[
        F.struct(F.lit(x).alias("lang"), F.count(F.when(F.col("lang") == x, 1)).alias("n"),
                 F.sum(F.when(F.col("lang") == x, F.col("correct"))).alias("c")).alias(f"l{i}")
        for i, x in enumerate(langs)])
    cells = per.select("model", "benchmark", F.explode(F.array(*[f"l{i}" for i in range(len(langs))])).alias("x"))
    n, c = F.col("x.n"), F.col("x.c")
    return cells.select("model", "benchmark", F.col("x.lang").alias("lang"), n.alias("n_answers"),
                        F.coalesce(pct_tenths(c, n) / 10.0, F.lit(-100.0)).alias("score_pct"))


@register("dedup_last_wins", """
SELECT custom_id, arg_max(content, event_id) AS content, COUNT(*) AS n_copies
FROM v_generations GROUP BY custom_id
""")
def dedup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13 / S9: duplicate ids keep the LAST answer in load order (``max_by``, partial-aggregated)."""
    g = v_generations(spark, sf_dir)
    return g.groupBy("custom_id").agg(F.max_by("content", "event_id").alias("content"),
                                      F.count(F.lit(1)).alias("n_copies"))


@register("anti_pending_requests", """
SELECT r.event_id, r.custom_id, r.model
FROM v_generations r
WHERE NOT EXISTS (SELECT 1 FROM v_generations a WHERE a.content <> '' AND a.custom_id = r.custom_id)
""")
def anti_pending_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose id has no successful answer yet (failed = empty content) — resume set."""
    g = v_generations(spark, sf_dir)
    answered = g.filter(F.col("content") != "").select("custom_id")
    return g.select("event_id", "custom_id", "model").join(answered, "custom_id", "left_anti")


@register("filter_regex_key", """
SELECT event_id, custom_id FROM v_generations WHERE regexp_matches(custom_id, '.*-on-af-mmlu-virology.*')
""")
def filter_regex_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF5: regex key predicate (language af, MMLU section virology)."""
    g = v_generations(spark, sf_dir)
    return g.filter(F.col("custom_id").rlike(".*-on-af-mmlu-virology.*")).select("event_id", "custom_id")


GEN_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([T.StructField("body", T.StructType([
        T.StructField("choices", T.ArrayType(T.StructType([
            T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))])))]))])),
])


def generation_rows(g: DataFrame) -> DataFrame:
    """Flat generations nested into the batch-output shape (schema A6), with their load order."""
    body = F.struct(F.array(F.struct(F.struct("content").alias("message"))).alias("choices"))
    return g.select("event_id", "custom_id", F.struct(body.alias("body")).alias("response"))


@register("src_generations_json", """
SELECT event_id, json_extract_string(line, '$.custom_id') AS custom_id,
  json_extract_string(line, '$.response.body.choices[0].message.content') AS content
FROM (SELECT event_id, to_json({'custom_id': custom_id, 'response': {'body': {'choices': [{'message': {'content': content}}]}}}) AS line
      FROM v_generations)
""")
def src_generations_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3 / F5: generation files, JSON lines with a declared schema; content at ``response.body.choices[0].message.content``."""
    path = files.scratch_path(spark, "generations")
    files.write_jsonl(generation_rows(v_generations(spark, sf_dir)), path)
    back = files.read_json(spark, path, T.StructType([T.StructField("event_id", T.LongType()), *GEN_SCHEMA.fields]))
    return back.select("event_id", "custom_id", F.get("response.body.choices", F.lit(0))["message"]["content"].alias("content"))


@register("src_json_map", """
SELECT event_id, custom_id, content FROM v_generations
""")
def src_json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: one JSON object, id → struct over several lines, written and scanned back from any splits."""
    g = v_generations(spark, sf_dir)
    path = files.scratch_path(spark, "answers-object")
    json_objects.write_object(g.select("event_id", F.struct("custom_id", "content").alias("answer")), path, "event_id", "answer")
    m = json_objects.read_members(spark, path, "struct<custom_id: string, content: string>")
    return m.select(F.col("key").cast("bigint").alias("event_id"), "value.custom_id", "value.content")


@register("score_answers_object", f"""
WITH {_parsed_sql()},
last AS (SELECT model, benchmark, lang, custom_id, arg_max(content, event_id) AS content FROM parsed GROUP BY ALL)
SELECT model, benchmark, lang, COUNT(*) AS n_answers,
  CAST(SUM(CASE WHEN CASE WHEN benchmark = 'winogrande' THEN {STRICT_SQL} ELSE {LETTER_SQL} END THEN 1 ELSE 0 END) AS BIGINT) AS n_correct
FROM last GROUP BY ALL
""")
def score_answers_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4 / A-SCO: the map form of answers, one object id → answer, scanned in splits and scored."""
    g = v_generations(spark, sf_dir).groupBy("custom_id").agg(F.max_by("content", "event_id").alias("content"))
    path = files.scratch_path(spark, "answers-map")
    json_objects.write_object(g, path, "custom_id", "content")
    m = json_objects.read_object(spark, path, "string").select(F.col("key").alias("custom_id"), F.col("value").alias("content"))
    p = sc.parse_custom_id(F.col("custom_id"))
    scored = m.select(*[p[c].alias(c) for c in ("model", "benchmark", "lang")], sc.score_generation("custom_id", "content", p["benchmark"]).cast("int").alias("correct"))
    return scored.groupBy("model", "benchmark", "lang").agg(F.count(F.lit(1)).alias("n_answers"), F.sum("correct").alias("n_correct"))


_OUTCOMES_SQL = f"""o AS (SELECT event_id, custom_id, model, content,
    CASE WHEN event_id % 13 = 5 THEN 'broken' WHEN event_id % 17 = 3 THEN 'failed' ELSE 'answered' END AS status FROM v_generations),
last AS (SELECT model, custom_id, arg_max(content, event_id) AS content FROM o WHERE status = 'answered' GROUP BY ALL),
hit AS (SELECT model, custom_id, CASE WHEN contains(custom_id, '-winogrande-') THEN {STRICT_SQL} ELSE {LETTER_SQL} END AS correct FROM last)"""


def _answer_files(spark: SparkSession, sf_dir: str) -> str:
    """Answers as JSON lines, a folder per model, in which some lines are cut off and some calls failed; returns the path."""
    path = files.scratch_path(spark, "generation-files")
    g = v_generations(spark, sf_dir)
    body = F.struct(F.array(F.struct(F.struct("content").alias("message"))).alias("choices"))
    response = F.when(F.col("event_id") % 17 != 3, F.struct(body.alias("body")))
    line = F.to_json(F.struct(F.col("event_id").alias("seq"), "custom_id", response.alias("response")), {"ignoreNullFields": "false"})
    line = F.when(F.col("event_id") % 13 == 5, F.substring(line, F.lit(1), F.length(line) - 7)).otherwise(line)
    g.select("model", line.alias("value")).write.mode("overwrite").partitionBy("model").text(path)
    return path


@register("src_generations_quarantine", f"""
WITH {_OUTCOMES_SQL}
SELECT o.model, COUNT(*) AS n_lines, COUNT(CASE WHEN status = 'answered' THEN 1 END) AS n_answered,
  COUNT(CASE WHEN status = 'failed' THEN 1 END) AS n_failed, COUNT(CASE WHEN status = 'broken' THEN 1 END) AS n_broken,
  COUNT(CASE WHEN status = 'broken' THEN 1 END) AS n_quarantined,
  any_value(h.n) AS n_scored, any_value(h.c) AS n_correct
FROM o JOIN (SELECT model, COUNT(*) AS n, CAST(SUM(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS c FROM hit GROUP BY model) h ON h.model = o.model
GROUP BY o.model
""")
def src_generations_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3 / S33: answer files with cut-off lines and failed calls: outcomes by file, the quarantine table, accuracy over the answered."""
    outcomes = materialize(answers.read_outcomes(spark, _answer_files(spark, sf_dir)), "outcomes")  # read three times, parsed once
    kept = files.scratch_path(spark, "quarantine")
    answers.quarantine(outcomes, kept)
    model = F.regexp_extract("folder", "model=(.*)", 1).alias("model")
    held = spark.read.schema("folder string, file string, line string").parquet(kept).groupBy(model).agg(F.count("line").alias("n_quarantined"))
    counts = answers.file_counts(outcomes, "folder").withColumn("model", model).drop("folder")
    last = answers.last_answers(outcomes)
    p = sc.parse_custom_id(F.col("custom_id"))
    scored = last.select(p["model"].alias("model"), sc.score_generation("custom_id", "content", p["benchmark"]).cast("int").alias("correct"))
    scored = scored.groupBy("model").agg(F.count(F.lit(1)).alias("n_scored"), F.sum("correct").alias("n_correct"))
    return counts.join(held, "model").join(scored, "model")


@register("request_coverage", f"""
WITH {_OUTCOMES_SQL}
SELECT model, CASE WHEN ok = 1 THEN 'answered' WHEN ok = 0 THEN 'failed' ELSE 'pending' END AS outcome, COUNT(*) AS n_requests
FROM (SELECT model, custom_id, max(CASE status WHEN 'answered' THEN 1 WHEN 'failed' THEN 0 END) AS ok FROM o GROUP BY ALL) GROUP BY ALL
""")
def request_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request beside its lines: answered, failed, or pending."""
    requests = v_generations(spark, sf_dir).select("custom_id")
    c = answers.coverage(requests, answers.read_outcomes(spark, _answer_files(spark, sf_dir)))
    model = sc.parse_custom_id(F.col("custom_id"))["model"]
    return c.groupBy(model.alias("model"), "outcome").agg(F.count(F.lit(1)).alias("n_requests"))


def position_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: position → question id (the row order of the id list), via skew-safe ranking."""
    items = v_items(spark, sf_dir).select("item_no", "section")
    ranked = ranking.positions(items, [], [F.col("item_no")], pos_col="position")
    return ranked.select("position", F.concat("section", F.lit("-"), F.col("item_no").cast("string")).alias("qid"))


POSMAP_SQL = """posmap AS (
  SELECT row_number() OVER (ORDER BY item_no) - 1 AS position, concat(section, '-', CAST(item_no AS VARCHAR)) AS qid
  FROM v_items)"""


@register("join_position_map", f"""
WITH {_parsed_sql()}, {POSMAP_SQL}
SELECT p.event_id, p.n, m.qid FROM parsed p LEFT JOIN posmap m ON p.n = m.position
WHERE p.benchmark = 'winogrande'
""")
def join_position_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 / SRC6: Winogrande generations get their question id through the position map."""
    p = _parsed(spark, sf_dir).filter(F.col("benchmark") == "winogrande")
    pm = position_map(spark, sf_dir)
    return p.join(pm, p["n"] == pm["position"], "left").select("event_id", "n", "qid")


WIDE_COLS = [(m, lang) for m in dims.FIXTURE_MODEL_LABELS for lang in dims.FIXTURE_LANGUAGES]


@register("item_correctness_wide", f"""
WITH {_parsed_sql()}, {POSMAP_SQL},
s AS (
  SELECT m.qid, p.gold, p.model, p.lang, p.event_id,
    CASE WHEN {LENIENT_ANSWER_SQL} = p.gold THEN 1 ELSE 0 END AS correct
  FROM parsed p JOIN posmap m ON p.n = m.position WHERE p.benchmark = 'winogrande')
SELECT qid, min(gold) AS answer,
  {", ".join(f"CAST(arg_max(CASE WHEN model = '{m}' AND lang = '{x}' THEN correct END, CASE WHEN model = '{m}' AND lang = '{x}' THEN event_id END) AS BIGINT) AS {m}_{x}" for m, x in WIDE_COLS)}
FROM s GROUP BY qid
""")
def item_correctness_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-WIDE: item × (model, language) 1/0 table with the lenient scorer; later answers overwrite earlier."""
    p = _parsed(spark, sf_dir).filter(F.col("benchmark") == "winogrande")
    pm = position_map(spark, sf_dir)
    s = p.join(pm, p["n"] == pm["position"]).select(
        "qid", "gold", "event_id", F.concat("model", F.lit("_"), "lang").alias("col"),
        sc.score_binary_lenient("custom_id", "content").cast("int").alias("correct"))
    cols = [f"{m}_{x}" for m, x in WIDE_COLS]
    hit = {c: F.col("col") == c for c in cols}
    return s.groupBy("qid").agg(
        F.min("gold").alias("answer"),
        *[F.max_by(F.when(hit[c], F.col("correct")), F.when(hit[c], F.col("event_id"))).alias(c) for c in cols])


@register("scope_requests", """
SELECT 'all' AS scope, event_id, custom_id FROM v_generations WHERE NOT contains(custom_id, 'college_medicine')
UNION ALL
SELECT 'af-belebele', event_id, custom_id FROM v_generations
WHERE NOT contains(custom_id, 'college_medicine') AND contains(custom_id, '-on-af-belebele-')
""")
def scope_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-EVS: evaluation scope of a tuned model — drop the training benchmark; a targeted
    quality×quantity run keeps only ``-on-{lang}-{bench}-`` ids."""
    g = v_generations(spark, sf_dir).filter(~F.col("custom_id").contains("college_medicine"))
    scopes = F.array(F.lit("all"), F.when(F.col("custom_id").contains("-on-af-belebele-"), F.lit("af-belebele")))
    return g.select(F.explode(F.array_compact(scopes)).alias("scope"), "event_id", "custom_id")


@register("substitute_model", """
SELECT event_id, replace('{"model": "<|MODEL|>", "custom_id": "' || custom_id || '"}', '<|MODEL|>', model) AS body
FROM v_generations
""")
def substitute_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fill the model placeholder of a request body template."""
    g = v_generations(spark, sf_dir)
    template = F.concat(F.lit('{"model": "<|MODEL|>", "custom_id": "'), F.col("custom_id"), F.lit('"}'))
    return g.select("event_id", sc.substitute_model(template, F.col("model")).alias("body"))


# SP3 / A-COST -------------------------------------------------------------------
COST_TRIAL_SEEDS = [1, 2, 3]
SAMPLE_PER_STRATUM = 3
PRICES = costs.PRICES


def _stratified_sample(g: DataFrame) -> DataFrame:
    base = g.select("event_id", "custom_id", "content",
                    sc.dataset_of("custom_id").alias("dataset"),
                    sc.parse_custom_id("custom_id")["lang"].alias("lang"))
    trials = base.withColumn("trial", F.explode(dims.literal_array(COST_TRIAL_SEEDS)))
    keyed = trials.withColumn("h", F.md5(F.concat(F.col("trial").cast("string"), F.lit("-"),
                                                  F.col("event_id").cast("string"))))
    return ranking.top_k(keyed, ["trial", "dataset", "lang"], ["h", "event_id"], SAMPLE_PER_STRATUM)


SAMPLE_SQL = f"""base AS (
  SELECT event_id, custom_id, content,
    CASE WHEN contains(custom_id, '-mmlu-') THEN 'mmlu' WHEN contains(custom_id, '-winogrande-') THEN 'winogrande'
      WHEN contains(custom_id, '-belebele-') THEN 'belebele' END AS dataset,
    regexp_extract(custom_id, '{ID_RE}', 2) AS lang, CAST(t.trial AS BIGINT) AS trial
  FROM v_generations CROSS JOIN (VALUES {", ".join(f"({s})" for s in COST_TRIAL_SEEDS)}) AS t(trial)),
smp AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY trial, dataset, lang
      ORDER BY md5(CAST(trial AS VARCHAR) || '-' || CAST(event_id AS VARCHAR)), event_id) AS rank
    FROM base) WHERE rank <= {SAMPLE_PER_STRATUM})"""


@register("sample_stratified", f"""
WITH {SAMPLE_SQL}
SELECT trial, dataset, lang, rank, event_id, custom_id FROM smp
""")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SP3: n=3 requests per (dataset, language) per trial, deterministic md5 order."""
    s = _stratified_sample(v_generations(spark, sf_dir))
    return s.select("trial", "dataset", "lang", "rank", "event_id", "custom_id")


@register("cost_projection", f"""
WITH {SAMPLE_SQL},
usage AS (
  SELECT trial, AVG(length(custom_id)) AS in_tok, AVG(length(content)) AS out_tok
  FROM smp WHERE content <> '' GROUP BY trial),
n AS (SELECT COUNT(*) AS n FROM v_generations),
costs AS (
  SELECT 'input_token_usages' AS metric, in_tok AS v FROM usage
  UNION ALL SELECT 'output_token_usages', out_tok FROM usage
  UNION ALL SELECT 'o1_costs', (in_tok * {PRICES['o1'][0]} / 1e6 + out_tok * {PRICES['o1'][1]} / 1e6) * n FROM usage, n
  UNION ALL SELECT 'o1_mini_costs', (in_tok * {PRICES['o1_mini'][0]} / 1e6 + out_tok * {PRICES['o1_mini'][1]} / 1e6) * n FROM usage, n)
SELECT metric, COUNT(*) AS n_trials, round(AVG(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  round(AVG(v) - 2 * stddev_samp(v), 6) AS ci_lower, round(AVG(v) + 2 * stddev_samp(v), 6) AS ci_upper
FROM costs GROUP BY metric
""")
def cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-COST / AG14 / ST9 / ST10: token usage of a stratified sample (failed calls excluded),
    projected cost for N requests under two price sheets, mean ± 2σ over trials.

    Token counts are stand-ins: input = length of the request id, output =
    length of the answer (the live API calls are outside the library).
    """
    g = v_generations(spark, sf_dir)
    s = _stratified_sample(g)
    usage = s.filter(F.col("content") != "").groupBy("trial").agg(
        F.avg(F.length("custom_id")).alias("in_tok"), F.avg(F.length("content")).alias("out_tok"))
    return costs.project_costs(usage, g.agg(F.count(F.lit(1))).scalar())  # scalar subquery: N requests
