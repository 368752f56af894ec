"""Input tables and the portable fixture views (FIXTURES.md §C).

Each view is a narrow projection of one driver table, written with column
expressions only, so Catalyst prunes the parquet scan to the referenced
columns and fuses the projection into the scan's whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lang4(x: Column) -> Column:
    m = x % 4
    return (F.when(m == 0, "en").when(m == 1, "af").when(m == 2, "zu").otherwise("xh"))


def _benchmark5(x: Column) -> Column:
    m = x % 5
    return (F.when(m == 0, "belebele").when(m == 1, "winogrande").when(m == 2, "mmlu-college_medicine")
            .when(m == 3, "mmlu-clinical_knowledge").otherwise("mmlu-virology"))


def _fdiv(x: Column, d: int) -> Column:
    return F.floor(x / F.lit(d)).cast("bigint")


def _k() -> Column:
    return F.regexp_extract(F.col("props"), "([0-9]+)", 1).cast("int")


def v_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers fact: one row per model answer (reference schema A1)."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    e = e.withColumn("k", _k())
    ft = (F.col("k") % 2) == 1
    q = F.when(ft & (F.col("k") % 3 == 1), "low").when(ft & (F.col("k") % 3 == 2), "high")
    pct_m = _fdiv(F.col("event_id"), 15) % 4
    pct = F.when(pct_m == 0, "25%").when(pct_m == 1, "50%").when(pct_m == 2, "75%").otherwise("100%")
    m7 = F.col("event_id") % 7
    return e.select(
        F.col("event_id").alias("response_id"),
        _fdiv(F.col("event_id"), 1200).alias("item_id"),
        F.col("event_type").alias("model"),
        _lang4(F.col("user_id")).alias("eval_lang"),
        _benchmark5(F.col("event_id")).alias("benchmark"),
        (_fdiv(F.col("event_id"), 5) % 3 + 1).alias("trial"),
        ft.alias("was_ft"),
        F.when(ft, _lang4(_fdiv(F.col("user_id"), 4))).alias("train_lang"),
        F.when(ft, F.when(F.col("k") % 4 == 1, "mmlu-college_medicine").otherwise("winogrande")).alias("train_data"),
        q.alias("quality"),
        F.when(ft & (F.col("k") % 3 > 0), pct).alias("pct_used"),
        F.when(m7 < 4, "Human - Upwork.com").when(m7 < 6, "Machine (gt)").otherwise("Machine (bt)").alias("approach"),
        F.when(m7 < 6, "en").otherwise(_lang4(F.col("user_id"))).alias("source_lang"),
        F.when(m7 < 6, _lang4(F.col("user_id"))).otherwise("en").alias("target_lang"),
        F.when(F.col("value") > 30 + 5 * (F.col("user_id") % 4), 1).otherwise(0).alias("correct"),
    )


def v_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters per (item, language): quality and cultural appropriateness (schema A2)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    ck = F.col("o_custkey")
    p1 = F.substring(F.col("o_orderpriority"), 1, 1)

    def quality(x: Column) -> Column:
        m = x % 3
        return F.when(m == 0, "Completely wrong").when(m == 1, "Good translation").otherwise("Understandable")

    approp_1 = (F.when(p1 == "1", "Do not understand").when(p1 == "2", "Maybe").when(p1 == "3", "Yes")
                .otherwise("No, the sentence is typical"))
    approp_2 = (F.when(F.col("o_orderstatus") == "P", "No, the sentence is typical")
                .when((F.col("o_orderstatus") == "F") & (p1 == "4"), "Yes")
                .when(p1 == "1", F.lit(None).cast("string"))
                .when(p1 == "2", "Maybe").when(p1 == "3", "Yes")
                .otherwise("No, the sentence is typical"))
    return o.select(
        F.col("o_orderkey").alias("survey_key"),
        _fdiv(F.col("o_orderkey"), 4).alias("item_id"),
        _fdiv(F.col("o_orderkey"), 1800).alias("answer_item"),
        _lang4(F.col("o_orderkey")).alias("lang"),
        quality(ck).alias("quality_1"),
        quality(ck + F.when(ck % 5 == 0, 1).otherwise(0)).alias("quality_2"),
        approp_1.alias("approp_1"),
        approp_2.alias("approp_2"),
    )


def v_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model generations keyed by the compound custom id (schema A6, flat form)."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    e = e.withColumn("k", _k())
    wino = (F.col("event_id") % 5) == 1
    gold = F.when(wino, F.when(F.col("user_id") % 2 == 0, "1").otherwise("2")).otherwise(
        F.when(F.col("user_id") % 3 == 0, "A").when(F.col("user_id") % 3 == 1, "B").otherwise("C"))
    km = F.col("k") % 5
    content = F.when(
        wino,
        F.when(km == 0, "1").when(km == 1, "Option 2.").when(km == 2, "1 or 2").when(km == 3, "neither").otherwise(" 2"),
    ).otherwise(F.when(km == 0, "A").when(km == 1, "(B) since").when(km == 2, " c").when(km == 3, "").otherwise("()"))
    g = e.select(
        F.col("event_id"),
        F.col("event_type").alias("model"),
        F.concat(F.col("event_type"), F.lit("-on-"), _lang4(F.col("user_id")), F.lit("-"),
                 _benchmark5(F.col("event_id")), F.lit("-"), F.col("event_id").cast("string"),
                 F.lit("-answer-"), gold).alias("custom_id"),
        content.alias("content"), gold.alias("gold"), "k",
    )
    # some requests were asked again: a second answer, later in load order
    again = F.when(F.col("event_id") % 10 == 1, True).otherwise(F.col("event_id") % 10 == 3)
    g = g.withColumn("n", F.explode(F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    second = F.when(F.col("k") % 3 == 0, F.col("gold")).otherwise("")
    return g.select((F.col("event_id") + F.col("n") * F.lit(1_000_000_000)).alias("event_id"), "model", "custom_id",
                    F.when(F.col("n") == 0, F.col("content")).otherwise(second).alias("content"))


def v_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality ratings, three trials per benchmark row (answers to rating requests).

    The fixture writes this as a cross join with a 3-row table; here the three
    trials are generated per row with ``explode(sequence)`` — a narrow
    operator, no join at all.
    """
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    p = p.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(2))))
    key = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("gpt-4o-on-"), _lang4(key), F.lit("-"),
                 F.when(F.col("p_size") % 2 == 0, "mmlu-college_medicine-dev").otherwise("winogrande-train_s"),
                 F.lit("-"), key.cast("string"), F.lit("_vs_"),
                 F.when(F.col("p_size") % 3 == 0, "belebele").otherwise("mmlu-virology"),
                 F.lit("_"), F.col("trial").cast("string")).alias("custom_id"),
        ((key * 7 + F.col("p_size") * F.col("trial")) % 10 + 1).cast("string").alias("content"),
    )


def v_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items (multiple-choice files, schema A5)."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    key = F.col("p_partkey")
    return p.select(
        key.alias("item_no"),
        F.col("p_type").alias("section"),
        F.when(key % 9 == 0, "dev").when(key % 9 < 3, "val").otherwise("test").alias("split"),
        _lang4(key).alias("lang"),
        F.col("p_name").alias("question"),
        F.col("p_brand").alias("opt_a"),
        F.col("p_type").alias("opt_b"),
        F.col("p_size").cast("string").alias("opt_c"),
        F.concat(F.lit("x"), key.cast("string")).alias("opt_d"),
        F.when(key % 3 == 0, "A").when(key % 3 == 1, "B").otherwise("C").alias("answer"),
    )


def v_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation questions by translation approach (schema A4)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    m3, item = F.col("doc_id") % 3, _fdiv(F.col("doc_id"), 3)
    lang = F.when(item % 3 == 0, "af").when(item % 3 == 1, "zu").otherwise("xh")
    return d.select(
        F.concat(F.lit("q-"), F.when(m3 == 0, "en").when(m3 == 1, lang).otherwise(F.concat(F.lit("gt-"), lang)), F.lit("-"),
                 item.cast("string")).alias("question_id"),
        F.when(m3 == 0, "en").otherwise(lang).alias("target_lang"),
        F.when(m3 == 2, "Machine").otherwise("Human").alias("approach"),
        F.when(_fdiv(item, 3) % 2 == 0, "winogrande").otherwise("mmlu").alias("benchmark"),
        F.col("source").alias("translator"),
        F.col("text").alias("question"),
    )


def v_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation workflow rows (schema A3): documents left-joined to their labels."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("wkey"),
        F.col("lang"),
        F.col("source").alias("translator"),
        F.col("text").alias("initial_text"),
        F.when(F.col("quality") == 0, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("checked "), F.col("text")))
               .otherwise(F.substring_index("text", "\n", 1))).alias("correction"),
        F.col("quality"),
        F.col("toxic"),
        F.when(F.col("n_chars") % 11 == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("dirty_number"),
    )


VIEWS = {
    "v_responses": v_responses,
    "v_surveys": v_surveys,
    "v_generations": v_generations,
    "v_ratings": v_ratings,
    "v_items": v_items,
    "v_translations": v_translations,
    "v_workflow": v_workflow,
}


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register base tables and fixture views as temp views (for SQL users)."""
    for t in TABLES:
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)
    for name, fn in VIEWS.items():
        fn(spark, sf_dir).createOrReplaceTempView(name)
