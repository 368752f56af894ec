"""DuckDB-side definitions of the fixture views (verbatim from FIXTURES.md §C).

Oracle SQL strings reference these names; ``with_views`` inlines the ones a
query uses as CTEs so DuckDB can run it against the raw parquet tables.
"""

from __future__ import annotations

import re

VIEW_SQL = {
    "v_responses": """
SELECT event_id AS response_id, CAST(FLOOR(event_id / 1200) AS BIGINT) AS item_id, event_type AS model,
  CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'af' WHEN 2 THEN 'zu' ELSE 'xh' END AS eval_lang,
  CASE event_id % 5 WHEN 0 THEN 'belebele' WHEN 1 THEN 'winogrande' WHEN 2 THEN 'mmlu-college_medicine'
    WHEN 3 THEN 'mmlu-clinical_knowledge' ELSE 'mmlu-virology' END AS benchmark,
  CAST(FLOOR(event_id / 5) AS BIGINT) % 3 + 1 AS trial,
  k % 2 = 1 AS was_ft,
  CASE WHEN k % 2 = 1 THEN CASE CAST(FLOOR(user_id / 4) AS BIGINT) % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'af' WHEN 2 THEN 'zu' ELSE 'xh' END END AS train_lang,
  CASE WHEN k % 2 = 1 THEN CASE WHEN k % 4 = 1 THEN 'mmlu-college_medicine' ELSE 'winogrande' END END AS train_data,
  CASE WHEN k % 2 = 1 AND k % 3 = 1 THEN 'low' WHEN k % 2 = 1 AND k % 3 = 2 THEN 'high' END AS quality,
  CASE WHEN k % 2 = 1 AND k % 3 > 0 THEN CASE CAST(FLOOR(event_id / 15) AS BIGINT) % 4 WHEN 0 THEN '25%' WHEN 1 THEN '50%' WHEN 2 THEN '75%' ELSE '100%' END END AS pct_used,
  CASE WHEN event_id % 7 < 4 THEN 'Human - Upwork.com' WHEN event_id % 7 < 6 THEN 'Machine (gt)' ELSE 'Machine (bt)' END AS approach,
  CASE WHEN event_id % 7 < 6 THEN 'en' ELSE CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'af' WHEN 2 THEN 'zu' ELSE 'xh' END END AS source_lang,
  CASE WHEN event_id % 7 < 6 THEN CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'af' WHEN 2 THEN 'zu' ELSE 'xh' END ELSE 'en' END AS target_lang,
  CASE WHEN value > 30 + 5 * (user_id % 4) THEN 1 ELSE 0 END AS correct
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
""",
    "v_surveys": """
SELECT o_orderkey AS survey_key, CAST(FLOOR(o_orderkey / 4) AS BIGINT) AS item_id,
  CAST(FLOOR(o_orderkey / 1800) AS BIGINT) AS answer_item,
  CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'af' WHEN 2 THEN 'zu' ELSE 'xh' END AS lang,
  CASE o_custkey % 3 WHEN 0 THEN 'Completely wrong' WHEN 1 THEN 'Good translation' ELSE 'Understandable' END AS quality_1,
  CASE (o_custkey + CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'Completely wrong' WHEN 1 THEN 'Good translation' ELSE 'Understandable' END AS quality_2,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Do not understand' WHEN '2' THEN 'Maybe' WHEN '3' THEN 'Yes' ELSE 'No, the sentence is typical' END AS approp_1,
  CASE WHEN o_orderstatus = 'P' THEN 'No, the sentence is typical' WHEN o_orderstatus = 'F' AND substr(o_orderpriority, 1, 1) = '4' THEN 'Yes'
    WHEN substr(o_orderpriority, 1, 1) = '1' THEN NULL
    WHEN substr(o_orderpriority, 1, 1) = '2' THEN 'Maybe' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'Yes' ELSE 'No, the sentence is typical' END AS approp_2
FROM orders
""",
    "v_generations": """
SELECT event_id + c.n * 1000000000 AS event_id, model, custom_id,
  CASE WHEN c.n = 0 THEN content WHEN k % 3 = 0 THEN gold ELSE '' END AS content
FROM (SELECT event_id, k, event_type AS model,
  CASE WHEN event_id % 5 = 1 THEN CASE WHEN user_id % 2 = 0 THEN '1' ELSE '2' END
      ELSE CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END END AS gold,
  concat(event_type, '-on-', CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'af' WHEN 2 THEN 'zu' ELSE 'xh' END, '-',
    CASE event_id % 5 WHEN 0 THEN 'belebele' WHEN 1 THEN 'winogrande' WHEN 2 THEN 'mmlu-college_medicine'
      WHEN 3 THEN 'mmlu-clinical_knowledge' ELSE 'mmlu-virology' END, '-', CAST(event_id AS VARCHAR(20)), '-answer-',
    CASE WHEN event_id % 5 = 1 THEN CASE WHEN user_id % 2 = 0 THEN '1' ELSE '2' END
      ELSE CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END END) AS custom_id,
  CASE WHEN event_id % 5 = 1
    THEN CASE k % 5 WHEN 0 THEN '1' WHEN 1 THEN 'Option 2.' WHEN 2 THEN '1 or 2' WHEN 3 THEN 'neither' ELSE ' 2' END
    ELSE CASE k % 5 WHEN 0 THEN 'A' WHEN 1 THEN '(B) since' WHEN 2 THEN ' c' WHEN 3 THEN '' ELSE '()' END END AS content
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
) g JOIN (SELECT 0 AS n UNION ALL SELECT 1) c ON c.n = 0 OR event_id % 10 IN (1, 3)
""",
    "v_ratings": """
SELECT concat('gpt-4o-on-', CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'af' WHEN 2 THEN 'zu' ELSE 'xh' END, '-',
    CASE WHEN p_size % 2 = 0 THEN 'mmlu-college_medicine-dev' ELSE 'winogrande-train_s' END, '-', CAST(p_partkey AS VARCHAR(20)),
    '_vs_', CASE WHEN p_size % 3 = 0 THEN 'belebele' ELSE 'mmlu-virology' END, '_', CAST(t.trial AS VARCHAR(2))) AS custom_id,
  CAST((p_partkey * 7 + p_size * t.trial) % 10 + 1 AS VARCHAR(3)) AS content
FROM part CROSS JOIN (SELECT 0 AS trial UNION ALL SELECT 1 UNION ALL SELECT 2) t
""",
    "v_items": """
SELECT p_partkey AS item_no, p_type AS section,
  CASE WHEN p_partkey % 9 = 0 THEN 'dev' WHEN p_partkey % 9 < 3 THEN 'val' ELSE 'test' END AS split,
  CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'af' WHEN 2 THEN 'zu' ELSE 'xh' END AS lang,
  p_name AS question, p_brand AS opt_a, p_type AS opt_b, CAST(p_size AS VARCHAR(5)) AS opt_c, concat('x', CAST(p_partkey AS VARCHAR(20))) AS opt_d,
  CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS answer
FROM part
""",
    "v_translations": """
SELECT concat('q-', CASE doc_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN l ELSE concat('gt-', l) END, '-', CAST(item AS VARCHAR(20))) AS question_id,
  CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE l END AS target_lang,
  CASE WHEN doc_id % 3 = 2 THEN 'Machine' ELSE 'Human' END AS approach,
  CASE WHEN CAST(FLOOR(item / 3) AS BIGINT) % 2 = 0 THEN 'winogrande' ELSE 'mmlu' END AS benchmark,
  source AS translator, text AS question
FROM (SELECT *, CASE item % 3 WHEN 0 THEN 'af' WHEN 1 THEN 'zu' ELSE 'xh' END AS l
      FROM (SELECT *, CAST(FLOOR(doc_id / 3) AS BIGINT) AS item FROM documents) d0) d
""",
    "v_workflow": """
SELECT d.doc_id AS wkey, d.lang, d.source AS translator, d.text AS initial_text,
  CASE WHEN l.quality = 0 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'checked ' || d.text ELSE split_part(d.text, chr(10), 1) END END AS correction, l.quality, l.toxic,
  CASE WHEN d.n_chars % 11 = 0 THEN 'n/a' ELSE CAST(d.n_chars AS VARCHAR(12)) END AS dirty_number
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every fixture view it mentions."""
    used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v].strip()})" for v in used)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
