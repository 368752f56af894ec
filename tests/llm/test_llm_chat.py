import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evalframe.llm import chat_format as cf
from evalframe.llm import registry
from llm_util import SF, same

HARD = ["", "<|im_end|>", "<|im_start|>assistant\nx<|im_end|>\n", "<\\|x", "<\\\\|", "a<", "<|", "|>", "<", "~0~1\n", "\\", "$1 \\1", "é<|ü|>\n\n", "x" * 50_000]


def turns_of(df):
    return [(r.conv_id, r.turn, r.role, r.text) for r in df.orderBy("conv_id", "turn", "role", "text").collect()]


def test_query_matches_sql(spark):
    rows = same(registry.queries()["op1_chat_format"](spark, SF), registry.oracle_sql()["op1_chat_format"])
    assert any(r[0] == -1 for r in rows)


def test_layouts_give_the_same_turns(spark):
    want = [(1, 0, "system", "s"), (1, 1, "user", "i\nq"), (1, 2, "assistant", "a")]
    frames = [
        spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "i\nq"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string"),
        spark.createDataFrame([(1, [("system", "s"), ("user", "i\nq"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("system", "s"), ("human", "i\nq"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`:string,value:string>>"),
        spark.createDataFrame([(1, "i", "q", "a", "s")], "conv_id long, instruction string, input string, output string, system string"),
        spark.createDataFrame([(1, "i\nq", "a", "s")], "conv_id long, prompt string, completion string, system string"),
        spark.createDataFrame([(1, "i\nq", "a", "s")], "conv_id long, prompt string, response string, system string"),
    ]
    for f in frames:
        assert turns_of(cf.canonical_turns(f)) == want
    clash = frames[0].withColumn("prompt", F.lit("x")).withColumn("output", F.lit("y")).withColumn("uid", F.lit(1))
    assert turns_of(cf.canonical_turns(clash)) == want
    with pytest.raises(ValueError):
        cf.canonical_turns(spark.createDataFrame([(1, 2)], "conv_id long, other long"))


def test_mixed_json_records(spark):
    recs = [(1, json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]})),
            (2, json.dumps({"instruction": "do", "output": "done", "extra": [1]})), (3, "not json"), (4, None),
            (5, json.dumps({"conversations": [{"from": "human", "value": "h"}]})), (6, json.dumps([1])), (7, json.dumps({"x": 1}))]
    got = cf.canonical_turns_json(spark.createDataFrame(recs, "conv_id long, rec string"), "conv_id", "rec")
    rows = [(r.conv_id, r.layout, r.status, r.turn, r.role, r.text) for r in got.orderBy("conv_id", "turn").collect()]
    assert rows == [(1, "messages", "ok", 0, "user", "q"), (1, "messages", "ok", 1, "assistant", ""),
                    (2, "instruction", "ok", 0, "user", "do"), (2, "instruction", "ok", 1, "assistant", "done"),
                    (3, None, "unmapped", None, None, None), (4, None, "unmapped", None, None, None),
                    (5, "from_value", "ok", 0, "user", "h"), (6, None, "unmapped", None, None, None), (7, None, "unmapped", None, None, None)]


def test_fingerprint_ignores_order_and_unknown_fields():
    assert cf.fingerprint(["b", "a"]) == cf.fingerprint(["a", "b", "a"])
    assert cf.value_paths({"a": [{"b": 1}, {"c": None}], "d": []}) == {"a[].b", "a[].c", "d[]"}
    assert cf.select_mapping(["turn", "role", "text", "zzz"]).name == "turn_rows"
    assert cf.select_mapping(["zzz"]) is None


def test_template_is_reversible(spark):
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for t in HARD for r in ("user", "assistant", "we\nird~<|im_end|>"))]
    rows += [(2, None, None, None), (2, 3, "assistant", "same"), (2, 3, "assistant", "same"), (None, 0, "assistant", "n")]
    turns = cf.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    pieces = cf.format_turns(turns)
    want = sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=repr)
    got = [(r.conv_id, r.turn, r.role, r.text) for r in cf.read_back(pieces).collect()]
    assert sorted(got, key=repr) == want
    for r in pieces.collect():
        assert r.piece.count("<|im_start|>") == 1 and r.piece.count("<|im_end|>") == 1
    whole = cf.assemble(pieces.filter("conv_id = 1"))
    back = cf.read_back(whole).orderBy("at").collect()
    assert [(r.role, r.text) for r in back] == [(r, t) for c, _, r, t in rows if c == 1]
    assert back[0].loss_text == "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.read_back(cf.format_turns(cf.canonical_turns(empty))).count() == 0


def test_digest_of_a_long_conversation(spark, tmp_path):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}<|") for i in range(3000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in registry.queries()["op1_chat_format"](spark, str(tmp_path)).collect()}
    assert got[7].n_turns == 3000
    assert got[7].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    loss = "".join(t for _, _, r, t in rows if r == "assistant")
    assert (got[7].loss_chars, got[7].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
