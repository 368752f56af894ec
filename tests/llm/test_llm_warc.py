import base64
import hashlib

from evalframe.llm import registry, warc
from llm_util import SF, same

DDL = "page_id long, url string, html string"


def run(spark, rows, tmp_path, ddl=DDL):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    return registry.queries()["op10_warc_transactions"](spark, str(tmp_path)).collect()


def test_query_matches_sql(spark):
    same(registry.queries()["op10_warc_transactions"](spark, SF), registry.oracle_sql()["op10_warc_transactions"])


def test_hostile_payloads_and_copies(spark, tmp_path):
    mark = "WARC/1.1\r\n"
    html = {1: mark, 2: f"a{mark}WARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n", 3: None, 4: "", 5: "\r\n\r\n", 6: "é" * 100_000,
            7: "é" * 100_000, 8: mark * 40 + "\r\n\r\n" + mark, 9: "same", 10: "same", 11: "same"}
    rows = [(k, f"http://x/{k}\r\nX: y", h, "clash") for k, h in html.items()] + [(11, None, "same", "clash"), (None, "u", "null id", None)]
    got = run(spark, rows, tmp_path, DDL + ", payload string")
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            assert r.record_type == "response" and r.payload_bytes == 7
            continue
        raw = (html[r.page_id] or "").encode()
        first = min(k for k, h in html.items() if (h or "").encode() == raw)
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))


def test_repeated_rows_and_empty_table(spark, tmp_path):
    got = run(spark, [(1, "u", "h")] * 3, tmp_path)
    assert sorted((r.record_type, r.refers_to) for r in got) == [("response", None), ("revisit", 1), ("revisit", 1)]
    assert run(spark, [], tmp_path) == []


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    same(registry.queries()["op10_warc_transactions"](spark, SF), registry.oracle_sql()["op10_warc_transactions"])


def test_assembly_keeps_unmatched_records(spark):
    recs = [("response", "<a>", None, "u", None, "D", "h", bytearray(b"p")), ("request", "<r1>", "<a>", "u", None, None, "g", bytearray()),
            ("request", "<r2>", "<a>", "u", None, None, "g", bytearray()), ("metadata", "<m>", "<zz>", "v", None, None, None, bytearray(b"k: 1\r\n")),
            ("warcinfo", "<w>", None, None, None, None, None, bytearray())]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(recs, warc.READ_SCHEMA)).collect()}
    assert set(got) == {"<a>", "<zz>"}
    assert got["<a>"].request.record_id == "<r1>" and got["<a>"].n_records == 3 and got["<zz>"].response is None


def test_minimum_size_keeps_small_ones_as_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long"), (4, "u", "long")], DDL)
    got = {r.id: r.is_response for r in warc.captures(pages, min_bytes=3).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False}
