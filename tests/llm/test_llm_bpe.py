import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from evalframe.llm import bpe, registry
from evalframe.llm.tokens import file_encoder
from llm_util import SF, table

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "a", "don't we'll they're I've it's 'r 're", "x" * 700, " " * 500 + "y", "tab\t\tnew\n\n\n  line  ", "nb sp em\x1cfs\x85nel",
         "日本語のテキスト、漢字。" * 40, "🙂👩‍👩‍👧 é " * 30, ("word " * 200) + "'" + "s" * 90, "12345678901234567890" * 20, "'ll" * 150, "a'" * 120 + "re",
         "\n" * 300, " \n" * 200 + "z", "Mixed 12ab!!?? --- \r\n done " * 25]


@pytest.fixture(scope="module")
def lib():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("lib", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def joined(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.doc_id, r.uid), []).append(r)
    res = {}
    for k, v in out.items():
        v.sort(key=lambda r: r.piece)
        assert [r.piece for r in v] == list(range(v[0].n_pieces))
        res.setdefault(k[0], []).append((np.concatenate([np.frombuffer(r.ids, "<u4") for r in v]).tolist(), b"".join(bytes(r.raw) for r in v)))
    return res


def test_chunks_of_any_size_give_the_library_ids(spark, lib):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(1, "", "x", 1), (3, TEXTS[3], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string, piece int")
    for chunk, overlap in ((64, 16), (200, 40), (32_768, 512)):
        got = joined(bpe.decode(bpe.encode(docs, PATH, P.PATTERN, chunk=chunk, overlap=overlap), PATH, P.PATTERN))
        for i, t in enumerate(TEXTS):
            t = t or ""
            assert got[i][0] == (lib.encode_ordinary(t), t.encode()), (chunk, i)
        assert len(got[1]) == 2 and len(got[3]) == 2 and got[3][0] == got[3][1]


def test_cuts_are_made(spark):
    docs = spark.createDataFrame([(0, "word and more " * 400)], "doc_id long, text string")
    assert bpe.encode(docs, PATH, P.PATTERN, chunk=256, overlap=64).count() > 10


def test_query_matches_the_library(spark, lib):
    docs = {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}
    rows = registry.queries()["op3_bpe_roundtrip"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = lib.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_very_long_runs():
    from evalframe.llm.tokens import rank_encoder

    enc = rank_encoder(PATH, P.PATTERN)
    text = " " * 300_000 + "x" + "ab" * 100_000
    ids = np.frombuffer(enc.encode(text), "<u4").tolist()
    assert b"".join(enc.bytes_of[i] for i in ids).decode() == text


def test_file_encoder_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc = file_encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in [x or "" for x in TEXTS] + ["a <|endoftext|> b", "x  <|endoftext|>  y<|endoftext|>"]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t[:40]
