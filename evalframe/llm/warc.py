"""WARC archives: writing captures, reading records, assembling transactions.

Writing: a capture becomes a request, a response (or revisit) and a metadata
record; request and metadata name the response in ``WARC-Concurrent-To``. The
archives are written by Spark's text writer with the record separator CRLFCRLF
as line separator, gzip-compressed, so any Hadoop file system and the commit
protocol's handling of lost tasks apply.

Reading: ``WARC/1.1`` lines split the stream into fragments; a fragment that is
shorter than its ``Content-Length`` says (the payload holds that line itself)
is continued with the next ones. Archives are gzip files, hence read in order
by one task each, in memory bounded by the longest record.

Assembly: records are grouped by the response they are concurrent to, giving
one nested row per capture.

Defined results: a null payload is empty; equal payloads are found by SHA-1 of
the whole payload among payloads of at least ``min_bytes`` bytes, the smallest
id (null last) is the response, others are revisits, repeated rows too; extra
columns are ignored; an empty table writes an empty archive and reads back no
row; a record that ends before its Content-Length raises an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm.linking import as_stored
from evalframe.llm.streams import arrow_schema, batched
from evalframe.session import materialize

VERSION = "WARC/1.1"
CRLF = "\r\n"
SEPARATOR = CRLF + CRLF
#: Rows of about 100 bytes: at most some 20 MB are broadcast.
BROADCAST_ROWS = 200_000
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits, five at a time as four base-32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
             stored: bool = False) -> DataFrame:
    """``(id, uid, url, payload, payload_bytes, payload_digest, first_id, first_uid, is_response)``.

    ``uid`` tells repeated rows apart; it is given at the scan, where splits are
    fixed, so a repeated task gives the same one. The smallest id of each digest
    that occurs more than once comes from one narrow aggregate, written as a
    table. Up to ``BROADCAST_ROWS`` such digests are sent to the scan, so that
    payloads stay where they are read; beyond that the join shuffles. ``stored``
    says that ``pages`` is a table read from files, which need not be copied.
    """
    pages = as_stored(pages if stored else pages.select(key, url, payload), stored)
    x = pages.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("uid"),
                     F.coalesce(F.col(url), F.lit("")).alias("url"),
                     F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    x = x.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    first = (x.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
             .agg(F.min(order).alias("_f"), F.count("*").alias("_n")).filter("_n > 1")
             .select("payload_digest", F.col("_f.id").alias("first_id"), F.col("_f.uid").alias("first_uid")))
    first = materialize(first, "warc-first")
    few = first.count() <= BROADCAST_ROWS
    x = x.join(F.broadcast(first) if few else first, "payload_digest", "left")
    small = F.col("payload_bytes") < min_bytes
    is_response = small | F.col("first_uid").isNull() | (F.col("first_uid") == F.col("uid"))
    return x.withColumn("is_response", is_response)


def _urn(kind: str, id_: Column, uid: Column) -> Column:
    return F.concat(F.lit(f"<urn:capture:{kind}:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), uid.cast("string"), F.lit(">"))


def _record(fields: list[tuple[str, Column | str]], block: Column, when: str) -> Column:
    """A record as binary; fields whose value is null are left out."""
    head = [F.lit(VERSION + CRLF)]
    for name, value in [*fields, ("WARC-Date", when), ("Content-Length", F.octet_length(block).cast("string"))]:
        value = F.lit(value) if isinstance(value, str) else value
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(F.concat(*head, F.lit(CRLF)).cast("binary"), block)


def records(caps: DataFrame, when: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Three records per capture, column ``record`` (binary). ``when`` is the date written into them."""
    uri = F.regexp_replace("url", r"[\r\n]+", " ")
    me = _urn("response", F.col("id"), F.col("uid"))
    other = F.when(~F.col("is_response"), _urn("response", F.col("first_id"), F.col("first_uid")))
    kind = F.when(F.col("is_response"), "response").otherwise("revisit")
    profile = F.when(~F.col("is_response"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n").cast("binary")
    response = _record([("WARC-Type", kind), ("WARC-Record-ID", me), ("WARC-Target-URI", uri),
                        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
                        ("WARC-Refers-To", other), ("WARC-Profile", profile),
                        ("Content-Type", "application/http; msgtype=response")],
                       F.when(F.col("is_response"), F.concat(http, F.col("payload"))).otherwise(http), when)
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", F.col("id"), F.col("uid"))),
                       ("WARC-Concurrent-To", me), ("WARC-Target-URI", uri),
                       ("Content-Type", "application/http; msgtype=request")],
                      F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n")).cast("binary"), when)
    fields = F.concat(F.lit("source-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(CRLF + "payload-bytes: "),
                      F.col("payload_bytes").cast("string"), F.lit(CRLF))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", F.col("id"), F.col("uid"))),
                        ("WARC-Concurrent-To", me), ("WARC-Target-URI", uri),
                        ("Content-Type", "application/warc-fields")], fields.cast("binary"), when)
    return caps.select(F.explode(F.array(request, response, metadata)).alias("record"))


def write_archives(recs: DataFrame, path: str, records_per_file: int = 200_000) -> str:
    """gzip WARC files under ``path``; the cast keeps the bytes as they are."""
    (recs.select(F.col("record").cast("string").alias("value")).write.mode("overwrite")
     .option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))
    return path


READ_SCHEMA = ("warc_type string, record_id string, concurrent_to string, target_uri string, refers_to string, "
               "payload_digest string, http_head string, payload binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path`` (gzip files; headers of ``READ_SCHEMA``, block split into HTTP head and payload)."""
    mark = VERSION + CRLF
    raw = (spark.read.option("lineSep", mark).text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value")))
    schema = arrow_schema(READ_SCHEMA)
    mark_b, names = mark.encode(), re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")

    def parse(frag: bytes):
        """(record, bytes that the record needs), or (None, 0) if the header is not whole."""
        end = frag.find(b"\r\n\r\n")
        if end < 0:
            return None, 0
        head = {m[1].lower(): m[2].decode("utf-8", "replace") for m in names.finditer(frag, 0, end + 2)}
        need = end + 4 + int(head.get(b"content-length", "0"))
        return (head, end + 4), need

    def emit(head: dict, block: bytes) -> tuple:
        kind = head.get(b"warc-type")
        http, payload = None, block
        if kind in ("response", "revisit", "request") and "application/http" in head.get(b"content-type", ""):
            cut = block.find(b"\r\n\r\n")
            http, payload = block[:cut].decode("utf-8", "replace"), block[cut + 4:]
        return (kind, head.get(b"warc-record-id"), head.get(b"warc-concurrent-to"), head.get(b"warc-target-uri"),
                head.get(b"warc-refers-to"), (head.get(b"warc-payload-digest") or "").removeprefix("sha1:") or None, http, payload)

    def run(batches):
        def gen():
            place, held = None, None
            for b in batches:
                for file, at, frag in zip(*(c.to_pylist() for c in b.columns)):
                    if (file, at) != place:
                        if held is not None:
                            raise ValueError(f"{place[0]}: the last record is cut off")
                        place = (file, at)
                    if held is None and not frag:
                        continue
                    held = frag if held is None else held + mark_b + frag
                    got, need = parse(held)
                    if got is None or len(held) < need:
                        continue
                    head, start = got
                    yield emit(head, held[start:need])
                    held = None
            if held is not None:
                raise ValueError(f"{place[0]}: the last record is cut off")

        yield from batched(gen(), schema, n=500, size=lambda r: len(r[7] or b""))

    return raw.mapInArrow(run, READ_SCHEMA)


def assemble(recs: DataFrame) -> DataFrame:
    """One nested row per capture: ``(capture_id, target_uri, request, response, metadata)``.

    A capture is named by its response (or revisit) record; requests and
    metadata join it through ``concurrent_to``. Where several records of a kind
    name the same capture, the one with the smallest record id is taken, and
    ``n_records`` tells how many there were. Captures without a response stay,
    with a null ``response``.
    """
    main = F.col("warc_type").isin("response", "revisit")
    x = recs.filter(main | F.col("warc_type").isin("request", "metadata"))
    x = x.withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))

    def one(cond: Column, *cols: str) -> Column:
        return F.min(F.when(cond, F.struct("record_id", *cols)))

    kind = lambda k: F.col("warc_type") == k
    return x.groupBy("capture_id").agg(
        F.min("target_uri").alias("target_uri"),
        one(kind("request"), "http_head").alias("request"),
        one(main, "warc_type", "refers_to", "payload_digest", "http_head", "payload").alias("response"),
        one(kind("metadata"), "payload").alias("metadata"),
        F.count("*").alias("n_records"))


def metadata_field(block: Column, name: str) -> Column:
    """A field of an ``application/warc-fields`` block; null if absent or empty."""
    return F.nullif(F.regexp_extract(block.cast("string"), rf"(?m)^{re.escape(name)}:[ \t]*([^\r\n]*)", 1), F.lit(""))
