"""WARC: a content-addressed archive of pages.

An archive is two tables in the shared folder. `payloads` holds the bytes of each distinct payload once, under its
SHA-256. `headers` holds each record's exact header block and the digest of its payload. Reading verifies every stored
payload against its key and every record's declared SHA-1 against the bytes, and puts records together by a join.
`record_bytes` gives the records as they stand in a WARC/1.1 file and `parsed` takes such bytes apart again;
`export_warc` and `read_warc` write and parse files, member by member.

Defined cases: a null payload is empty; a null url is an empty target; of rows that repeat page_id and payload one is
the response and the others revisit it; a null page_id sorts as the smallest and stays null; extra columns are ignored;
an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import fresh_path, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_NO_ID = -(1 << 63)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four of base 32."""
    text = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(text, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    h = F.sha2(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> None:
    """Stores pages (page_id, url, html). Of equal payloads of at least min_revisit_bytes the largest page_id is the response.

    Hashes alone are shuffled to find it, with a map-side half, so a payload that a third of the pages share costs a row a task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumns({"digest": F.sha2("payload", 256), "key": F.coalesce("page_id", F.lit(_NO_ID))})
    first = rows.select("digest", "key", F.xxhash64("payload").alias("check")).groupBy("digest").agg(F.max("key").alias("response"), F.min("check").alias("low"), F.max("check").alias("high"))
    sound = F.when(F.col("low") == F.col("high"), F.col("response")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("long"))
    chosen = first.select("digest", sound.alias("response"))
    copies = F.row_number().over(Window.partitionBy("digest", "key").orderBy("url"))
    stored = rows.join(chosen.withColumnRenamed("response", "key"), ["digest", "key"]).withColumn("copy", copies).where("copy = 1").select("digest", "payload")
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    facts = rows.select("page_id", "key", "url", "digest", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("sha1"))
    place = F.row_number().over(Window.partitionBy("digest", "key").orderBy("url"))
    said = facts.withColumn("copy", place).join(chosen, "digest")
    revisit = (F.col("size") >= min_revisit_bytes) & ((F.col("key") < F.col("response")) | (F.col("copy") > 1))
    target = F.when(F.col("response") != _NO_ID, F.col("response"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(target)), line("X-Refers-To-Page", F.coalesce(target.cast("string"), F.lit("null"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Page", F.coalesce(F.col("page_id").cast("string"), F.lit("null"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(revisit, 0).otherwise(F.col("size")) + len(HTTP)).cast("string")),
    )
    said.select("digest", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: page_id, record_type, refers_to, header, payload (of the response for revisits), payload_bytes, payload_digest.

    Payloads are verified before the join. Its payload side has one row a digest; a digest that many headers share is
    split by Spark's handling of skewed joins.
    """
    whole = F.sha2("payload", 256) == F.col("digest")
    payloads = spark.read.parquet(f"{path}/payloads").select(F.when(whole, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("a payload does not match its digest "), F.col("digest")))).alias("digest"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    headers = spark.read.parquet(f"{path}/headers").select("digest", "header", F.expr("try_cast(regexp_extract(header, '\\r\\nX-Page: ([^\\r\\n]*)\\r\\n', 1) as long)").alias("page_id"), _field("WARC-Type").alias("record_type"), F.expr("try_cast(regexp_extract(header, '\\r\\nX-Refers-To-Page: ([^\\r\\n]*)\\r\\n', 1) as long)").alias("refers_to"), _field("WARC-Payload-Digest").alias("said"))
    both = headers.join(payloads.hint("merge"), "digest")
    agreed = F.when(F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a record's digest does not match: "), F.col("said"))))
    return both.select("page_id", "payload_bytes", agreed.alias("payload_digest"), "record_type", "refers_to", "header", "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """page_id, payload and record: the whole record's bytes, with the two line ends that close it."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.select("page_id", "payload", F.concat(F.encode(F.concat("header", F.lit("\r\n" + HTTP)), "UTF-8"), body, F.lit(b"\r\n\r\n")).alias("record"))


def _taken_apart(record: memoryview) -> tuple[dict[str, str], memoryview]:
    """The fields of one record's header and its payload: the block after the HTTP header. Raises for what is no whole record."""
    head = bytes(record[: 1 << 16]).partition(b"\r\n\r\n")[0]
    if len(head) >= (1 << 16) - 4:
        head = bytes(record).partition(b"\r\n\r\n")[0]
    version, *rest = head.decode().split("\r\n")
    fields = dict(line.partition(": ")[::2] for line in rest)
    block = record[len(head) + 4 : len(head) + 4 + int(fields["Content-Length"])]
    if version != "WARC/1.1" or bytes(record[len(head) + 4 + len(block) :]) != b"\r\n\r\n":
        raise ValueError(f"a record of {len(record)} bytes does not end where its header says")
    if "application/http" in fields.get("Content-Type", ""):
        at = bytes(block[: 1 << 12]).find(b"\r\n\r\n")
        at = bytes(block).find(b"\r\n\r\n") if at < 0 else at
        block = block[at + 4 :] if at >= 0 else block[len(block) :]
    return fields, block


def parsed(records: DataFrame) -> DataFrame:
    """From record_bytes: page_id, record_type, refers_to, payload_bytes and payload_digest of what the records hold, a revisit's from the payload it refers to.

    Every record is parsed as a file's member is; its payload's length and SHA-1 are taken from the bytes and the digest is held against the header's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x in (None, "null") else int(x)
        for batch in batches:
            out: list[tuple] = []
            for payload, record in zip(batch.column(1), batch.column(2), strict=True):
                fields, body = _taken_apart(memoryview(record.as_buffer()))
                body = memoryview(payload.as_buffer()) if fields["WARC-Type"] == "revisit" else body
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError(f"a record's payload has another digest than {fields['WARC-Payload-Digest']}")
                out.append((number(fields["X-Page"]), fields["WARC-Type"], number(fields.get("X-Refers-To-Page")), len(body), digest))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])

    return records.select("page_id", "payload", "record").mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string")


def export_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes WARC/1.1 files, one a task, through Spark's own writer so that any store will do."""
    whole = F.decode(F.expr("substring(record, 1, octet_length(record) - 4)"), "UTF-8")
    record_bytes(records).select(whole.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _members(content: bytes, zipped: bool) -> Iterator[bytes]:
    """The records of a file, one after another; a zipped file is unpacked as far as its next record needs."""
    source, held, at = (gzip.GzipFile(fileobj=io.BytesIO(content)) if zipped else io.BytesIO(content)), b"", 0

    def upto(n: int) -> bool:
        nonlocal held, at
        if len(held) - at < n:
            more = [held[at:]]
            while (size := sum(map(len, more))) < n and (part := source.read(max(1 << 16, n - size))):
                more.append(part)
            held, at = b"".join(more), 0
        return len(held) - at >= n

    while upto(1):
        n = 1 << 12
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not upto(n):
                raise ValueError("a file ends within a header")
            n *= 2
        size = end - at + 4 + int(re.search(rb"\r\nContent-Length: *(\d+)", held[at:end])[1]) + 4
        if not upto(size):
            raise ValueError("a file ends within a record")
        yield held[at : at + size]
        at += size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Parses WARC files (plain or gzip): header, record_type, payload (binary: the block after its HTTP header).

    A worker holds one packed file and one of its records at a time.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["header", "record_type", "payload"])

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, size = [], 0
                for record in _members(content.as_py(), name.endswith(".gz")):
                    fields, body = _taken_apart(memoryview(record))
                    found.append((record.partition(b"\r\n\r\n")[0].decode() + "\r\n", fields["WARC-Type"], bytes(body)))
                    size += len(record)
                    if size >= 1 << 22:
                        yield rows(found)
                        found, size = [], 0
                if found:
                    yield rows(found)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "header string, record_type string, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    return parsed(record_bytes(read_archive(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS top FROM p),
b AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(hex, (5 * g + 1)::INT, 5))::BIGINT) AS groups FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((groups[i // 4 + 1] >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b
"""
