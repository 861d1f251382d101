"""WARC archives: writing with revisit records, and reading back.

Writing shuffles the headers alone by payload digest to find the original of each
group of equal payloads, then writes the payload of originals once and a revisit
record for each copy. Archives are gzipped WARC/1.1 files that Spark's text writer
makes, so they can be in any store that Spark writes to. Reading streams each file
line by line into a parser that follows Content-Length, so memory is bounded by the
largest record, and payloads may hold anything, even WARC records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.llm.common import fresh_path, small_batches, table

SMALLEST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: What could end a header's line or value, and the sign of the code itself.
_CODES = {"%": "%25", "\r": "%0D", "\n": "%0A", "\x00": "%00", " ": "%20"}


def _clean(column: str) -> F.Column:
    """A header's value, from which _unclean() gives back any string."""
    c = F.coalesce(F.col(column).cast("string"), F.lit(""))
    for char, code in _CODES.items():
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def resolve(headers: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """Adds record_type and refers_to to (page_id, payload_digest, payload_bytes, ...).

    Originals are the smallest page_id of each digest, found by partial aggregation.
    Only digests with more than one page are joined back. Rows that repeat the
    original's page_id and payload are responses too. Null ids are revisits of an original that has
    an id; where all of a digest's ids are null, all are responses.
    """
    originals = headers.where(F.col("payload_bytes") >= smallest).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    joined = headers.join(originals, "payload_digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("refers_to")))


def write_archives(pages: DataFrame, path: str, payload: str = "html", date: str | None = None, smallest: int = SMALLEST) -> str:
    """Writes one record per row of pages (page_id, url, payload column) under path.

    A null payload is empty, a null url is written as an empty target; any other url reads back as it
    was. Headers carry the date given, or else the time of the call. Other columns
    are not read. Each task writes one file; an empty table gives an archive without
    records.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload), F.lit("")).cast("string")
    headers = pages.select("page_id", F.sha2(body.cast("binary"), 256).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    # Copies, and their targets: all that the writer has to know beside the page itself.
    decided = resolve(headers, smallest).where("record_type = 'revisit'").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("held"), "refers_to").distinct()
    digest = F.sha2(body.cast("binary"), 256)
    rows = pages.select("page_id", _clean("url").alias("target"), body.alias("body"), digest.alias("payload_digest"))
    rows = rows.join(decided, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("held")), "left")
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("body")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))

    def record_id(of):
        h = F.md5(F.concat(F.lit("page:"), of))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))

    original = F.col("refers_to").cast("string")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), record_id(page),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("target"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.lit("\r\nWARC-X-Page: "), page,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), record_id(original), F.lit("\r\nWARC-X-Refers-To-Page: "), original, F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Truncated: length"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"),
    )
    rows.select(record.alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)
    return path


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_DDL = "page_id long, url string, record_type string, payload_digest string, declared_digest string, payload_bytes long, refers_to long, payload binary"


_CODE = re.compile("|".join(_CODES.values()))


def _unclean(value: bytes) -> str:
    return _CODE.sub(lambda m: chr(int(m[0][1:], 16)), value.decode("utf-8", "replace"))


def _parse(buffer: bytearray, at: int, with_payload: bool) -> tuple[dict | None, int]:
    """The record that starts at ``at``, or None if more bytes are needed; where it ends."""
    end = buffer.find(b"\r\n\r\n", at)
    if end < 0:
        return None, at
    if not buffer.startswith(b"WARC/1.", at):
        raise ValueError(f"no WARC record where one is due: {bytes(buffer[at : at + 40])!r}")
    fields = {k.lower(): v for k, v in _FIELD.findall(bytes(buffer[buffer.find(b"\r\n", at) + 2 : end + 2]))}
    begin, length = end + 4, int(fields[b"content-length"])
    if len(buffer) < begin + length + 4:
        return None, at
    if buffer[begin + length : begin + length + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is longer or shorter than its Content-Length")
    block = bytes(buffer[begin : begin + length])
    _, _, payload = block.partition(b"\r\n\r\n")
    kind = fields[b"warc-type"].decode()
    whole = kind != "revisit"
    page, target = fields.get(b"warc-x-page", b"null"), fields.get(b"warc-x-refers-to-page")
    row = {
        "page_id": None if page == b"null" else int(page), "url": _unclean(fields.get(b"warc-target-uri", b"")), "record_type": kind,
        "payload_digest": hashlib.sha256(payload).hexdigest() if whole else None, "declared_digest": fields[b"warc-payload-digest"].decode().removeprefix("sha256:"),
        "payload_bytes": len(payload) if whole else None, "refers_to": int(target) if target else None, "payload": payload if with_payload and whole else None,
    }
    return row, begin + length + 4


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, source, rows, held = bytearray(), None, [], 0
        for batch in batches:
            for line, file in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if file != source:
                    if buffer.strip():
                        raise ValueError(f"{source} ends inside a record")
                    buffer, source = bytearray(), file
                buffer += line + b"\n"
                if not line.endswith(b"\r"):
                    continue
                row, end = _parse(buffer, 0, with_payload)
                if row:
                    del buffer[:end]
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, _ROW)
                        rows, held = [], 0
        if buffer.strip():
            raise ValueError(f"{source} ends inside a record")
        yield pa.RecordBatch.from_pylist(rows, _ROW)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of all archives under path; what a revisit does not hold is null there."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(_reader(with_payload), _DDL)


def resolved(records: DataFrame) -> DataFrame:
    """Joins revisit records to the responses that hold their payload."""
    held = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest")).agg(F.max("payload_bytes").alias("held_bytes"), F.max("payload_digest").alias("held_digest"))
    joined = records.join(held, ["refers_to", "declared_digest"], "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "held_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "held_digest").alias("payload_digest"), "record_type", "refers_to")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(read_archives(spark, path))


SQL = """
with h as (select page_id, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
o as (select payload_digest, min(page_id) as first from h where payload_bytes >= 100 group by payload_digest)
select h.page_id, h.payload_bytes, h.payload_digest,
       case when o.first <> h.page_id then 'revisit' else 'response' end as record_type,
       case when o.first <> h.page_id then o.first end as refers_to
from h left join o using (payload_digest)
"""
