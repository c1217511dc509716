"""Revisit resolution: payload headers meet by digest, repeats become revisit records, and deduplicated archives are written with fresh headers.

Only headers (row, id, digest, length) are shuffled by digest; payloads are moved once, to the archive they go to. The writer is Spark's text
sink: one record is one row, and the blank line that ends a WARC record is the row separator, so any file system Spark writes to will do.
The reader takes whole files, as gzip can't be split; archives hold about ARCHIVE_BYTES of payload each, so that one fits a task.

Defined cases: a null payload is empty; a null page id sorts last and is written as an empty field; equal payloads with equal ids (repeated
rows) are one response and revisits of it; control characters in a URL are percent-encoded; a null URL is empty. Payloads shorter than
``min_bytes`` are all responses. Other columns are not read. An empty table writes no record and reads back as no rows.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pavesa.llm.common import numbered, scratch_path

ARCHIVE_BYTES = 16_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, record_type string, record_id string, refers_to_record string, refers_to bigint, payload_bytes bigint, payload_digest string"


def payload_digest(payload: Column) -> Column:
    """Base32 SHA-1 of a text in UTF-8: five hex digits are four base-32 digits."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame) -> DataFrame:
    """Digest and length of each payload, by row number."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("row", F.col("page_id").cast("long").alias("page_id"), payload_digest(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """row, digest, size and, for revisits, the id and row of the response: of equal payloads the one with the smallest (page id, row).

    The minimum is taken per task before the shuffle; the join back is one that adaptive execution can split when a digest is common.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("row").alias("row"))
    first = heads.groupBy("digest").agg(F.min(order).alias("first"))
    again = (F.col("size") >= min_bytes) & (F.col("first.row") != F.col("row"))
    return heads.join(first, "digest").select("row", "digest", "size", F.when(again, F.col("first.id")).alias("first_id"), F.when(again, F.col("first.row")).alias("first_row"))


def _record_id(page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> None:
    """One record for each row of page_id, url, html, in gzip files under ``path``."""
    rows = numbered(pages.select("page_id", "url", "html"))
    heads = headers(rows)
    total = heads.agg(F.sum("size")).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    fate = resolve(heads, min_bytes).repartition(archives, "row")
    placed = rows.repartition(archives, "row").join(fate, "row")
    revisit = F.col("first_row").isNotNull()
    url = F.coalesce("url", F.lit(""))
    for code in (*range(32), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("row"))), F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("first_id"), F.col("first_row")))),
        F.concat(F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string")),
    )
    record = F.concat(head, F.lit("\r\n\r\n"), http, F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit(""))))
    placed.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _fields(stream: io.BufferedIOBase) -> dict[str, str]:
    """Header lines up to the blank one."""
    out = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC fields, HTTP fields and payload of each record of a gzip archive."""
    with gzip.open(io.BytesIO(archive)) as stream:
        while start := stream.readline():
            if not start.strip():
                continue
            if not start.startswith(b"WARC/"):
                raise ValueError(f"no record starts with {start[:40]!r}")
            fields = _fields(stream)
            block = io.BytesIO(stream.read(int(fields["content-length"])))
            block.readline()
            http = _fields(block)
            yield fields, http, block.read()


def _own(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").split(":")[0]
    return int(number) if number else None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of archives; a response whose payload doesn't fit its digest ends the job. ``payloads`` adds the bytes (null: revisit)."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        schema = pa.schema([(n, pa.int64() if n in ("page_id", "refers_to", "payload_bytes") else pa.string()) for n in names] + [("payload", pa.binary())] * payloads)
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, http, payload in parse(content.as_py()):
                    kind, digest, target = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("warc-refers-to")
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't fit its digest")
                    row = dict(zip(names, (_own(fields["warc-record-id"]), fields["warc-target-uri"], kind, fields["warc-record-id"], target, _own(target) if target else None, int(http["content-length"]), digest), strict=True))
                    rows.append(row | ({"payload": payload if kind == "response" else None} if payloads else {}))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(records, RECORD + ", payload binary" * payloads)


def restored(records: DataFrame) -> DataFrame:
    """Every record with its payload: revisits join the response they name. Needs ``read(payloads=True)``."""
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload").alias("_payload"))
    joined = records.join(originals, F.coalesce("refers_to_record", "record_id") == F.col("_id"), "left")
    return joined.withColumn("payload", F.col("_payload")).drop("_id", "_payload")


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages to new archives in the shared folder and reads their records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes)
    return read(pages.sparkSession, path)
