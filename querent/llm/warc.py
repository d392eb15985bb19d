r"""WARC archives and revisit resolution.

Records are written by Spark's own text writer: a record is a row, and the
``\r\n\r\n`` that ends it is the line separator.  So files are committed
whole or not at all, wherever the shared folder is, and a lost executor's work
is simply done again.

Only headers (page id and payload digest) are shuffled to find originals; the
payloads move once, to meet the decisions by page id.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: Column) -> Column:
    """SHA-1 of the UTF-8 bytes in base32, as WARC headers carry it."""
    hexed = F.sha1(payload)
    letters = []
    for start in range(1, 41, 5):
        bits = F.conv(F.substring(hexed, start, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(31) + 1
            letters.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*letters)


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("none")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Decision per page: its payload's digest, and the original it revisits.

    Of the pages whose equal payloads have ``min_bytes`` or more, that with the
    smallest page_id (nulls last) is the original and the others are revisits.
    Pages that repeat both page_id and payload of the original are responses
    too.  A null payload is an empty one.
    """
    headers = pages.select(
        "page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("payload_bytes"),
        payload_digest(F.coalesce("html", F.lit(""))).alias("payload_digest"),
    ).where(F.col("payload_bytes") >= min_bytes)
    originals = (
        headers.groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and refers_to is not null")
    )
    return (
        headers.join(originals, "payload_digest")
        .where("page_id is null or page_id <> refers_to")
        .select("page_id", "payload_digest", "refers_to")
        .distinct()
    )


def write_archive(
    pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 2_000,
    date: datetime | None = None,
) -> None:
    """Write ``pages`` (page_id, url, html) as deduplicated WARC files.

    Revisits carry fresh headers: the original's record id and page id, the full
    payload's digest and length, and no payload.  Files are gzipped and hold at
    most ``records_per_file`` records, which bounds what a reader holds.  Line
    breaks in a url become spaces; a null url is left out.
    """
    stamp = (date or datetime(2000, 1, 1, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "payload_digest", payload_digest(F.col("html"))
    )
    decided = resolve_revisits(pages, min_bytes).alias("d")
    at = full.alias("p").join(
        decided,
        F.col("p.page_id").eqNullSafe(F.col("d.page_id"))
        & (F.col("p.payload_digest") == F.col("d.payload_digest")),
        "left",
    )
    page, digest, origin = F.col("p.page_id"), F.col("p.payload_digest"), F.col("d.refers_to")
    size = F.octet_length("html").cast("string")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END)
    )
    block = F.when(origin.isNull(), F.concat(http, "html")).otherwise(http)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)  # noqa: E731  null leaves the line out
    url = F.regexp_replace("url", "[\\r\\n]", " ")
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(origin.isNull(), "response").otherwise("revisit")),
        line("WARC-Record-ID", _record_id(page, digest)),
        F.lit(f"WARC-Date: {stamp}"),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(origin.isNotNull(), f"WARC-Profile: {PROFILE}"),
        F.when(origin.isNotNull(), line("WARC-Refers-To", _record_id(origin, digest))),
        line("X-Page-ID", page.cast("string")),
        line("X-Refers-To-Page-ID", origin.cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    (
        at.withColumn("block", block)
        .select(F.concat(header, F.lit(END), "block").alias("value"))
        .write.option("lineSep", END).option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(path)
    )


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        head = archive[at:end].decode("utf-8").split("\r\n")
        if head[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in head[1:])
        start = end + 4
        at = start + int(fields["Content-Length"])
        yield fields, archive[start:at]
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record does not end at byte {at}")
        at += 4


def _parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import base64
    import gzip
    import hashlib

    for batch in files:
        for content in batch["content"]:
            rows = []
            for fields, block in records(gzip.decompress(content)):
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http.rpartition(b": ")[2])
                if fields["WARC-Type"] == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (found, len(payload)) != (digest, size):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                page, origin = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                rows.append((
                    None if page is None else int(page), size, digest, fields["WARC-Type"],
                    None if origin is None else int(origin),
                ))
            yield pd.DataFrame(
                rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            ).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives; damaged payloads raise an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(_parse, RECORDS)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to deduplicated archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path, min_bytes)
    return read_archive(spark, path)
