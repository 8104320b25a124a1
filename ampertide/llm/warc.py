"""WARC archives with revisit resolution.

Headers (identifier, payload digest, length) are shuffled by digest to find the original of
each payload; payloads then move once, together with the decision on them, and are written
as deduplicated archives: responses hold the payload, revisits only fresh headers that refer to
the original's record id. Rendering is column expressions and Spark's text writer (whose
line separator is the blank line that ends a record), so archives can lie in any store that
Spark writes. Files are gzipped and hold at most `FILE_RECORDS` records.

Reading takes one file per row, decompresses it as a stream and parses record by record, so
only one payload is held at a time; digests are computed anew from the payload. Revisits
are then joined to the responses they name.

Defined results: null html is an empty payload; a null page_id loses against any other as the
original; of fully repeated rows one is the original and the others revisit it; a null url
leaves the target header out, and control characters and spaces in a url are percent-encoded;
an empty table writes an archive without records; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampertide.session import cut, scratch_path

from .common import text_of

MIN_BYTES = 1000
FILE_RECORDS = 4096
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"

PARSED = "record_id string, page_id string, record_type string, payload_bytes long, payload_digest string, refers_to_id string"


def _record_id(*parts):
    """A uuid that follows from page, payload and count, so a rewritten archive keeps its ids."""
    h = F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]).cast("binary"))
    at = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *at), F.lit(">"))


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, nth, original, revisit): nth counts rows of one page
    and payload; original is the page that keeps the payload."""
    payload = text_of("html")
    rows = pages.select(
        F.col("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("~")).alias("page"),
        F.sha1(payload.cast("binary")).alias("digest"), (F.octet_length(payload) >= min_bytes).alias("large"),
    )
    headers = rows.filter("large").select("page", "page_id", "digest")
    held = headers.groupBy("digest", "page", "page_id").agg(F.count(F.lit(1)).alias("n"))
    originals = held.groupBy("digest").agg(F.max("page_id").alias("original"), F.sum("n").alias("copies"))
    told = held.join(originals.filter("copies > 1"), "digest").select(
        "digest", "page", "original", F.lit(True).alias("shared")
    )
    joined = rows.join(cut(told), ["digest", "page"], "left")
    # The join has already placed these keys together: payloads move once.
    nth = F.row_number().over(Window.partitionBy("digest", "page").orderBy(F.col("url").asc_nulls_last()))
    revisit = F.coalesce("shared", F.lit(False)) & ((F.col("nth") > 1) | ~F.col("page_id").eqNullSafe(F.col("original")))
    return joined.withColumn("nth", nth).withColumn("revisit", revisit).drop("page", "shared", "large")


def render_records(resolved: DataFrame, date: str = DATE) -> DataFrame:
    """One string per record, without the blank line that ends it."""
    octets = F.octet_length("payload").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), octets, F.lit(CRLF * 2))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "payload"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")

    def line(name: str, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))

    revisit = F.col("revisit")
    head = F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"), F.col("nth"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url), line("X-Page-ID", F.col("page_id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("original"), F.col("digest"), F.lit(1)))),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        line("Content-Length", F.octet_length("block")), F.lit(CRLF),
    )
    return resolved.withColumn("block", block).select(F.concat(head, "block").alias("record"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, file_records: int = FILE_RECORDS) -> None:
    records = render_records(resolve_revisits(pages, min_bytes))
    out = records.write.option("lineSep", CRLF * 2).option("compression", "gzip")
    out.option("maxRecordsPerFile", file_records).text(folder)


class _Inflated(io.RawIOBase):
    """A gzip file in memory as a stream of bytes, member after member."""

    def __init__(self, data: bytes):
        self.rest, self.z = data, zlib.decompressobj(31)

    def readable(self):
        return True

    def readinto(self, buf):
        while True:
            got = self.z.decompress(self.rest, len(buf))
            self.rest = self.z.unconsumed_tail or self.z.unused_data
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            if got or not self.rest:
                buf[: len(got)] = got
                return len(got)


def records_in(data: bytes):
    """(headers, http headers, payload) of each record of one archive file."""
    stream = io.BufferedReader(_Inflated(data), 1 << 16)

    def headers(lines):
        out = {}
        for raw in iter(lines.readline, b""):
            raw = raw.rstrip(b"\r\n")
            if not raw:
                break
            name, _, value = raw.decode("utf-8").partition(":")
            out[name.strip().lower()] = value.strip()
        return out

    while first := stream.readline():
        if first.strip() != VERSION.encode():
            raise ValueError(f"not a record: {first[:80]!r}")
        head = headers(stream)
        block = io.BytesIO(stream.read(int(head["content-length"])))
        block.readline()
        http = headers(block)
        yield head, http, block.read()
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record; payload length and digest of responses are those of the payload read."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, http, payload in records_in(data.as_py()):
                    said = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response":
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if digest != said:
                            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                    else:
                        size, digest = int(http["content-length"]), said
                    rows.append((head["warc-record-id"], head.get("x-page-id"), head["warc-type"], size, digest, head.get("warc-refers-to")))
                names = ["record_id", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id"]
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, PARSED)


def archive_index(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to (the page whose
    response a revisit names). Length and digest of a revisit are those of that response."""
    seen = cut(read_archives(spark, folder))
    originals = seen.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("o_page"), F.col("payload_bytes").alias("o_bytes"),
        F.col("payload_digest").alias("o_digest"),
    )
    # Responses refer to nothing and do not meet in the join: as null keys they would share one task.
    revisits = seen.filter("record_type <> 'response'").join(originals, "refers_to_id", "left")
    alone = seen.filter("record_type = 'response'").select(
        "*", F.lit(None).cast("string").alias("o_page"), F.lit(None).cast("long").alias("o_bytes"), F.lit(None).cast("string").alias("o_digest")
    )
    return alone.unionByName(revisits).select(
        F.col("page_id").cast(id_type).alias("page_id"),
        F.coalesce("o_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("o_digest", "payload_digest").alias("payload_digest"),
        "record_type", F.col("o_page").cast(id_type).alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives in the shared folder and indexes them."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder, min_bytes)
    return archive_index(spark, folder, pages.schema["page_id"].dataType.simpleString())


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (
  SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS d FROM p
), r AS (
  SELECT *, n >= 1000 AND row_number() OVER (PARTITION BY d ORDER BY page_id DESC NULLS LAST) > 1 AS again,
    max(page_id) OVER (PARTITION BY d) AS top
  FROM q
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN top END AS refers_to
FROM r
"""
