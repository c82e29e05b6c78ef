"""Web archives: records with equal payloads are stored once, later readers find the rest by revisit records.

Digests and ids, never payloads, are shuffled to find which payloads repeat. Records of a payload that doesn't repeat need nothing else: a
bitmap of the repeated digests, of a fixed size, lets them pass straight to their archive. The others are joined to the original
response of their digest (hot digests by broadcast), and revisits are written as headers of their own. Archives are written by Spark's text
writer (one file for each partition, CRLF line ends, an optional codec). Reading splits the files at the record boundary, so one archive may
be read by many tasks.

Defined results: a null payload counts as empty; a null page_id or url leaves its header out and is read back as
null; a null page_id is no original if another row has an id, and a revisit of it; equal page_ids with equal payloads give one response each; an
empty table gives no record. CR and LF in urls are percent-encoded; all other characters stay, as header lines end at CRLF alone.
The boundary is a header line drawn from the digests of all payloads, which no payload can foresee; each
record's length is checked against its Content-Length when read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh_path, hot_lookup, read_table, stored

#: Payloads under this many bytes are not worth a revisit record.
MIN_REVISIT_BYTES = 1000
#: Bits of the bitmap of repeated digests, a power of two: at most BITMAP_BITS / 64 rows are broadcast.
BITMAP_BITS = 1 << 24
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to; html is empty in revisits.

    Of the records with one digest, at least min_bytes long, that with the largest page_id is the response.
    """
    total = pages.count()
    full = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    full = full.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html").cast("binary"))})
    originals = (
        full.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
    originals = stored(originals, "warc-originals")
    place = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").bitwiseAND(F.lit(BITMAP_BITS - 1))
    cell, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    bitmap = originals.select(cell.alias("_cell"), bit.alias("_bit")).groupBy("_cell").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    tried = full.withColumns({"_cell": cell, "_bit": bit}).join(F.broadcast(bitmap), "_cell", "left")
    likely = F.coalesce(F.expr("shiftright(_bits, _bit) & 1 = 1"), F.lit(False))
    unique = tried.filter(~likely).select(*full.columns, F.lit(None).cast("long").alias("original"))
    found = hot_lookup(tried.filter(likely).select(*full.columns), originals, "digest", "copies", total).unionByName(unique)
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return found.select(
        "page_id",
        "url",
        F.when(revisit, "").otherwise(F.col("html")).alias("html"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def _line(name: str, value):
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record_id(page_id):
    d = F.sha1(F.concat(F.lit("page:"), page_id.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3), F.lit("-8"), F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str, min_bytes: int = MIN_REVISIT_BYTES, codec: str | None = None) -> str:
    """Write a WARC record for each page under path; returns the boundary that read_archives needs."""
    seal = pages.select(F.bitwise_not(F.bit_xor(F.xxhash64("html", "page_id"))).alias("a"), F.count(F.lit(1)).alias("n")).first()
    boundary = hashlib.sha256(f"{path} {seal['a']} {seal['n']}".encode()).hexdigest()[:32]
    known = resolve_revisits(pages, min_bytes)
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    records = known.withColumn("_block", block).select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}X-Archive-Boundary: {boundary}{CRLF}WARC-Type: "),
            F.when(revisit, "revisit").otherwise("response"),
            F.lit(CRLF),
            _line("WARC-Record-ID", _record_id(F.col("page_id"))),
            _line("X-Page-Id", F.col("page_id").cast("string")),
            _line("WARC-Target-URI", url),
            F.lit(f"WARC-Date: {date}{CRLF}"),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}{CRLF}")).otherwise(""),
            _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
            _line("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
            F.lit(f"Content-Type: application/http;msgtype=response{CRLF}Content-Length: "),
            F.octet_length("_block").cast("string"),
            F.lit(CRLF + CRLF),
            F.col("_block"),
            F.lit(CRLF),
        ).alias("value")
    )
    writer = records.write.option("lineSep", CRLF)
    (writer.option("compression", codec) if codec else writer).text(path)
    return boundary


def read_archives(spark: SparkSession, path: str, boundary: str) -> DataFrame:
    """A row for each record: page_id, url, record_type, refers_to, payload (null for a revisit), payload_bytes, payload_digest."""
    first = f"WARC/1.1{CRLF}X-Archive-Boundary: {boundary}{CRLF}"
    raw = spark.read.option("lineSep", CRLF + CRLF + first).text(path)
    # The first record of a file still has its own first line; the last one has the two line ends after its block.
    body = F.when(F.startswith(F.col("value"), F.lit(first)), F.substring(F.col("value"), len(first) + 1, 2**31 - 1)).otherwise(F.col("value"))
    parts = raw.filter(F.octet_length("value") > 0).select(body.alias("value")).withColumn("_cut", F.instr("value", CRLF + CRLF))
    parts = parts.select(F.expr("substring(value, 1, _cut + 1)").alias("head"), F.expr("substring(value, _cut + 4)").alias("block"))

    def field(name: str):
        return F.nullif(F.regexp_extract("head", rf"(?md)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))

    heads = parts.select("block", *[field(n).alias(a) for n, a in (("WARC-Type", "record_type"), ("X-Page-Id", "page_id"), ("WARC-Target-URI", "url"), ("WARC-Payload-Digest", "digest"), ("X-Refers-To-Page-Id", "refers_to"), ("Content-Length", "length"))])
    length = F.col("length").cast("long")
    tail = F.octet_length("block") - length
    whole = F.when((tail == 0), F.col("block")).when(
        (tail == 4) & F.endswith(F.col("block"), F.lit(CRLF + CRLF)), F.expr("left(block, length(block) - 4)")
    ).otherwise(F.raise_error(F.lit("a record's block differs from its Content-Length")))
    heads = heads.withColumn("block", whole).withColumn("_cut", F.instr("block", CRLF + CRLF))
    http = F.expr("substring(block, 1, _cut)")
    payload = F.when(F.col("record_type") == "response", F.expr("substring(block, _cut + 4)"))
    return heads.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        payload.alias("payload"),
        F.coalesce(F.octet_length(payload).cast("long"), F.regexp_extract(http, r"Content-Length: (\d+)", 1).cast("long")).alias("payload_bytes"),
        F.coalesce(F.sha1(payload.cast("binary")), F.substring_index("digest", ":", -1)).alias("payload_digest"),
    )


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    boundary = write_archives(read_table(spark, sf_dir, "pages"), path, "2024-01-01T00:00:00Z", codec="gzip")
    return read_archives(spark, path, boundary).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN o.original IS NULL OR o.original = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o.original <> p.page_id THEN o.original END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""
