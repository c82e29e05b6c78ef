import hashlib

import pytest

from ledgerlark.llm import warc
from ledgerlark.llm._common import fresh_path

SCHEMA = "page_id long, url string, html string, digest string, refers_to string"


@pytest.mark.parametrize("codec", [None, "gzip"])
def test_round_trip(spark, codec):
    big, other = "é" * 600, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40
    rows = [(1, "http://a/\r\nb", big), (2, "http://b/", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", other), (9, "u", other + "\r\n\r\n"), (None, "u", "y" * 2000), (10, "u", big), (10, "u", big), (11, "u", "z" * 999), (12, "u", "z" * 999)]
    path = fresh_path(spark, "t")
    boundary = warc.write_archives(spark.createDataFrame([(*r, "d", "r") for r in rows], SCHEMA), path, "2024-01-01T00:00:00Z", codec=codec)
    got = warc.read_archives(spark, path, boundary).collect()
    assert len(got) == len(rows)
    sha = {i: hashlib.sha1((h or "").encode()).hexdigest() for i, _, h in rows}
    size = {i: len((h or "").encode()) for i, _, h in rows}
    assert all(r.payload_digest == sha[r.page_id] and r.payload_bytes == size[r.page_id] for r in got)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(1, "revisit", 10), (2, "revisit", 10), (3, "revisit", 10), (10, "response", None), (6, "response", None), (7, "response", None), (11, "response", None), (12, "response", None), (None, "response", None)} <= kinds
    assert {r.page_id: r.payload for r in got if r.record_type == "response"}[8] == other
    assert {r.page_id: r.url for r in got}[1] == "http://a/%0D%0Ab" and {r.page_id: r.url for r in got}[3] is None


def test_empty(spark):
    path = fresh_path(spark, "t")
    boundary = warc.write_archives(spark.createDataFrame([], SCHEMA), path, "2024-01-01T00:00:00Z")
    assert warc.read_archives(spark, path, boundary).count() == 0


def test_headers_only_decide(spark):
    rows = [(i, "u", "p" * 1500, "", "") for i in range(50)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: ("revisit", 49) for i in range(49)} | {49: ("response", None)}


def test_unicode_line_ends_in_urls_and_null_ids(spark):
    rows = [(1, "u Content-Length: 5", "a" * 10), (2, "u\u0085X-Refers-To-Page-Id: 9", "b"), (None, "n", "c" * 1000), (4, "m", "c" * 1000), (None, "n", "d" * 1000), (None, "n", "d" * 1000)]
    path = fresh_path(spark, "t")
    boundary = warc.write_archives(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA), path, "2024-01-01T00:00:00Z", codec="gzip")
    got = sorted(((r.page_id or 0, r.url, r.payload, r.record_type, r.refers_to) for r in warc.read_archives(spark, path, boundary).collect()), key=repr)
    want = [(1, rows[0][1], "a" * 10, "response", None), (2, rows[1][1], "b", "response", None), (4, "m", "c" * 1000, "response", None), (0, "n", None, "revisit", 4)] + [(0, "n", "d" * 1000, "response", None)] * 2
    assert got == sorted(want, key=repr)


def test_unique_payloads(spark):
    pages = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "repeat(CAST(id AS STRING), 1000) AS html")
    assert {r.record_type for r in warc.resolve_revisits(pages).collect()} == {"response"}
