"""WARC archives: exact round trips, revisits and byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os

import pytest

from dossier.llm import warc

LONG = "<p>é</p>" * 200_000
ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/4\nx", ""), (5, "u", LONG),
    (6, "u", "line\r\n\r\nWARC/1.1\r\n"), (7, "u", "<p>same</p>"), (None, "u", "no id"), (8, "", "x"), (8, "", "x"),
]
SCHEMA = "page_id long, url string, html string, digest string, payload int, refers_to string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in ROWS], SCHEMA).repartition(3)


def test_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(pages, folder)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(ROWS) == index.count()
    by_id = {r["page_id"]: r for r in got}
    assert sorted((r["page_id"] or 0) for r in got) == sorted((r[0] or 0) for r in ROWS)
    for page, url, html in ROWS:
        row = by_id[page]
        assert row["payload_digest"] == digest(html) and row["payload_bytes"] == len((html or "").encode())
        assert row["url"] == (None if url is None else " ".join(url.split()) or " ") or url == ""
        largest = max(p or 0 for p, _, h in ROWS if (h or "") == (html or ""))
        if page is not None and page != largest:
            assert (row["record_type"], row["refers_to"], row["payload"]) == ("revisit", largest, None)
        else:
            assert (row["record_type"], row["refers_to"], bytes(row["payload"])) == ("response", None, (html or "").encode())


def test_archives_are_plain_warc(spark, pages, tmp_path):
    warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=300)
    names = [n for n in os.listdir(f"{tmp_path}/w/archives") if n.endswith(".gz")]
    assert len(names) > 3
    records = b"".join(gzip.open(f"{tmp_path}/w/archives/{n}").read() for n in names)
    assert records.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)


def test_some_records_by_index(spark, pages, tmp_path):
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(pages, folder)
    some = warc.read_records(index.filter("page_id in (1, 6)"), folder, gap_bytes=0).collect()
    assert sorted(r["page_id"] for r in some) == [1, 6]


def test_least_bytes_and_empty_table(spark, pages, tmp_path):
    typed = {r["page_id"]: r["refers_to"] for r in warc.with_types(pages, least_bytes=5).collect()}
    assert typed[1] == typed[2] == 7 and typed[3] is None and typed[4] is None
    index = warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert index.count() == 0 and warc.read_records(index, f"file://{tmp_path}/none").collect() == []


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 45, 100), ("b", 0, 3)]
    assert list(warc.coalesced(iter(rows), 50, 8)) == [
        ("a", 0, 15, [(0, 10), (10, 5)]), ("a", 40, 5, [(0, 5)]), ("a", 45, 100, [(0, 100)]), ("b", 0, 3, [(0, 3)]),
    ]
    assert list(warc.coalesced(iter(rows[:3]), 50, 100)) == [("a", 0, 45, [(0, 10), (10, 5), (40, 5)])]


def test_reads_are_spread_over_tasks(spark, tmp_path):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat(sha2(cast(id AS string), 512), 20) AS html")
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(pages.repartition(2), folder)
    records = warc.read_records(index, folder, range_bytes=4096, gap_bytes=64)
    assert records.count() == 400 and records.rdd.getNumPartitions() > 8
