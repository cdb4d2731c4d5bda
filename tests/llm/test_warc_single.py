"""Archives whose reading must not depend on splits, and archives that are not in order."""

import hashlib
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from spanloom.llm import warc  # noqa: E402


@pytest.mark.parametrize("html", ["WARC/1.1\r\n", "a WARC/1.1\r\n", "WARC/1.1\r\nWARC/1.1\r\n", "WARC/1.0\r\nWARC/1."])
def test_single_page_of_version_lines(spark, html):
    pages = spark.createDataFrame([(1, "http://a", html)], "page_id long, url string, html string").coalesce(1)
    got = [tuple(r) for r in warc.round_trip(pages).collect()]
    assert got == [(1, len(html), hashlib.sha256(html.encode()).hexdigest(), "response", None)]


def test_readings_that_are_split_in_other_ways(spark, tmp_path, monkeypatch):
    html = [f"<p>{k}</p>" + ("WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * (k % 5) if k % 3 == 0 else "") + "z" * (k * 7 % 300) for k in range(400)]
    pages = spark.createDataFrame([(k, "http://a", h) for k, h in enumerate(html)], "page_id long, url string, html string").coalesce(2)
    warc.write_warc(pages, str(tmp_path / "w"))
    plain, sizes = warc._pieces, iter(("2k", "7k", "5k"))

    def resized(spark, path):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return plain(spark, path)

    monkeypatch.setattr(warc, "_pieces", resized)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        got = {r.page_id: r.payload_digest for r in warc.page_records(warc.read_warc(spark, str(tmp_path / "w"))).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == {k: hashlib.sha256(h.encode()).hexdigest() for k, h in enumerate(html)}


def test_cut_off_records_broken_chains_and_old_versions(spark, tmp_path):
    def record(n, body, length=None, version="1.1"):
        return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n{body}\r\n\r\n"

    files = {
        "cut": record(1, "a" * 50) + record(2, "b" * 50)[:-20],
        "broken": record(3, "c" * 50) + record(4, "d" * 50, length=20) + record(5, "e" * 50),
        "old": record(6, "f" * 50, version="1.0") + record(7, "g"),
        "junk": "no archive" + record(8, "h"),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.warc").write_bytes(text.encode())
    got = {r.page_id: r.payload_bytes for r in warc.page_records(warc.read_warc(spark, str(tmp_path))).collect()}
    assert got == {1: 50, 3: 50, 4: 20, 6: 50, 7: 1} or got == {1: 50, 3: 50, 6: 50, 7: 1}


def test_payloads_with_very_many_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 10)
    rows = [(k, "u", "x" * 150 if k % 2 else "y" * 120 + str(k // 6)) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_key", F.lit("clash"))
    got = {r.page_id: r.refers_to for r in warc.round_trip(pages).collect()}
    first = {}
    for k, _, h in rows:
        first.setdefault(h, k)
    assert got == {k: first[h] if first[h] != k else None for k, _, h in rows}
