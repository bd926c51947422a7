import gzip
import hashlib
import io
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quaverline.llm import warc

SF = "/root/testdata/sf0.01"


def brute(rows, least=1000):
    pay = [(i, (h or "").encode()) for i, _, h in rows]
    groups = defaultdict(list)
    for i, p in pay:
        if i is not None:
            groups[p].append(i)
    out = []
    for i, p in pay:
        again = len(p) >= least and i is not None and i < max(groups[p])
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", max(groups[p]) if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    found = warc.archive_round_trip(spark.read.parquet(f"{SF}/pages.parquet"))
    assert sorted(map(tuple, found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(rows)


def test_edges(spark):
    big, tricky = "é<p>x</p>\r\n\r\n" * 300, "WARC/1.1\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 60
    rows = [(1, "http://a", big), (2, None, big), (3, "http://b\r\nX: y", big), (4, "", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", tricky), (9, "u", tricky), (9, "u", tricky), (None, "u", big), (-3, "u", big), (11, "u", "\r\n\r\n"), (12, "u", "z" * 400_000)]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, digest int, original int")
    found = warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_filters_reach_the_reader(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}", "x" * 1500 if i < 5 else f"p{i}") for i in range(20)], "page_id long, url string, html string").repartition(3)
    warc.write_pages(pages, f"file://{tmp_path}/w", compression="none")
    df = warc.read(spark, f"file://{tmp_path}/w")
    assert df.rdd.getNumPartitions() == len(warc.list_files(f"file://{tmp_path}/w"))
    for part in "ab":
        warc.write_pages(pages, f"file://{tmp_path}/two/{part}")
    two = warc.read(spark, f"file://{tmp_path}/two")
    assert two.rdd.getNumPartitions() == len(warc.list_files(f"file://{tmp_path}/two")) >= 2 and two.count() == 40
    assert df.filter("record_type = 'revisit'").count() == 4 and df.count() == 20  # one table asked in two ways
    assert df.filter((F.col("record_type") == "response") & (F.col("target_uri") == "http://h1")).count() == sum(i % 3 == 1 for i in range(4, 20))
    assert df.filter("content_length > 1000").select("record_id").collect()[0][0] == "<urn:page:4>"
    assert warc.read(spark, f"file://{tmp_path}/w", payload=False).filter("payload is not null").count() == 0

    asked = []
    reader = warc.WarcReader({"path": f"file://{tmp_path}/w"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"x")]))
    assert len(left) == 1 and reader.tests == [("record_type", "=", "revisit")]
    raw = b"".join(open(f.removeprefix("file://"), "rb").read() for f in warc.list_files(f"file://{tmp_path}/w"))

    class Watched(io.BytesIO):
        def read(self, n=-1):
            asked.append(n)
            return super().read(n)

    assert len(list(warc.records(Watched(raw), lambda r: r["record_type"] == "revisit"))) == 4


def test_record_at_a_time_gzip():
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    found = list(warc.records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(one) * 3)))))
    assert [r["payload"] for r in found] == [b"abc"] * 3


def test_malformed_records():
    head = lambda more: b"WARC/1.0\r\nWARC-Type: resource\r\n" + more + b"\r\n\r\n"
    read = lambda raw: list(warc.records(io.BufferedReader(io.BytesIO(raw))))
    latin = read(head("WARC-Target-URI: http://h/\xe9\r\nContent-Length: 3".encode("latin-1")) + b"abc\r\n\r\n")
    assert [(r["target_uri"], r["payload"]) for r in latin] == [("http://h/\xe9", b"abc")]
    assert read(head("WARC-Target-URI: http://h/\xe9\r\nContent-Length: 0".encode()))[0]["target_uri"] == "http://h/\xe9"
    assert read(b"") == [] and read(b"\r\n\r\n") == []
    for raw, error in ((b"junk\r\n\r\n", ValueError), (head(b"Content-Length: x"), ValueError), (head(b"Content-Length: -4"), ValueError), (head(b"Content-Length: 9") + b"abc", EOFError), (b"WARC/1.0\r\nWARC-Type", EOFError)):
        with pytest.raises(error):
            read(raw)
