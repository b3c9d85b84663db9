"""Archives written, indexed and read back."""

import base64
import gzip
import hashlib
import random

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from quire.llm import warc


def brute(rows, least):
    """page_id, bytes, digest, type, refers_to of (page_id, url, html) rows."""
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        to = first.get(p)
        later = to is not None and (i is None or i > to)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if later else "response", to if later else None))
    return sorted(out, key=repr)


def read(df, **kw):
    archive = warc.write_archive(df, **kw)
    got = warc.lookup(archive, warc.capture_keys(df), payload=False)
    return archive, sorted(
        (tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def pages(n, seed):
    r = random.Random(seed)
    bodies = ["", None, "é" * 10, "<p>same</p>", "x" * 200_000] + ["<p>%d</p>" % i for i in range(n // 3)]
    hosts = ["a.example.com", "B.example.com", "example.org:8080", "[bad", "user@h.net"]
    rows = [(i, r.choice([None, "", "not a url", f"http://{r.choice(hosts)}/p/{r.randint(0, 40)}?q={i % 3} x#f"]), r.choice(bodies)) for i in range(n)]
    r.shuffle(rows)
    return rows + [(None, "http://a.example.com/", "<p>same</p>"), (None, None, "only here"), rows[0], rows[1]]


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, least):
    rows = pages(240, 1)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, surt int").repartition(5)
    _, got = read(df, min_bytes=least, block_lines=7, file_bytes=20_000)
    assert got == brute(rows, least)


def test_payloads_and_addresses_come_back(spark):
    rows = [(1, "http://www.Example.com/a b", "täxt"), (2, "http://example.com/é\r\nX: y", "\r\n\r\nWARC/1.1"), (3, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(df)
    got = {r["page_id"]: r for r in warc.lookup(archive, warc.capture_keys(df)).collect()}
    assert {i: bytes(r["payload"]).decode() for i, r in got.items()} == {1: "täxt", 2: "\r\n\r\nWARC/1.1", 3: ""}
    assert got[1]["surt"] == "com,example,www)/a%20b" and got[3]["surt"] == "-" and got[3]["url"] is None
    asked = spark.createDataFrame([("com,example)/none", 1), ("zz", 5), ("", 0), ("com,example,www)/a%20b", 1), ("com,example,www)/a%20b", 1)], "surt string, page_id long")
    assert [r["page_id"] for r in warc.lookup(archive, asked).collect()] == [1]


def test_records_stand_alone_in_the_file(spark):
    """Any reader of the format finds the records one gzip member after the other."""
    rows = [(i, f"http://h.org/{i}", "same" if i % 2 else f"body {i}") for i in range(20)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    store, root = fs.FileSystem.from_uri(archive.folder)
    files = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".warc.gz")]
    data = b"".join(gzip.decompress(store.open_input_file(f).read()) for f in files)
    assert data.count(b"WARC/1.1\r\n") == 20 and data.count(b"WARC-Type: revisit") == 9
    assert data.count(b"WARC-Refers-To: <urn:uuid:") == 9


def test_no_rows(spark):
    _, got = read(spark.createDataFrame([], "page_id long, url string, html string"))
    assert got == []


def test_a_hot_host_is_spread_over_blocks(spark):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://one.example.com/").alias("url"), F.col("id").cast("string").alias("html"))
    archive = warc.write_archive(df, block_lines=100)
    keys = spark.createDataFrame([("com,example,one)/", i) for i in (0, 99, 100, 2999, 3000)], "surt string, page_id long")
    assert sorted(r["page_id"] for r in warc.lookup(archive, keys).collect()) == [0, 99, 100, 2999]
