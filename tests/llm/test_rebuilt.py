"""The WARC query rebuilds its records."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graphwarden.llm import warc

HTML = ["<p>" + "é" * 900 + "</p>", "<p>" + "é" * 900 + "</p>", "short", "short", "", None]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, f"http://é.example/{i}", x) for i, x in enumerate(HTML)], "page_id long, url string, html string")


def tampered(archive, header):
    path = f"{archive.path}-{hashlib.md5(str(header).encode()).hexdigest()}"
    archive.records.withColumn("header", F.encode(header, "utf-8")).write.parquet(f"{path}/records")
    archive.payloads.write.parquet(f"{path}/payloads")
    return warc.Archive(archive.spark, path)


def test_query_rebuilds_records(pages, monkeypatch):
    got = {r.page_id: r for r in warc.archived(pages).collect()}
    for i, x in enumerate(HTML):
        data = (x or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert (got[0].record_type, got[0].refers_to, got[1].record_type) == ("revisit", 1, "response")
    archive, head = warc.write(pages), F.decode("header", "utf-8")
    for header in (F.regexp_replace(head, r"Content-Length: ", "Content-Length: 1"), F.regexp_replace(head, r"HTTP/1.1 200 OK\r\n", "")):
        bad = tampered(archive, header)
        monkeypatch.setattr(warc, "write", lambda pages, bad=bad: bad)
        with pytest.raises(Exception, match="length isn't that of its header"):
            warc.archived(pages).collect()


def test_stored_payloads_are_verified(pages):
    archive = warc.write(pages)
    path = f"{archive.path}-swapped"
    digests = archive.payloads.orderBy("digest").collect()
    swapped = [(a.digest, b.z) for a, b in zip(digests, digests[1:] + digests[:1])]
    archive.records.write.parquet(f"{path}/records")
    archive.spark.createDataFrame(swapped, "digest binary, z binary").write.parquet(f"{path}/payloads")
    for whole in (False, True):
        with pytest.raises(Exception, match="doesn't match its digest|missing or wrong"):
            warc.read(warc.Archive(archive.spark, path), with_bytes=whole).collect()


def test_headers_and_clashing_names(pages):
    marked = pages.select("*", *(F.lit("q").alias(c) for c in ("sha1", "size", "k", "payload", "digest", "z", "a.b")))
    long = pages.sparkSession.createDataFrame([(None, "u", "w" * 3_000_000)], pages.schema)
    archive = warc.write(marked.select("page_id", "url", "html", "sha1", "z", "`a.b`").unionByName(long, allowMissingColumns=True))
    heads = [bytes(r.header).decode() for r in archive.records.collect()]
    assert len(heads) == len(HTML) + 1 and all("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in h for h in heads)
    assert sum("WARC-Record-ID: <urn:sha1:" + hashlib.sha1(b"w" * 3_000_000).hexdigest() + ">" in h for h in heads) == 1
    assert {r.page_id for r in warc.read(archive, with_bytes=True).collect()} == {*range(len(HTML)), None}
