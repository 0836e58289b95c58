"""Content-addressed WARC archive.

An archive is two tables in the shared folder: ``payloads`` holds each distinct payload once under its
SHA-256, compressed, ``records`` holds every record's exact header bytes with the digest that it needs.
Original records are header + payload + two line ends, rebuilt by a join on the digest; the digest, the
length and the SHA-1 written in the header are verified on reading. The query rebuilds every record and takes
length and SHA-1 of the payload from the rebuilt bytes (a revisit's from the payload that it refers to).

Digests, sizes and headers are SQL expressions; payloads are compressed (Zstandard) where they are read and
travel so. Of equal payloads each task hands in one, so a group of any size is only ever aggregated.

Null html is an empty payload. Pages without an id can't be named in a record and get a urn of their
payload's digest; equal rows give equal records. Any number of equal payloads is fine; extra columns are
ignored. An empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Seen, in_arrow, row_blocks
from .storage import shared_dir

REVISIT_BYTES = 1000
LINE = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    path: str

    @property
    def payloads(self) -> DataFrame:
        return self.spark.read.schema("digest binary, z binary").parquet(f"{self.path}/payloads")

    @property
    def records(self) -> DataFrame:
        return self.spark.read.schema("header binary, digest binary").parquet(f"{self.path}/records")


def _urn(page_id: Column, sha1: Column) -> Column:
    return F.concat(F.lit("<urn:"), F.coalesce(F.concat(F.lit("page:"), page_id.cast("string")), F.concat(F.lit("sha1:"), sha1)), F.lit(">"))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads compressed, equal ones near each other in a task once."""
    pack = zstandard.ZstdCompressor(level=3)
    seen = Seen()
    for batch in batches:
        for block in row_blocks(batch, "payload"):
            block = block.filter(pa.array(seen.new(block.column("digest").to_pylist())))
            z = [pack.compress(x) for x in block.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("digest"), pa.array(z, pa.binary())], names=["digest", "z"])


def _restored(rows: DataFrame) -> DataFrame:
    """``rows`` with payload in place of z."""
    keep = [c for c in rows.columns if c != "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for block in row_blocks(batch, "z"):
                body = [None if z is None else unpack.decompress(z) for z in block.column("z").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array(body, pa.binary())], names=[*keep, "payload"])

    return in_arrow(rows, run, T.StructType([*(rows.schema[c] for c in keep), T.StructField("payload", T.BinaryType())]))


def write(pages: DataFrame, path: str | None = None, revisit_bytes: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write one record for each row of ``pages`` (page_id, url, html), all of one date."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumns(
        {"digest": F.unhex(F.sha2("payload", 256)), "sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")}
    )
    names = rows.drop("payload")
    last = names.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("kept_id"), F.count(F.lit(1)).alias("n"))
    last = last.where(F.col("n") > 1).select("digest", "kept_id")
    placed = names.join(last, "digest", "left")
    revisit = F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    block = F.when(revisit, F.lit(0)).otherwise(F.col("size") + len(HTTP))
    head = F.concat(
        F.lit(f"WARC/1.1{LINE}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{LINE}WARC-Record-ID: "), _urn(F.col("page_id"), F.col("sha1")), F.lit(f"{LINE}WARC-Date: {date}"),
        F.lit(f"{LINE}WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "),
        F.lit(f"{LINE}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.lit(f"{LINE}WARC-Payload-Length: "), F.col("size").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{LINE}WARC-Profile: {PROFILE}{LINE}WARC-Refers-To: "), _urn(F.col("kept_id"), F.col("sha1")))).otherwise(F.lit("")),
        F.lit(f"{LINE}Content-Type: application/http; msgtype=response{LINE}Content-Length: "), block.cast("string"), F.lit(LINE * 2),
        F.when(revisit, F.lit("")).otherwise(F.lit(HTTP)),
    )
    placed.select(F.encode(head, "utf-8").alias("header"), "digest").write.parquet(f"{path}/records")
    in_arrow(rows.select("digest", "payload"), _compressed, "digest binary, z binary").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")
    return Archive(spark, path)


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)


def read(archive: Archive, with_bytes: bool = False) -> DataFrame:
    """Parsed records. Each stored payload is read and verified; with ``with_bytes`` the original record's
    bytes are rebuilt as well (column ``record``), their length is compared with the header's, and length and
    SHA-1 of the payload are those of the rebuilt bytes."""
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    checked = F.when(sound, F.col("digest")).otherwise(F.raise_error(F.lit("a stored payload doesn't match its digest")))
    stored = archive.payloads
    if not with_bytes:
        stored = _restored(stored).select(checked.alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    head = F.decode("header", "utf-8")
    records = archive.records.select(
        "digest", *(["header", F.octet_length(F.substring_index(head, LINE * 2, 1)).alias("top"), F.regexp_extract(head, r"\r\nContent-Length: (\d+)", 1).alias("length")] if with_bytes else []),
        _field(head, "WARC-Type").alias("record_type"),
        F.regexp_extract(head, r"\r\nWARC-Record-ID: <urn:page:(-?\d+)>", 1).alias("id"),
        F.regexp_extract(head, r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>", 1).alias("to"),
        _field(head, "WARC-Target-URI").alias("url"),
        F.regexp_extract(head, r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]*)", 1).alias("sha1"),
    )
    both = records.join(stored, "digest", "left")
    if with_bytes:
        wrong = F.raise_error(F.lit("a stored payload doesn't match its digest")).cast("binary")
        both = _restored(both).withColumn("payload", F.when(F.col("payload").isNull() | sound, F.col("payload")).otherwise(wrong))
        revisit, size = F.col("record_type") == "revisit", F.octet_length("header")
        rebuilt = F.concat("header", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n"))
        whole = (F.octet_length(rebuilt) - F.col("top") - 2 * len(LINE * 2)).cast("string") == F.col("length")
        both = both.withColumn("record", F.when(whole, rebuilt).otherwise(F.raise_error(F.lit("a record's length isn't that of its header")).cast("binary")))
        held = F.when(revisit, F.col("payload")).otherwise(F.col("record").substr(size + 1, F.octet_length("record") - size - len(LINE * 2)))
        both = both.withColumn("held", held).withColumns({"payload_bytes": F.octet_length("held").cast("long"), "payload_digest": F.sha1("held")})
    right = F.when(F.col("payload_digest").eqNullSafe(F.col("sha1")), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's payload is missing or wrong")))
    return both.select(
        F.expr("try_cast(id AS bigint)").alias("page_id"), "url", "payload_bytes", right.alias("payload_digest"), "record_type",
        F.expr("try_cast(to AS bigint)").alias("refers_to"), *(["record"] if with_bytes else []),
    )


def archived(pages: DataFrame) -> DataFrame:
    """Write the archive, rebuild its records: one row per page."""
    return read(write(pages), with_bytes=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
