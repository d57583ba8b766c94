"""WARC archives with revisit records, written and read back by Spark.

Payload digests are shuffled as headers only; the first record of each digest
stays a response and the others become revisits of it. Archives are plain text
files whose record separator is the WARC end of record, so that any store that
Spark writes to can hold them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, stage

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Payload bytes of an archive, about, and records of one at most.
FILE_BYTES = 32 << 20
FILE_RECORDS = 20_000


def _html_hash():
    return F.xxhash64(F.coalesce("html", F.lit("")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [(x or "").encode() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array([len(x) for x in raw], pa.int64()), pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw])],
            names=["page_id", "html_hash", "payload_bytes", "payload_digest"],
        )


def payload_headers(pages: DataFrame) -> DataFrame:
    """page_id, html_hash, payload_bytes and bare base32 SHA-1 of each html (null: empty). Rows are told apart by page_id and html_hash."""
    return pages.select("page_id", "html", _html_hash().alias("html_hash")).mapInArrow(_digests, "page_id long, html_hash long, payload_bytes long, payload_digest string")


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``: the smallest page_id with that payload, null for the response itself.

    Payloads of fewer than ``min_bytes`` are all responses. Only digests are shuffled, and
    a digest with any number of records is reduced before the shuffle.
    """
    first = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return headers.join(first, "payload_digest", "left").select(
        "page_id", "html_hash", "payload_bytes", "payload_digest", F.when((F.col("first_id") != F.col("page_id")) & (F.col("payload_bytes") >= min_bytes), F.col("first_id")).alias("refers_to")
    )


def warc_records(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """One WARC 1.1 record a page, without its two final CRLFs. ``pages`` has page_id, url and html."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _html_hash().alias("html_hash")).alias("p")
    r = resolved.alias("r")
    j = p.join(r, (F.col("p.page_id") == F.col("r.page_id")) & (F.col("p.html_hash") == F.col("r.html_hash")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    is_rev = F.col("r.refers_to").isNotNull()
    uri = F.regexp_replace(F.coalesce(F.col("p.url"), F.lit("")), r"[\r\n]", "")
    return j.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            line("WARC-Type", F.when(is_rev, "revisit").otherwise("response")),
            line("WARC-Record-ID", urn(F.col("p.page_id"))),
            line("WARC-Date", F.lit(DATE)),
            line("WARC-Target-URI", uri),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "r.payload_digest")),
            F.when(is_rev, F.concat(line("WARC-Refers-To", urn(F.col("r.refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
            line("Content-Type", F.lit("text/html; charset=utf-8")),
            line("Content-Length", F.when(is_rev, F.lit(0)).otherwise(F.col("r.payload_bytes")).cast("string")),
            F.lit(CRLF),
            F.when(is_rev, F.lit("")).otherwise(F.col("p.html")),
        ).alias("value")
    )


def write_warc(records: DataFrame, path: str, records_per_file: int = FILE_RECORDS) -> None:
    """Write records to archives under ``path``; no file has more than ``records_per_file``, which the caller takes from the mean size of a record."""
    records.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def _parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive; it is inflated piece by piece, so that one record and one piece are in memory."""
    inflate, have, left = zlib.decompressobj(31), bytearray(), memoryview(content)

    def more() -> bool:
        nonlocal inflate, left
        while left:
            piece = inflate.decompress(left[:PIECE], 4 * PIECE)
            # what was not used yet comes again: of this member, or of the next one
            left = left[min(PIECE, len(left)) - len(inflate.unused_data if inflate.eof else inflate.unconsumed_tail) :]
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            if piece:
                have.extend(piece)
                return True
        rest = inflate.flush()
        have.extend(rest)
        return bool(rest)

    while have or more():
        while (end := have.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            return
        head = dict(x.split(": ", 1) for x in have[:end].decode().split(CRLF)[1:])
        size = int(head["Content-Length"])
        while len(have) < end + 4 + size + 4 and more():
            pass
        yield head, bytes(have[end + 4 : end + 4 + size])
        del have[: end + 4 + size + 4]


def _reader(bodies: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x.rsplit(":", 1)[1][:-1]) if x else None
    sha = lambda body: base64.b32encode(hashlib.sha1(body).digest()).decode()
    for b in batches:
        for content in b.column(0):
            rows, size = [], 0
            for h, body in _parse(content.as_py()):
                rows.append((number(h["WARC-Record-ID"]), h["WARC-Type"], number(h.get("WARC-Refers-To")), h["WARC-Payload-Digest"][5:], len(body), sha(body), body.decode() if bodies else None, h["WARC-Target-URI"]))
                size += len(body) if bodies else 0
                if len(rows) >= 500 or size > PIECE * 4:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), READ_ARROW, strict=True)], names=READ_NAMES)


#: Bytes of an archive that are inflated at a time.
PIECE = 1 << 20
READ_NAMES = ["page_id", "record_type", "refers_to", "digest_header", "body_bytes", "body_digest", "body", "url"]
READ_ARROW = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
READ_SCHEMA = "page_id long, record_type string, refers_to long, digest_header string, body_bytes long, body_digest string, body string, url string"


def read_warc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Records of the archives under ``path`` with the digest of what was read; ``body`` is null without ``bodies``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(partial(_reader, bodies), READ_SCHEMA)


def revisit_table(records: DataFrame) -> DataFrame:
    """Full payload size and digest of each record; a revisit takes its response's.

    Nulls: pages with a null html have an empty payload. Responses keep the digest of the
    body that was read. A revisit whose response is missing has null payload columns. A response is known by its page_id and digest, so pages
    that share a page_id keep their payloads.
    """
    r = records.select("page_id", "record_type", "refers_to", "digest_header", "body_bytes", "body_digest")
    original = r.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("body_digest").alias("digest_header")).agg(F.max("body_bytes").alias("o_bytes")).withColumn("o_digest", F.col("digest_header"))
    rev = r.filter("record_type = 'revisit'").drop("body_bytes", "body_digest").join(original, ["refers_to", "digest_header"], "left").select("page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), "record_type", "refers_to")
    res = r.filter("record_type = 'response'").select("page_id", F.col("body_bytes").alias("payload_bytes"), F.col("body_digest").alias("payload_digest"), "record_type", "refers_to")
    return res.unionByName(rev)


def dedup_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write deduplicated archives of ``pages`` to ``path`` and return the table read back from them.

    An empty table gives no rows; rows without page_id are left out, repeated rows are archived as often, and of pages that share a page_id each keeps its own payload.
    """
    pages = keyed(pages, "page_id")
    headers = stage(payload_headers(pages))
    mean = headers.agg(F.avg("payload_bytes")).first()[0] or 0
    resolved = resolve_revisits(headers, min_bytes).dropDuplicates(["page_id", "html_hash"])
    write_warc(warc_records(pages, resolved), path, int(min(FILE_RECORDS, max(1, FILE_BYTES // (mean + 300)))))
    return revisit_table(stage(read_warc(pages.sparkSession, path, bodies=False).drop("body", "url")))
