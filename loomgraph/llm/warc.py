"""WARC archives with revisit resolution.

Headers (page_id, digest, url) are shuffled by payload digest; of records with equal payloads of at least
``least_bytes`` bytes the one with the largest page_id is the response and the others become revisits that refer to it.
Decisions meet the payloads by page_id and digest, so a payload is shuffled once and no group of equal payloads meets in
one task.

Every record is a gzip member of its own, so that readers can seek to it. Files are written by Spark's own text writer,
so any file system and commit protocol that Spark has will do, and a lost task is simply written again: a member's last
byte is 0 (the top of its size), and so is the line separator. Members of 16 MiB or more, whose last byte may differ,
are followed by an empty member. Files are rolled at about ``roll_bytes`` of payload.

Defined results: null html is an empty payload; an empty payload is a payload like others; several rows with the
winning page_id and payload are all responses; of one page_id with several payloads each payload is decided by itself,
and repeated rows are repeated records; rows without page_id are responses; line breaks in a url are percent-encoded, a
null url is empty. Extra columns are ignored. An empty table writes an archive without records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, staged

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload in one batch that a reading task hands on, and in one file.
BATCH_BYTES, ROLL_BYTES = 8 << 20, 128 << 20
_SCHEMA = "record_id string, record_type string, page_id long, url string, digest string, refers_to string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to, refers_url) of the revisits only, from headers alone."""
    heads = pages.where("page_id is not null").select("page_id", "url", F.octet_length("payload").alias("bytes"), base32_sha1(F.col("payload")).alias("digest"))
    heads = heads.where(F.col("bytes") >= least_bytes)
    originals = heads.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.min("page_id").alias("least")).where("least < first.page_id")
    # written before it is joined, so that a hot digest's partition can be split in the join
    joined = heads.join(staged(originals.select("digest", "first"), "originals"), "digest").where("page_id < first.page_id")
    return joined.select("page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_EMPTY = _member(b"")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records -> gzip members without the 0 at their end."""
    for batch in batches:
        out, size = [], 0
        for record in batch.column(0):
            data = record.as_buffer().to_pybytes()
            member = _member(data)
            member = member[:-1] if member[-1] == 0 else member + _EMPTY[:-1]
            out.append(member)
            size += len(member)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2026-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES) -> None:
    """Write (page_id, url, html) as WARC files of gzip members with fresh headers."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    mean = pages.agg(F.avg(F.octet_length("payload"))).first()[0] or 0
    rows = pages.withColumn("digest", base32_sha1(F.col("payload")))
    rows = rows.join(resolve(pages, least_bytes).distinct(), ["page_id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"))), line("WARC-Refers-To-Target-URI", F.col("refers_url")), line("WARC-Refers-To-Date", F.lit(date)), line("X-Refers-To-Page", F.col("refers_to").cast("string")))).otherwise(""),
        line("X-Page", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), http.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))
    members = rows.select(record.alias("record")).mapInArrow(released(_members), "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", max(1, int(roll_bytes // max(1, mean)))).text(path)


#: Bytes given to the decompressor at once.
PIECE = 1 << 13


def _records(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members, one at a time; they are fed in short pieces, so that little is copied at a member's end."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof and at < len(view):
            piece = view[at : at + PIECE]
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        if found := b"".join(parts):
            yield found


def parse_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers by lower-cased name, block) of each record; lengths come from Content-Length."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        heads = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in data[at:end].split(b"\r\n")[1:]))
        size = int(heads[b"content-length"])
        yield heads, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "page_id", "url", "digest", "refers_to", "payload"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for data in batch.column(0):
            rows, size = [], 0
            for member in _records(data.as_py()):
                for heads, block in parse_records(member):
                    get = lambda k: (v.decode() if (v := heads.get(k)) is not None else None)  # noqa: B023, E731
                    payload = block.partition(b"\r\n\r\n")[2]
                    rows.append((get(b"warc-record-id"), get(b"warc-type"), int(heads[b"x-page"]) if heads.get(b"x-page") else None, get(b"warc-target-uri"), (get(b"warc-payload-digest") or "").removeprefix("sha1:"), get(b"warc-refers-to"), payload))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; the payload of a revisit is empty until it is resolved by refers_to = record_id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(released(_read), _SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Per record the size and digest of its full payload, taken for revisits from the response they refer to.

    records: (record_id, record_type, page_id, refers_to, payload_bytes, payload_digest) of what is stored. A record id
    names a page and a payload, so responses that share one are equal.
    """
    whole = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    by_id = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("of"), "payload_bytes", "payload_digest").distinct()
    again = records.where("record_type = 'revisit'").select("page_id", F.col("refers_to").alias("refers_id"), "record_type").join(by_id, "refers_id", "left")
    return whole.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("of").alias("refers_to")))
