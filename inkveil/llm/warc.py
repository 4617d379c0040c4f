"""WARC archives: writing, reading, and revisit resolution by payload digest.

A response record's block is an HTTP response with the payload; a revisit's the
same response's head alone. Each record is a gzip member of its own, so that it
can be fetched by its offset. Spark's text writer writes them, with an empty
member as line separator, so any store will do; archives are read as binary files,
parsed by Content-Length, and every response's digest is computed anew.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _bytes as B
from ._shared import written

#: Records in one archive file.
RECORDS_PER_FILE = 2000
#: Payloads of at least 1 / HEAVY of all records are broadcast.
HEAVY = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, record_id string, payload string"
_EMPTY = gzip.compress(b"", mtime=0)


def _uuid(h: Column) -> Column:
    return F.concat_ws("-", *(F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def resolve(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Of headers (page, page_id, sha1, sha256, bytes), a written table with one row and its number n for equal ones: (page,
    sha1, sha256, first) of those that are or refer to the response of a payload of at least min_bytes that comes more
    than once. first: the smallest page_id, null last; page: page_id as text.

    Headers alone are shuffled by digest; SHA-1 and SHA-256 must both agree.
    Payloads of at least 1 / HEAVY of all records, so at most HEAVY of them, find
    their headers by a broadcast.
    """
    some = heads.where(F.col("bytes") >= min_bytes)
    firsts = some.groupBy("sha1", "sha256").agg(F.min("page_id").alias("first"), F.sum("n").alias("all")).where("all > 1")
    total = heads.agg(F.sum("n")).first()[0] or 0
    keys, out = ["sha1", "sha256"], ["page", "sha1", "sha256", "first"]
    heavy = F.broadcast(firsts.where(F.col("all") * HEAVY >= total))
    few = some.join(heavy.select(*keys), keys, "left_anti").join(firsts.where(F.col("all") * HEAVY < total), keys)
    return some.join(heavy, keys).select(*out).unionByName(few.select(*out)).withColumn("again", F.lit(True))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The rows of (page_id, url, payload) with sha1, record_type, refers_to, record_id and refers_to_id.

    The response of a payload is the row with the smallest page_id; of several
    such rows the first by URL. That follows from the rows' values alone, so it
    doesn't matter how often and in what order the pages are read. Payloads are
    shuffled once, by page and digest, so that none is hot.
    """
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page")
    rows = pages.select(page, "page_id", "url", "payload", F.unhex(F.sha1("payload")).alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("sha256"))
    heads = rows.select("page", "page_id", "sha1", "sha256", F.octet_length("payload").alias("bytes")).groupBy("page", "page_id", "sha1", "sha256", "bytes").agg(F.count("*").alias("n"))
    found = resolve(written(heads, "headers"), min_bytes)
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("page", "sha1", "sha256").orderBy("url")))
    r = placed.join(found, ["page", "sha1", "sha256"], "left")
    response = F.col("again").isNull() | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("place") == 1))
    name = lambda page, place: _uuid(F.md5(F.concat(page, F.lit(" "), F.hex("sha256"), F.lit(" "), place.cast("string")).cast("binary")))
    own, other = name(F.col("page"), F.col("place")), name(F.coalesce(F.col("first").cast("string"), F.lit("null")), F.lit(1))
    return r.select("page_id", "url", "payload", "sha1", F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("first")).alias("refers_to"), own.alias("record_id"), F.when(~response, other).alias("refers_to_id"))


def record(row: dict, date: str) -> bytes:
    """One record with fresh headers. Line ends in a URL become spaces; a null id is not written."""
    again, payload = row["record_type"] == "revisit", (row["payload"] or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if again else http + payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{row['record_id']}>"), ("WARC-Date", date)]
    head += [("WARC-Target-URI", row["url"].replace("\r", " ").replace("\n", " "))] if row["url"] is not None else []
    head += [("WARC-Payload-Digest", f"sha1:{base64.b32encode(row['sha1']).decode()}")]
    head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:uuid:{row['refers_to_id']}>")] if again else []
    head += [(k, str(row[c])) for k, c in (("X-Page-Id", "page_id"), ("X-Refers-To-Page-Id", "refers_to")) if row[c] is not None]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write(rows: DataFrame, path: str, date: str | None = None, per_file: int = RECORDS_PER_FILE) -> None:
    """Writes the records as archives, one gzip member each. date: WARC-Date of all; now, if it is not given."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.slices(batch, "payload"):
                yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(record(r, date), 6, mtime=0) for r in part.to_pylist()], pa.binary())], names=["value"])

    out = rows.mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin-1")).option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, block and offset of each record of an archive of gzip members; empty members are passed over."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, begin, parts = zlib.decompressobj(31), at, []
        while not member.eof:
            if at >= len(view):
                raise ValueError(f"the archive ends within the member at byte {begin}")
            fed = view[at : at + (1 << 16)]
            parts.append(member.decompress(fed))
            at += len(fed) - len(member.unused_data)
        text = b"".join(parts)
        if not text:
            continue
        end = text.index(b"\r\n\r\n")
        lines = text[:end].decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = text[end + 4 : end + 4 + int(head["Content-Length"])]
        if not lines[0].startswith("WARC/") or text[end + 4 + len(block) :] != b"\r\n\r\n":
            raise ValueError(f"not a whole WARC record at byte {begin}")
        yield head, block, begin


def _row(head: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    again, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    if not again and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of record {head['WARC-Record-ID']} is not that of its digest")
    number = lambda k: int(head[k]) if k in head else None
    return {"page_id": number("X-Page-Id"), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "payload_digest": digest, "payload_bytes": size, "refers_to": number("X-Refers-To-Page-Id"), "record_id": head["WARC-Record-ID"], "payload": None if again else payload.decode()}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under a path; payload is null for revisits. A response whose payload does not have its
    digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for head, block, _ in parse(content.as_buffer()):
                    rows.append(_row(head, block))
                    size += len(block)
                    if size > B.CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _READ.split(", ")])
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, _READ)


def deduplicate(pages: DataFrame, path: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages as deduplicated archives under path and returns what read() gives of them.

    Null payloads count as empty. Empty tables give archives without records. Of
    equal payloads the smallest page_id is the response, a null id the last; of
    rows with that id too, the first by URL (null first); repeated rows revisit
    it. A very long payload is one member, whole. Extra columns are not written.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    write(records(rows, min_bytes), path)
    return read(pages.sparkSession, path)
