"""WARC archives: a writer with revisit records and a sequential reader.

Each record is a gzip member of its own.  The reader goes through an archive from front to back:
it inflates member by member in small steps, frames the block by Content-Length and verifies the
payload digest.  Archives are written below the shared folder through ``pyarrow.fs`` (local, HDFS,
S3, ...); what a finished task wrote is listed in a manifest table, so that files of failed attempts
are never read.

Defined cases: null html is an empty payload; a null URL becomes ``urn:page:<id>``; pages with equal
payloads (of at least ``min_revisit`` bytes) share one response, the smallest page_id, null ids never
being smaller than others; rows that repeat that page_id are responses too; an empty table gives no
archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from guardframe.llm.common import materialize, new_path

ARCHIVE_BYTES = 64 << 20
STEP = 64 << 10
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("verified", T.BooleanType()),
])


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record, compressed as a gzip member; a revisit of ``first`` where that is given."""
    kind, digest = ("response" if first is None else "revisit"), sha1(payload)
    block = HTTP + payload if first is None else HTTP
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", "WARC-Date": DATE,
        "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1(block)}", "X-Payload-Length": str(len(payload)),
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if first is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": str(first)}
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress(text.encode() + block + b"\r\n\r\n") + deflate.flush()


def with_first(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """page_id, url, html and ``first``: for revisits the page they repeat, else null.

    Payloads that occur once need no partner, so only the digests of repeated ones are joined; the
    table of them is stored before, which leaves Spark free to split a very common payload.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    again = rows.filter(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.count("*").alias("copies"), F.min("page_id").alias("first"))
    again = materialize(again.filter("copies > 1 AND first IS NOT NULL").select("digest", "first"), "payloads")
    joined = rows.join(again, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("first"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of ``with_first`` to archives in ``folder``; the stored manifest of those written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, place = fs.FileSystem.from_uri(folder)
        disk.create_dir(place, recursive=True)
        out, name, n, size = None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], names=MANIFEST.names)

        for batch in batches:
            for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = disk.open_output_stream(f"{place}/{name}")
                made = record(page, url, html.encode(), first)
                out.write(made)
                n, size = n + 1, size + len(made)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


class Members:
    """The inflated gzip members of a stream, one after another, in steps of STEP bytes."""

    def __init__(self, stream):
        self.stream, self.raw, self.offset = stream, b"", 0

    def __iter__(self) -> Iterator[tuple[int, Iterator[bytes]]]:
        while self.raw or self.more():
            start = self.offset
            parts = self.member()
            yield start, parts
            for _ in parts:  # what the caller left unread
                pass

    def more(self) -> bool:
        self.raw = self.stream.read(STEP)
        return bool(self.raw)

    def member(self) -> Iterator[bytes]:
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not self.raw and not self.more():
                raise ValueError("the archive ends within a record")
            had = len(self.raw)
            part = inflate.decompress(self.raw)
            self.raw = inflate.unused_data
            self.offset += had - len(self.raw)
            if part:
                yield part


def parse(parts: Iterator[bytes]) -> tuple[dict, int, str, int]:
    """Headers, block length, digest and length of the payload of one record."""
    held = b""
    while b"\r\n\r\n" not in held:
        held += next(parts)
    top, _, rest = held.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("a record begins with no WARC version")
    head = dict(line.split(": ", 1) for line in lines)
    left, block, size, inside = int(head["Content-Length"]), hashlib.sha1(), 0, b""
    payload, in_payload, tail = hashlib.sha1(), False, b""

    def pieces():
        yield rest
        yield from parts

    for piece in pieces():
        body, over = piece[:left], piece[left:]
        left -= len(body)
        tail += over
        block.update(body)
        if not in_payload:  # HTTP headers come first, up to an empty line
            inside += body
            if b"\r\n\r\n" not in inside:
                continue
            in_payload, body = True, inside.partition(b"\r\n\r\n")[2]
        payload.update(body)
        size += len(body)
    if left or tail != b"\r\n\r\n":
        raise ValueError("the block's length isn't what Content-Length says")
    if "sha1:" + base64.b32encode(block.digest()).decode() != head["WARC-Block-Digest"]:
        raise ValueError("the block's digest is wrong")
    return head, size, base64.b32encode(payload.digest()).decode(), size


def read_archives(manifest: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """A row of RECORDS for each record of the archives that ``manifest`` lists."""
    tasks = tasks or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = manifest.select("archive").repartition(tasks, "archive")

    def rows(name: str, stream) -> Iterator[tuple]:
        for offset, parts in Members(stream):
            head, size, digest, _ = parse(parts)
            said, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
            page, to = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
            if kind == "response" and (said != digest or size != int(head["X-Payload-Length"])):
                raise ValueError(f"{name} at {offset}: the payload's digest is wrong")
            yield (page and int(page), int(head["X-Payload-Length"]), said, kind, to and int(to), head["WARC-Target-URI"], name, offset, kind == "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(RECORDS)
        disk, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with disk.open_input_stream(f"{place}/{name}") as stream:
                    held = []
                    for row in rows(name, stream):
                        held.append(row)
                        if len(held) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return listed.mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with revisits verified: the response they refer to has been read with that payload.

    A revisit whose response isn't there or has other content fails the query.
    """
    asked = records.filter("refers_to IS NOT NULL").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    there = records.filter("record_type = 'response'").join(asked, ["page_id", "payload_digest", "payload_bytes"], "left_semi").distinct()
    there = there.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("_gf_there")).distinct()
    both = records.join(there, ["refers_to", "payload_digest", "payload_bytes"], "left")
    wrong = F.raise_error(F.concat(F.lit("no response for the revisit "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    verified = F.when((F.col("record_type") == "revisit") & F.col("_gf_there").isNull(), wrong.cast("boolean")).otherwise(F.lit(True))
    return both.select(*(verified.alias(c) if c == "verified" else F.col(c) for c in records.columns))


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write a record for every page, then read the archives back and resolve the revisits."""
    folder = new_path(pages.sparkSession, "warc")
    read = read_archives(write_archives(with_first(pages, min_revisit=min_revisit), folder), folder)
    return resolved(materialize(read, "records"))
