"""WARC archives of pages: writing with segmentation, and reading with reassembly.

Writing: a page becomes an HTTP response with chunked transfer framing; blocks over the segment size go on in
continuation records, which any file may hold. Pages of equal large payloads are written once, the others as
revisit records. Spark's text writer lays the records down, with the record's end mark as its separator, so
files are committed as any Spark output is. Reading: each file is parsed by itself; whole records are decoded
on the spot, segments are grouped by the identifier of the record that they continue, ordered by number,
checked against the total length, joined, and decoded.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    """segment_bytes: largest block of a record; chunk_bytes: of an HTTP chunk; least_revisit: smaller payloads are
    always written; records_per_file bounds a file, and so what a reading task holds."""

    segment_bytes: int = 16_384
    chunk_bytes: int = 4_096
    least_revisit: int = 1_000
    records_per_file: int = 2_000


def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are skipped. ValueError if it is cut off."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("no chunk size")
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if line + 4 + size > len(body):
            raise ValueError("a chunk is cut off")
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response, decoded if its head says that it is chunked."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: dict[str, object], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block


def _clean(url: str | None) -> str | None:
    """A URL as a field value: control characters and spaces would break the head."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else None


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, p: Archive) -> Iterator[bytes]:
    """The records of a page, without the end mark."""
    name = "" if page_id is None else page_id
    own = f"<urn:page:{name}:{uuid.uuid4()}>"
    digest = "sha1:" + hashlib.sha1(payload).hexdigest()
    fields = {"WARC-Record-ID": own, "WARC-Target-URI": _clean(url), "WARC-Date": "2000-01-01T00:00:00Z", "WARC-Payload-Digest": digest}
    if refers_to is not None:
        yield _record({"WARC-Type": "revisit", **fields, "WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, b"")
        return
    block = _HTTP + chunked(payload, p.chunk_bytes)
    parts = [block[i : i + p.segment_bytes] for i in range(0, len(block), p.segment_bytes)]
    fields["Content-Type"] = "application/http;msgtype=response"
    if len(parts) == 1:
        yield _record({"WARC-Type": "response", **fields}, block)
        return
    yield _record({"WARC-Type": "response", **fields, "WARC-Segment-Number": 1}, parts[0])
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield _record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": fields["WARC-Date"], "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": n, "WARC-Segment-Total-Length": total}, part)


def write_archive(pages: DataFrame, path: str, p: Archive = Archive()) -> None:
    """pages(page_id, url, html, ...) as gzipped WARC files under path.

    Null html is an empty payload, a null url gives no target; a null page_id never is revisited. Of repeated
    rows with the largest page_id of their payload each is a response. Other columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    held = rows.where((F.octet_length("payload") >= p.least_revisit) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("holder"), F.min("page_id").alias("least")).where("least < holder").select("digest", "holder")
    rows = rows.join(held, "digest", "left").withColumn("refers_to", F.when(F.col("holder") != F.col("page_id"), F.col("holder")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256).to_pydict()
                made = [x for row in zip(*part.values(), strict=True) for x in records_of(*row, p)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    made = rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", p.records_per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of a file."""
    at = 0
    while (head_end := data.find(b"\r\n\r\n", at)) >= 0:
        lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = head_end + 4
        size = int(fields["content-length"])
        yield fields, data[start : start + size]
        at = start + size + len(END)


def _page(identifier: str) -> int | None:
    name = identifier.strip("<>").split(":")[2]
    return int(name) if name else None


_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, whole boolean, origin string, number int, total long, block binary"


def _decoded(block: bytes, total: int | None) -> tuple[int | None, str | None, bool]:
    """Length and SHA-1 of the payload; whole is false, with nulls, if bytes are missing."""
    if total is not None and total != len(block):
        return None, None, False
    try:
        payload = payload_of(block)
    except ValueError:
        return None, None, False
    return len(payload), hashlib.sha1(payload).hexdigest(), True


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, whole): a row per response and revisit record.

    Length and digest are those of the decoded payload; a revisit record's those of the response that it
    refers to (null without one). A record whose segments are incomplete has whole = false and nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("whole", pa.bool_()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        for b in batches:
            for content in b.column("content"):
                rows = []
                for f, block in parse(gzip.decompress(content.as_py())):
                    kind, own, url = f["warc-type"], f["warc-record-id"], f.get("warc-target-uri")
                    if kind == "revisit":
                        rows.append((_page(own), url, kind, _page(f["warc-refers-to"]), None, None, True, None, None, None, None))
                    elif kind == "response" and "warc-segment-number" not in f:
                        rows.append((_page(own), url, kind, None, *_decoded(block, None), None, None, None, None))
                    elif kind in ("response", "continuation"):
                        total = f.get("warc-segment-total-length")
                        origin = f.get("warc-segment-origin-id", own)
                        rows.append((None, url, kind, None, None, None, None, origin, int(f["warc-segment-number"]), total and int(total), block))
                    if len(rows) >= 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _READ)
    return found


def reassembled(found: DataFrame) -> DataFrame:
    """The segmented records among the rows of a reading, put together: one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, size, digest, whole = [], [], [], []
            for origin, parts, total in zip(*(b.column(c) for c in ("origin", "parts", "total")), strict=True):
                ids.append(_page(origin.as_py()))
                parts = sorted((x["number"], x["block"]) for x in parts.as_py())
                complete = [n for n, _ in parts] == list(range(1, len(parts) + 1)) and total.as_py() is not None
                got = _decoded(b"".join(x for _, x in parts), total.as_py()) if complete else (None, None, False)
                for out, x in zip((size, digest, whole), got, strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column("url"), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(whole, pa.bool_())], ["page_id", "url", "payload_bytes", "payload_digest", "whole"])

    parts = found.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "block")).alias("parts"), F.max("total").alias("total"), F.max("url").alias("url"))
    return parts.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, whole boolean")


def round_trip(pages: DataFrame, path: str, p: Archive = Archive()) -> DataFrame:
    """Writes pages to path and reads the archive back (see write_archive and records)."""
    write_archive(pages, path, p)
    return records(pages.sparkSession, path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, whole) of every page of an archive."""
    found = read_archive(spark, path)
    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "whole"]
    responses = found.where("record_type = 'response' and origin is null").select(*columns)
    joined = reassembled(found).select("page_id", "url", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_bytes", "payload_digest", "whole")
    responses = responses.unionByName(joined)
    target = responses.where("whole").groupBy(F.col("page_id").alias("target")).agg(F.min("payload_bytes").alias("t_bytes"), F.min("payload_digest").alias("t_digest"))
    revisits = found.where("record_type = 'revisit'").select("page_id", "url", "record_type", "refers_to", "whole").join(target, F.col("refers_to") == F.col("target"), "left")
    revisits = revisits.select("page_id", "url", "record_type", "refers_to", F.col("t_bytes").alias("payload_bytes"), F.col("t_digest").alias("payload_digest"), "whole")
    return responses.unionByName(revisits)
