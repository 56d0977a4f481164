"""WARC archives: writing captures, reading records, assembling transactions.

Each capture is a request, a response (or a revisit of an equal payload) and a
metadata record.  Request and metadata name the response in WARC-Concurrent-To;
``assemble`` joins the three through those identifiers into one nested row.

Archives are written by Spark's text writer, a record to a "line" that ends with
the blank lines a WARC record ends with, so any store Spark can write to will
do, a task's retry leaves no half file, and files are gzip.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uuid(*parts) -> Column:
    h = F.md5(F.to_json(F.struct(*parts)))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[x for i in (9, 13, 17) for x in (F.lit("-"), F.substring(h, i, 4))], F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(kind: str, record_id: Column, block: Column, content_type: str, *lines: Column) -> Column:
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n"),
        _line("WARC-Record-ID", record_id),
        *lines,
        F.lit(f"Content-Type: {content_type}\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000) -> None:
    """Write the captures of pages as gzip WARC files into the folder path.

    Of records with equal payloads of at least revisit_bytes, the one with the
    largest id is written as response and the others as revisits of it; where
    all their ids are null, all are responses.  Rows that repeat an id are all
    written.  A null payload is an empty one; a null url or id gives records
    without that header; line breaks in a url are percent-encoded.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("rank"), F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    # partial aggregation: a payload that a third of all pages have leaves a row a task
    first = rows.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.max(F.struct("rank", "page", "uri")).alias("first"), F.count("*").alias("of"))
    first = store.materialise(first.where((F.col("of") > 1) & F.col("first.rank").isNotNull()).select("digest", "first"), "warc-first")
    rows = rows.join(first, "digest", "left")
    rows = rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("rank").eqNullSafe(F.col("first.rank")))

    main = _uuid(F.lit("capture"), F.col("page"), F.col("uri"), F.col("digest"))
    refers = _uuid(F.lit("capture"), F.col("first.page").alias("page"), F.col("first.uri").alias("uri"), F.col("digest"))
    target = _line("WARC-Target-URI", F.col("uri"))
    concurrent = _line("WARC-Concurrent-To", main)
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    response = _record("response", main, F.concat(http, F.col("payload")), "application/http; msgtype=response", target, digest)
    revisit = _record("revisit", main, http, "application/http; msgtype=response", target, digest, F.lit(f"WARC-Profile: {REVISIT}\r\n"), _line("WARC-Refers-To", refers), _line("WARC-Refers-To-Target-URI", F.col("first.uri")))
    host = F.regexp_extract(F.coalesce("uri", F.lit("")), "://([^/?#]*)", 1)
    after = F.regexp_extract(F.coalesce("uri", F.lit("")), "://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(after.startswith("/"), after).otherwise(F.concat(F.lit("/"), after)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    request = _record("request", _uuid(F.lit("request"), F.col("page"), F.col("uri"), F.col("digest")), asked, "application/http; msgtype=request", target, concurrent)
    metadata = _record("metadata", _uuid(F.lit("metadata"), F.col("page"), F.col("uri"), F.col("digest")), F.concat(_line("page-id", F.col("page")), F.lit("via: crawl\r\n")), "application/warc-fields", target, concurrent)
    records = rows.select(F.explode(F.array(request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(path)
    store.release(spark)


RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, uri string, date string, payload_bytes long, payload_digest string, page string, payload binary"


def parse(stream: io.BufferedIOBase, with_payload: bool = False) -> Iterator[tuple]:
    """The records of an open archive, one payload in memory at a time."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _fields(stream)
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"{head['warc-record-id']} breaks off after {len(block)} of {size} bytes")
        kind, n, digest, page, body = head["warc-type"], None, None, None, None
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            if kind == "response":
                n, digest = len(body), hashlib.sha1(body).hexdigest()
                if head.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
                    raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
            else:
                n = int(_fields(io.BytesIO(http.partition(b"\r\n")[2] + b"\r\n"))["content-length"])
                digest, body = head["warc-payload-digest"].removeprefix("sha1:"), None
        elif kind == "metadata":
            page = _fields(io.BytesIO(block)).get("page-id")
        yield head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), n, digest, page, body if with_payload else None


def _fields(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives in the folder path.

    A task inflates its archives as a stream, one member or many, cut where
    records may end and put together again, so that it holds some payloads at a
    time and never a file.  A record that breaks off, one that begins otherwise
    or a payload that does not have its digest raises.  A folder of empty
    archives gives no rows.
    """
    store.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64() if t == "long" else pa.binary() if t == "binary" else pa.string()) for c, t in (x.split(" ") for x in RECORD.split(", "))])
        kept, held = [], 0
        for r in parse(io.BufferedReader(_Joined(x.as_py() for batch in batches for x in batch.column(0)), 1 << 16), with_payload):
            kept.append(r)
            held += len(r[-1] or b"") + 500
            if held > 4 << 20:
                yield _rows(kept, schema)
                kept, held = [], 0
        if kept:
            yield _rows(kept, schema)

    # gzip files are never split, and a partition has the parts of each in their order
    parts = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path)
    return parts.select(F.col("value").cast("binary").alias("part")).mapInArrow(run, RECORD)


class _Joined(io.RawIOBase):
    """Parts as one stream, each followed by the END that it was cut at."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.left = parts, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.left:
            part = next(self.parts, None)
            if part is None:
                return 0
            self.left = memoryview(part + END.encode())
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def _rows(kept: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, response, request, metadata, copies).

    response is the response or revisit record; request and metadata are those
    that are concurrent to it, null where there is none.  A request that the
    response itself names in WARC-Concurrent-To counts too, and so does metadata
    concurrent to that request.  Records that no response is concurrent to give
    no row.  A record that was archived several times counts once, and copies
    says how often.
    """
    main = F.col("record_type").isin("response", "revisit")
    named = records.where(main & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("rid")).agg(F.min("record_id").alias("capture"))
    own = records.where(main).withColumn("capture", F.col("record_id"))
    rest = records.where(~main)
    rest = rest.join(named.select(F.col("rid").alias("record_id"), F.col("capture").alias("by_id")), "record_id", "left")
    rest = rest.join(named.select(F.col("rid").alias("concurrent_to"), F.col("capture").alias("by_to")), "concurrent_to", "left")
    rest = rest.withColumn("capture", F.coalesce("by_id", "by_to", "concurrent_to")).drop("by_id", "by_to")
    body = F.struct(*[c for c in records.columns])
    of = lambda kind: F.first(F.when(F.col("record_type").isin(*kind), body), ignorenulls=True)
    nested = own.unionByName(rest).where(F.col("capture").isNotNull()).groupBy(F.col("capture").alias("capture_id")).agg(
        of(["response", "revisit"]).alias("response"), of(["request"]).alias("request"), of(["metadata"]).alias("metadata"), F.sum(main.cast("long")).alias("copies")
    )
    return nested.where(F.col("response").isNotNull())
