"""WARC archives: writing with segmented records and revisits, reading with segment reassembly.

Writing: each page is a record whose block is an HTTP response with the payload in chunked transfer framing. A block
longer than SEGMENT_BYTES is cut: the first segment is the record itself (WARC-Segment-Number 1), the others are
continuation records that name it (WARC-Segment-Origin-ID) and their number, the last with WARC-Segment-Total-Length.
Of pages with equal payloads one is the response, the others are revisit records without payload; WARC-Refers-To names
the response's record. A record's id is made of its page and its payload's digest, so that a revisit knows the id of
what it refers to; rows that repeat page and payload have a number as well, given once and checkpointed.

Each record is a gzip member of its own, so that a reader can begin at any. Files are written by Spark's text writer, which
passes a value's bytes through, so that Spark commits them on any store that it can write, also when tasks are tried
again; its line separator, which follows each value, is a fixed member that holds a record's two line ends. (Spark's
writer ends their names in .txt; they are what others call .warc.gz.)

Reading: whole archive files (bounded by FILE_RECORDS) are parsed by Content-Length. Records in one part are
decoded where they are read; segments are grouped by origin identifier, ordered by number and joined, and their total
length is verified; then the chunked framing is decoded. A revisit gets size and digest of the payload it refers to.

Defined results: a null html is an empty payload. A null page id is written as such; nulls are last in the choice of
the response, and rows that share the smallest id and the payload are all responses. Repeated rows are records of their
own. A null or empty url is urn:page: and the page's id, as a record must name its target. A very long html is cut into
as many segments as it takes. An empty table gives empty archives and an empty result. Other columns are ignored,
whatever their names. A payload of which 100,000 or more repeat one another is joined by its digest, by a shuffle whose
skewed parts Spark splits.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderkeep.llm.common import map_arrow, prepare, table
from orderkeep.session import cut, own_folder

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
READ_BYTES = 2 << 10
#: Records of an archive file at most; keeps a file's size, and so a reader's memory, bounded.
FILE_RECORDS = 1000
#: Up to so many repeated payloads are broadcast; more are joined by a shuffle.
MAX_SMALL = 100_000
# Fixed value: a gzip member of the four bytes that end a record (no time, no name, stored).
RECORD_END = bytes.fromhex("1f8b08000000000000ff" "010400fbff" "0d0a0d0a" "4415c28b" "04000000")
# Fixed value: the date of every record; archives of the same pages are the same.
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """SHA-1 in base32, without padding (a digest of 20 bytes needs none)."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **fields, "WARC-Date": DATE, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None).encode() + b"\r\n" + block


def record_id(page: int | None, hashed: str, number: int | None = None) -> str:
    """A record's id, by its page and payload digest, and a number where rows repeat both."""
    return f"<urn:page:{'-' if page is None else page}:{hashed}{'' if number is None else f':{number}'}>"


def records(page: int | None, url: str | None, payload: bytes, hashed: str, response: str | None = None, number: int | None = None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """A page's records without the line ends that follow each. response: the id of the record that a revisit refers to."""
    name = record_id(page, hashed, number)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{'-' if page is None else page}"
    fields = {"WARC-Record-ID": name, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{hashed}", "Content-Type": "application/http; msgtype=response"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if response is not None:
        yield _record("revisit", fields | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": response}, http)
        return
    block = http + chunked(payload)
    if len(block) <= segment:
        yield _record("response", fields, block)
        return
    last = -(-len(block) // segment)
    for k in range(1, last + 1):
        part = block[(k - 1) * segment : k * segment]
        if k == 1:
            yield _record("response", fields | {"WARC-Segment-Number": 1}, part)
        else:
            yield _record("continuation", {"WARC-Record-ID": f"{name[:-1]}/{k}>", "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": len(block) if k == last else None}, part)


def write(pages: DataFrame, folder: str, least_bytes: int = 0, segment: int = SEGMENT_BYTES) -> None:
    """Write (page_id long, url, html) as archives into a new folder; payloads of least_bytes or more are revisited."""
    spark = pages.sparkSession
    prepare(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("size"))
    same = cut(rows.groupBy("sha", "size").agg(F.min("page").alias("response"), F.count("*").alias("n")).filter("n > 1").select("sha", "size", "response"))
    few = F.broadcast(same) if same.count() <= MAX_SMALL else same
    known = rows.join(few, ["sha", "size"], "left")
    known = known.withColumn("response", F.when((F.col("size") >= least_bytes) & ~F.col("page").eqNullSafe(F.col("response")), F.col("response")))
    # rows that repeat page and payload: few tables have any
    again = cut(rows.select("page", "sha", "size").join(few, ["sha", "size"], "left_semi").groupBy("page", "sha", "size").count().filter("count > 1").select(F.col("page").alias("p"), F.col("sha").alias("s"), F.col("size").alias("z")))
    known = known.withColumns({"number": F.lit(None).cast("long"), "first": F.lit(None).cast("long")})
    if again.count():
        hit = F.col("page").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z"))
        one = F.broadcast(again) if again.count() <= MAX_SMALL else again
        numbered = cut(known.drop("number").join(one, hit, "left_semi").withColumn("number", F.monotonically_increasing_id()).select(*known.columns))
        known = known.join(one, hit, "left_anti").unionByName(numbered)
        # a revisit names the first of several responses
        begin = cut(numbered.filter("response IS NULL").groupBy("page", "sha", "size").agg(F.min("number").alias("f")).select(F.col("page").alias("p"), F.col("sha").alias("s"), F.col("size").alias("z"), "f"))
        refers = (F.col("response") == F.col("p")) & (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z"))
        known = known.join(F.broadcast(begin) if begin.count() <= MAX_SMALL else begin, refers, "left").withColumn("first", F.col("f"))
    known = known.select("page", "url", "html", F.unhex("sha").alias("sha"), "response", "number", "first")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for page, url, html, sha, response, number, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hashed = base64.b32encode(sha).decode()
            for r in records(page, url, html.encode(), hashed, None if response is None else record_id(response, hashed, first), number, segment):
                made.append(gzip.compress(r, 6, mtime=0))
                size += len(made[-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    written = map_arrow(known, run, "record binary").select(F.col("record").cast("string").alias("value"))
    written.write.option("encoding", "ISO-8859-1").option("lineSep", RECORD_END.decode("latin-1")).option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def members(content: bytes) -> bytes:
    """What a file of many gzip members holds. Members are read a little at a time, so that none copies all that follow it."""
    out, at, one = [], 0, zlib.decompressobj(31)
    while at < len(content):
        if content.startswith(RECORD_END, at):
            out.append(b"\r\n\r\n")
            at += len(RECORD_END)
            continue
        while not one.eof:
            part = content[at : at + READ_BYTES]
            if not part:
                raise ValueError("an archive is cut off")
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        one = zlib.decompressobj(31)
    return b"".join(out)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) for each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record begins here")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        at = end + 4
        block = content[at : at + size]
        if len(block) < size or content[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield fields, block
        at += size + 4


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    coded = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n")[1:])
    return dechunked(body) if coded else body


def reassemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (segment number, total length where known, bytes); numbers must be 1 to n and the length must agree."""
    parts = sorted(parts, key=lambda p: p[0])
    block = b"".join(p[2] for p in parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or [p[1] for p in parts if p[1] is not None] != [len(block)]:
        raise ValueError("segments are missing, repeated or of the wrong length")
    return block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload binary, payload_bytes, payload_digest, record_id, refers_id) for each response
    and revisit; a revisit has no payload of its own."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    kinds = "name string, type string, refers string, digest string, origin string, segment int, total long, block binary"
    names = [x.split()[0] for x in kinds.split(", ")]
    arrow = [*[pa.string()] * 5, pa.int32(), pa.int64(), pa.binary()]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for content in batch.column("content"):
            held, size = [], 0
            for fields, block in parse(members(content.as_py())):
                number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                row = [fields["warc-record-id"], fields["warc-type"], fields.get("warc-refers-to"), fields.get("warc-payload-digest"), fields.get("warc-segment-origin-id"), number and int(number), total and int(total), block]
                held.append(row)
                size += len(block)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow, strict=True)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), arrow, strict=True)], names=names)

    parsed = map_arrow(files, run, kinds)
    whole = parsed.filter("segment IS NULL").select("name", "type", "refers", "digest", "block", F.lit(None).cast("array<struct<segment:int,total:bigint,block:binary>>").alias("parts"))
    # a page's segments: bounded by the page
    cut_up = parsed.filter("segment IS NOT NULL").groupBy(F.coalesce("origin", "name").alias("name")).agg(F.max(F.when(F.col("segment") == 1, F.struct("type", "refers", "digest"))).alias("first"), F.collect_list(F.struct("segment", "total", "block")).alias("parts"))
    joined = whole.unionByName(cut_up.select("name", "first.type", "first.refers", "first.digest", F.lit(None).cast("binary").alias("block"), "parts"))

    def decode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for name, kind, refers, hashed, block, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if parts:
                block = reassemble([(p["segment"], p["total"], p["block"]) for p in parts])
            page, other = (x and x.strip("<>").split(":")[2] for x in (name, refers))
            payload = payload_of(block) if kind == "response" else None
            own = None if payload is None else digest(payload)
            if own is not None and hashed not in (None, f"sha1:{own}"):
                raise ValueError(f"the payload of {name} has another digest")
            out.append([None if page == "-" else int(page), kind, other and int(other), payload, None if payload is None else len(payload), own, name, refers])
        types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["page_id", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "record_id", "refers_id"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)], names=names)

    return map_arrow(joined, decode, "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, record_id string, refers_id string")


def resolve(found: DataFrame) -> DataFrame:
    """What read() gave, without payloads; revisits with size and digest of the record that they refer to."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = cut(found.drop("payload"))
    responses, revisits = rows.filter("record_type = 'response'"), rows.filter("record_type = 'revisit'")
    named = revisits.select(F.col("refers_id").alias("record_id")).distinct()
    sources = cut(responses.join(named, "record_id", "left_semi").select(F.col("record_id").alias("refers_id"), "payload_bytes", "payload_digest"))
    return responses.select(columns).unionByName(revisits.drop("payload_bytes", "payload_digest").join(sources, "refers_id", "left").select(columns))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    folder = f"{own_folder(spark, 'warc')}/w"
    write(table(spark, sf_dir, "pages"), folder)
    return resolve(read(spark, folder))


OP5_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS response FROM p),
d AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::INTEGER) AS part FROM r)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(part, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> s) % 32 + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM response OR response IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM d"""
