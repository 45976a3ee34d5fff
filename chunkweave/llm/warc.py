"""WARC writing and reading with segmented records and chunked transfer framing.

Writing. One record per page: a response with the whole HTTP message (chunked transfer framing),
or a revisit (identical-payload-digest) of the page with the smallest id that has an equal
payload. Messages longer than a segment are cut into a first record and continuation records that
name its identifier. Spark's text writer puts the records, which are UTF-8, into gzip files with
the record separator between them, so archives can be in any store that Spark writes.

Reading. Whole files are parsed by Content-Length. A record that is whole by itself is decoded
where it is read. Segments are dealt by origin identifier and ordered by segment number; a stream
over each group joins the blocks, verifies segment numbers and the total length, decodes the
chunked framing and holds the payload against its digest. A violation raises.

Defined cases. A null html is empty. Rows with equal page_id and payload are all of the same kind.
A null page_id is never revisited while another id has the payload, and stays null. Null or odd
urls are percent-encoded. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm._util import bounded_batches

#: Bytes of a record's block before it is segmented, and of a transfer chunk.
SEGMENT, CHUNK = 16_384, 4096
#: Records of one archive file. Blocks are at most SEGMENT bytes long, so a file holds at most 33 MB besides headers.
FILE_RECORDS = 2000
DATE = "2000-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID(int=0)
_END = "\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, said: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}:{said}')}>"


def _cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most size bytes that don't split a character."""
    out, at = [], 0
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data) and to > at + 1 and data[to] & 0xC0 == 0x80:
            to -= 1
        out.append(data[at:to])
        at = to
    return out


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return f"WARC/1.1\r\n{head}\r\n{block.decode()}"


def records(page: int | None, url: str | None, payload: bytes, first: int | None) -> list[str]:
    """A page's records; first: the page that it revisits."""
    said = digest(payload)
    name = record_id(page, said)
    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", urllib.parse.quote(url or "urn:unknown", safe=":/?#[]@!$&'()*+,;=%")), ("WARC-Payload-Digest", f"sha1:{said}"), ("X-Page-Id", page)]
    http = [("Content-Type", "application/http; msgtype=response")]
    if first is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{_END}".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record([("WARC-Type", "revisit"), *common, ("WARC-Profile", profile), ("WARC-Refers-To", record_id(first, said)), ("X-Refers-To-Page-Id", first), *http], block)]
    framed = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in [*_cut(payload, CHUNK), b""])
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked{_END}".encode() + framed
    if len(block) <= SEGMENT:
        return [_record([("WARC-Type", "response"), *common, *http], block)]
    parts = _cut(block, SEGMENT)
    out = [_record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1), *http], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{name}:{k}')}>"
        last = len(block) if k == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), common[2], ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", last)], part))
    return out


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives of pages(page_id, url, html) under path; payloads under least_bytes are never revisits."""
    bounded_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha"))
    narrow = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "sha")
    firsts = narrow.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("sha", "first")
    again = narrow.join(firsts, "sha").where("page_id IS NULL OR page_id <> first").distinct()
    known = again.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first")
    joined = rows.join(known, rows["page_id"].eqNullSafe(known["p"]) & (rows["sha"] == known["s"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str] = []
            for page, url, text, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                out += records(page, url, text.encode(), first)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    lines = joined.select("page_id", "url", "html", "first").mapInArrow(run, "value string")
    lines.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def inflated(data: bytes) -> bytes:
    """All members of a gzip file, or data itself if it isn't one."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        if not d.eof:
            raise ValueError("a truncated archive")
        data = d.unused_data
    return b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record."""
    at, end = 0, _END.encode()
    while at < len(data):
        to = data.index(end, at)
        first, *lines = data[at:to].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record where one should start: {first[:40]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = to + 4
        at = start + int(head["content-length"])
        if at + 4 > len(data) or data[at : at + 4] != end:
            raise ValueError("a record isn't as long as it says")
        yield head, data[start:at]
        at += 4


def body(block: bytes) -> bytes:
    """Payload of an HTTP message, with chunked transfer framing decoded."""
    head, _, rest = block.partition(_END.encode())
    if b"transfer-encoding: chunked" not in head.lower():
        return rest
    out, at = [], 0
    while True:
        to = rest.index(b"\r\n", at)
        size = int(rest[at:to].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(rest[to + 2 : to + 2 + size])
        at = to + 2 + size + 2
        if rest[at - 2 : at] != b"\r\n":
            raise ValueError("a transfer chunk isn't as long as it says")


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every archived page."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    names = ["origin", "segment", "total", "page_id", "said", "kind", "refers_to", "n_bytes", "block"]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())

    def page(number: int | None, said: str, kind: str, refers: int | None, block: bytes) -> tuple:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload), the digest verified."""
        said = said.partition(":")[2]
        if kind == "revisit":
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in block.split(b"\r\n"))}
            return (number, int(fields[b"content-length"]), said, kind, refers, None)
        payload = body(block)
        if (got := digest(payload)) != said:
            raise ValueError("a payload doesn't have its digest")
        return (number, len(payload), got, kind, refers, payload)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: None if v is None else int(v)
        for b in batches:
            for content in b.column(0):
                out: list[tuple] = []
                for h, block in parsed(inflated(content.as_py())):
                    origin, segment = h.get("warc-segment-origin-id", h["warc-record-id"]), int(h.get("warc-segment-number", 0))
                    fields = (number(h.get("x-page-id")), h.get("warc-payload-digest"), h["warc-type"], number(h.get("x-refers-to-page-id")))
                    if segment:
                        out.append((origin, segment, number(h.get("warc-segment-total-length")), *fields, None, block))
                    else:
                        _, n, said, _, _, payload = page(*fields, block)
                        out.append((origin, 0, None, fields[0], said, *fields[2:], n, payload if with_payload else None))
                cols = list(zip(*out, strict=True)) or [()] * len(names)
                for at in range(0, max(len(out), 1), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 500], t) for c, t in zip(cols, kinds, strict=True)], names)

    records_ = files.mapInArrow(parse, "origin string, segment int, total long, page_id long, said string, kind string, refers_to long, n_bytes long, block binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = records_.repartition(parts, "origin").sortWithinPartitions("origin", "segment")
    result = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def assembled(rows: list[tuple]) -> Iterator[tuple]:
        """Pages of one origin: equal rows have written the same segments more than once."""
        copies = sum(r[1] == 1 for r in rows)
        if copies == 0 or len(rows) % copies or [r[1] for r in rows] != [k for k in range(1, len(rows) // copies + 1) for _ in range(copies)]:
            raise ValueError(f"segments of {rows[0][0]} are missing")
        block = b"".join(r[8] for r in rows[::copies])
        if rows[-1][2] != len(block):
            raise ValueError(f"the segments of {rows[0][0]} aren't as long as they say")
        for r in rows[:copies]:
            yield page(*r[3:7], block)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())[: len(result)]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(result)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], result)

        have: list[tuple] = []
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(i).to_pylist() for i in range(len(names))), strict=True):
                if row[1] == 0:  # whole by itself, and decoded already
                    _, _, _, number, said, kind, refers, n, payload = row
                    out.append((number, n, said, kind, refers, payload))
                    continue
                if have and have[0][0] != row[0]:
                    out += assembled(have)
                    have = []
                have.append(row)
            yield batch(out)
        if have:
            yield batch(list(assembled(have)))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return dealt.mapInArrow(assemble, schema)
