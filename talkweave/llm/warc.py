"""WARC: a sequential reader of gzip-member records, and a writer for tests and queries.

Each record is one gzip member.  The reader never holds a file: it takes
chunks from a stream, feeds them to an incremental zlib decompressor, and
starts a new one with the unused bytes where a member ends.  Within a member
the header block ends at an empty line, Content-Length frames the block, and
two line ends close the record.  ``WARC-Block-Digest`` and
``WARC-Payload-Digest`` (sha1, sha256, md5; base32 or hex) are verified; the
payload of an HTTP response is what follows its own header.

Cases: a record without digest has ``digest_ok`` null; with an unknown
algorithm likewise.  What can't be read (broken deflate data, a record cut off
at the end of the file, a missing or wrong Content-Length, no WARC line)
gives one row with ``error`` set, and reading resumes at the next gzip member
that can be found (a search for its magic bytes).  Empty members and an empty
file give nothing; a null content none either.  Blocks of any length are read
whole.  Header names are compared without case; of repeated headers the first
counts.  When pages are written: a null html is an empty block, a null url no
``WARC-Target-URI``, and a null page_id no ``WARC-Record-ID`` number.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK = 1 << 16
MAGIC = b"\x1f\x8b\x08"
SCHEMA = "file string, position bigint, record_id string, type string, uri string, date string, content_type string, length bigint, block binary, payload binary, digest_ok boolean, error string"
_FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
_ARROW = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in SCHEMA.split(", ")])


def digest(kind: str, data: bytes) -> str:
    """``sha1:BASE32`` and the like."""
    return f"{kind}:{base64.b32encode(hashlib.new(kind, data).digest()).decode()}"


def digest_holds(claim: str | None, data: bytes) -> bool | None:
    """Whether a digest header is true; None where there is none or the algorithm isn't known."""
    if not claim or ":" not in claim:
        return None
    kind, value = (x.strip() for x in claim.split(":", 1))
    kind = kind.lower().replace("-", "")
    if kind not in ("sha1", "sha256", "md5"):
        return None
    real = hashlib.new(kind, data).digest()
    return value.lower() == real.hex() or value.upper().rstrip("=") == base64.b32encode(real).decode().rstrip("=")


def record(headers: dict[str, str], block: bytes) -> bytes:
    """One gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def response(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A page as a response record with both digests."""
    payload = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n" + payload
    headers = {"WARC-Type": "response", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/http;msgtype=response"}
    if page_id is not None:
        headers["WARC-Record-ID"] = f"<urn:page:{page_id}>"
    if url is not None:
        headers["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    return record(headers | {"WARC-Block-Digest": digest("sha1", block), "WARC-Payload-Digest": digest("sha1", payload)}, block)


class _Member:
    """Takes the decompressed bytes of one member: header block, framed content, end."""

    def __init__(self) -> None:
        self.head, self.block, self.left, self.headers = bytearray(), bytearray(), -1, {}

    def feed(self, data: bytes) -> None:
        if self.left < 0:
            self.head += data
            end = self.head.find(b"\r\n\r\n", max(0, len(self.head) - len(data) - 3))
            if end < 0:
                return
            lines = bytes(self.head[:end]).decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC line")
            name = None
            for line in lines[1:]:
                if line[:1] in " \t" and name:
                    self.headers[name] += " " + line.strip()
                elif ":" in line:
                    name, value = line.split(":", 1)
                    name = name.strip().lower()
                    self.headers.setdefault(name, value.strip())
            size = self.headers.get("content-length", "")
            if not size.isdigit():
                raise ValueError("no Content-Length")
            self.left = int(size)
            data = bytes(self.head[end + 4 :])
        take = data[: self.left]
        self.block += take
        self.left -= len(take)

    def close(self) -> dict:
        if self.left < 0:
            raise ValueError("no end of the header")
        if self.left:
            raise ValueError(f"{self.left} bytes are missing")
        h, block = self.headers, bytes(self.block)
        payload = block
        if h.get("content-type", "").replace(" ", "").startswith("application/http") and b"\r\n\r\n" in block:
            payload = block.split(b"\r\n\r\n", 1)[1]
        held = [x for x in (digest_holds(h.get("warc-block-digest"), block), digest_holds(h.get("warc-payload-digest"), payload)) if x is not None]
        return {"record_id": h.get("warc-record-id"), "type": h.get("warc-type"), "uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "content_type": h.get("content-type"), "length": len(block), "block": block, "payload": payload, "digest_ok": all(held) if held else None}


def read_records(stream: io.RawIOBase | io.BufferedIOBase | pa.NativeFile, chunk: int = CHUNK) -> Iterator[dict]:
    """The records of one file in order, with their position in the compressed file."""
    buffer, base = b"", 0  # bytes not yet taken, and their place in the file

    def more() -> bool:
        nonlocal buffer
        got = stream.read(chunk)
        buffer += got
        return bool(got)

    while buffer or more():
        start, unzip, member, filled = base, zlib.decompressobj(31), _Member(), False
        try:
            while not unzip.eof:
                if not buffer and not more():
                    raise ValueError("the file ends within a record")
                data = unzip.decompress(buffer, 1 << 20)
                base += len(buffer) - len(unzip.unconsumed_tail) - len(unzip.unused_data)
                buffer = unzip.unused_data or unzip.unconsumed_tail
                filled = filled or bool(data)
                member.feed(data)
            if filled:
                yield {"position": start, **member.close()}
        except (zlib.error, ValueError) as e:
            yield {"position": start, "error": str(e)}
            if base == start and buffer:
                buffer, base = buffer[1:], base + 1
            while True:  # to the next member
                at = buffer.find(MAGIC)
                if at >= 0:
                    buffer, base = buffer[at:], base + at
                    break
                drop = max(0, len(buffer) - 2)
                buffer, base = buffer[drop:], base + drop
                if not more():
                    buffer = b""
                    break


def _batches(found: Iterable[dict], file: str | None) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r in found:
        rows.append({"file": file, **r})
        size += 2 * r.get("length", 0)
        if len(rows) >= 1000 or size > 8 << 20:
            yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in _FIELDS} for x in rows], schema=_ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in _FIELDS} for x in rows], schema=_ARROW)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files that match ``path``: one task reads a file from its start to its end, in chunks."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                uri = name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name
                fs, inside = pafs.FileSystem.from_uri(uri)
                with fs.open_input_stream(inside, compression=None) as stream:
                    yield from _batches(read_records(stream), name)

    count = max(1, min(files.count(), 10_000))
    return files.repartition(count).mapInArrow(run, SCHEMA)


def records_of(contents: DataFrame) -> DataFrame:
    """The records of a table of files (file, content), as ``binaryFile`` gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if content.is_valid:
                    yield from _batches(read_records(pa.BufferReader(content.as_buffer())), file)

    return common.own(contents, file="string", content="binary").mapInArrow(run, SCHEMA)


def packed(pages: DataFrame, records: int = 200) -> DataFrame:
    """(file, content): pages written as WARC files of ``records`` records, one after the other within each partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, records):
                rows = batch.slice(lo, records).to_pydict()
                content = b"".join(response(*r) for r in zip(rows["page_id"], rows["url"], rows["html"]))
                name = f"pages-{rows['page_id'][0]}.warc.gz"
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["file", "content"])

    return common.own(pages, page_id="bigint", url="string", html="string").mapInArrow(run, "file string, content binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC files and back: page, url, payload, its length and whether the digests hold."""
    got = records_of(packed(common.table(spark, sf_dir, "pages")))
    return got.select(
        F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1).cast("bigint").alias("page_id"), F.col("uri").alias("url"),
        F.col("payload").cast("string").alias("html"), F.length("payload").cast("bigint").alias("n_bytes"), F.md5("payload").alias("payload_md5"), "type", "digest_ok", "error",
    )


OP4_SQL = """SELECT page_id, url, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, md5(coalesce(html, '')) AS payload_md5,
  'response' AS type, true AS digest_ok, CAST(NULL AS VARCHAR) AS error FROM pages"""
