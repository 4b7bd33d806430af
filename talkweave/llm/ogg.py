"""Media columns: Ogg demultiplexing.

``pages_of`` walks a container page by page and verifies each page's checksum
(CRC-32, polynomial 0x04C11DB7, not reflected: zlib's CRC of the bit-reversed
bytes, reversed again).  Lacing values cut a page's body into packets; a value
of 255 goes on, also over the page's end into the next page of the same
logical stream.  Pages of several streams may be interleaved.  The granule
position of a page belongs to the last packet that ends on it; those of the
packets before it on the page follow backwards from the packets' own lengths
(Opus: its first bytes tell the frames, ``PCMraw``: a byte a sample; otherwise
unknown).  Timestamps divide positions by the stream's rate, which its first
packet tells (``OpusHead``: 48000 with pre-skip, Vorbis: its sample rate,
``PCMraw``: this module's own raw streams; otherwise unknown).  A page that
begins a stream whose serial number is in use already begins another stream, a
link of a chain (``link`` counts them).

Cases: bytes that are no page are skipped to the next capture pattern and
counted (``n_skipped``); a page whose checksum fails counts as damaged
(``n_bad_pages``) and its packets are lost, also one that it would have
continued; a gap in page numbers likewise breaks a packet that spans it.
``n_lost`` counts each break across which a packet was going on, before or
after it, once, and a packet that never ends or lacks its beginning.  An
empty content has no stream, so no row; a null content neither.  Any length is
read whole.  A stream whose granule positions are all -1 has null duration.
Repeated rows give repeated results, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

CAPTURE = b"OggS"
HEAD = struct.Struct("<4sBBqIIIB")
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


def checksum(page: bytes) -> int:
    """The page's CRC, its own field taken as zero by the caller."""
    crc = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REVERSED), "big")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes
    good: bool


def pages_of(data: bytes) -> Iterator[Page | int]:
    """Pages in order; a number stands for so many skipped bytes."""
    at, size = 0, len(data)
    while at < size:
        if data[at : at + 4] != CAPTURE or size - at < 27:
            nxt = data.find(CAPTURE, at + 1)
            nxt = size if nxt < 0 else nxt
            yield nxt - at
            at = nxt
            continue
        _, version, flags, granule, serial, number, crc, segments = HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        if version or len(lacing) < segments or end > size:
            nxt = data.find(CAPTURE, at + 1)
            nxt = size if nxt < 0 else nxt
            yield nxt - at
            at = nxt
            continue
        good = checksum(b"".join((data[at : at + 22], b"\0\0\0\0", data[at + 26 : end]))) == crc
        yield Page(flags, granule, serial, number, lacing, data[at + 27 + segments : end], good)
        at = end


def codec_of(packet: bytes) -> tuple[str, int, int]:
    """Codec, ticks a second and ticks to leave out at the start, from a stream's first packet."""
    if packet[:8] == b"OpusHead" and len(packet) >= 19:
        return "opus", 48000, struct.unpack_from("<H", packet, 10)[0]
    if packet[:7] == b"\x01vorbis" and len(packet) >= 30:
        return "vorbis", struct.unpack_from("<I", packet, 12)[0], 0
    if packet[:8] == b"PCMraw\0\0" and len(packet) >= 12:
        return "pcm", struct.unpack_from("<I", packet, 8)[0], 0
    return "unknown", 0, 0


@dataclass
class Stream:
    """What is known of one logical stream so far."""

    serial: int
    link: int = 0
    codec: str = ""
    rate: int = 0
    skip: int = 0
    pages: int = 0
    bad: int = 0
    lost: int = 0
    number: int = -1
    ended: bool = False
    granule: int = -1
    part: bytearray | None = None
    told: bool = False  # the break before this page is counted
    packets: list[tuple[int, bytes]] = field(default_factory=list)  # granule position (-1: not known), bytes

    def broken(self) -> None:
        if self.part is not None:
            self.lost, self.told, self.part = self.lost + 1, True, None

    def take(self, page: Page) -> None:
        if not page.good:
            self.bad += 1
            self.broken()
            return
        self.pages += 1
        going = bool(page.flags & CONTINUED)
        if not going or self.number >= 0 and page.number != self.number + 1:
            self.broken()
        self.number = page.number
        skip = going and self.part is None
        self.lost += skip and not self.told
        self.told = False
        at, part, first = 0, self.part if self.part is not None else bytearray(), len(self.packets)
        self.part = None
        for value in page.lacing:
            part += page.body[at : at + value]
            at += value
            if value < 255:
                if not skip:
                    self.packets.append((-1, bytes(part)))
                skip, part = False, bytearray()
        if page.lacing and page.lacing[-1] == 255:
            if skip:
                self.told = True
            else:
                self.part = part
        if page.granule >= 0 and len(self.packets) > first:
            self.packets[-1] = (page.granule, self.packets[-1][1])
            self.granule = page.granule
        if page.flags & LAST:
            self.ended = True

    def close(self) -> None:
        self.lost += self.part is not None
        if self.packets:
            self.codec, self.rate, self.skip = codec_of(self.packets[0][1])
        for k in range(len(self.packets) - 1, 0, -1):
            position, packet = self.packets[k]
            own = ticks(self.codec, packet)
            if position >= 0 and own is not None and self.packets[k - 1][0] < 0:
                self.packets[k - 1] = (max(0, position - own), self.packets[k - 1][1])

    def seconds(self, granule: int) -> float | None:
        return None if granule < 0 or not self.rate else max(0, granule - self.skip) / self.rate


def ticks(codec: str, packet: bytes) -> int | None:
    """How far a packet takes the granule position; None if that isn't known."""
    if codec == "pcm":
        return len(packet)
    if codec != "opus" or not packet:
        return None
    config, code = packet[0] >> 3, packet[0] & 3
    frame = (480, 960, 1920, 2880)[config & 3] if config < 12 else (480, 960)[config & 1] if config < 16 else (120, 240, 480, 960)[config & 3]
    if code == 3:
        return frame * (packet[1] & 63) if len(packet) > 1 else None
    return frame * (1 if code == 0 else 2)


def demultiplex(data: bytes) -> tuple[list[Stream], int]:
    """The logical streams in order of their first page, and how many bytes were skipped."""
    now: dict[int, Stream] = {}
    streams: list[Stream] = []
    skipped = 0
    for page in pages_of(data):
        if isinstance(page, int):
            skipped += page
            continue
        had = now.get(page.serial)
        if had is None or page.good and page.flags & FIRST and had.pages:
            had = now[page.serial] = Stream(page.serial, link=had.link + 1 if had else 0)
            streams.append(had)
        had.take(page)
    for s in streams:
        s.close()
    return streams, skipped


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing))
    whole = head + lacing + body
    return b"".join((whole[:22], struct.pack("<I", checksum(whole)), whole[26:]))


def multiplex(streams: list[tuple[int, list[tuple[int, bytes]]]], segments: int = 64) -> bytes:
    """Writes (serial, [(granule, packet)]) streams with pages of up to ``segments`` lacing values, pages interleaved."""
    queues = []
    for serial, packets in streams:
        values: list[tuple[int, bytes, int]] = []  # lacing value, its bytes, granule at a packet's end or -1
        for granule, packet in packets:
            for at in range(0, len(packet) + 1, 255):
                piece = packet[at : at + 255]
                values.append((len(piece), piece, granule if len(piece) < 255 else -1))
                if len(piece) < 255:
                    break
        first = len(packets[0][1]) // 255 + 1 if packets else 0  # the first packet has a page of its own
        cuts = [values[:first], *(values[i : i + segments] for i in range(first, len(values), segments))] if values else [[]]
        out, going = [], False
        for k, part in enumerate(cuts):
            ends = [g for n, _, g in part if n < 255]
            flags = (CONTINUED if going else 0) | (FIRST if k == 0 else 0) | (LAST if k == len(cuts) - 1 else 0)
            out.append(page(serial, k, flags, ends[-1] if ends else -1, bytes(n for n, _, _ in part), b"".join(b for _, b, _ in part)))
            going = bool(part) and part[-1][0] == 255
        queues.append(out)
    order = sorted((i / max(len(q), 1), k, i) for k, q in enumerate(queues) for i in range(len(q)))
    return b"".join(queues[k][i] for _, k, i in order)


SCHEMA = "media_id bigint, serial bigint, link int, codec string, n_pages int, n_bad_pages int, n_packets int, n_lost int, n_bytes bigint, seconds double, first_seconds double, sum_granules bigint, payload_md5 string, ended boolean, n_skipped bigint"


def streams_of(media: DataFrame) -> DataFrame:
    """One row a logical stream of each container (media_id, content); all but ``codec`` leaves out the first packet.

    ``seconds`` is the stream's end, ``first_seconds`` that of its first packet and ``sum_granules`` the sum of the
    positions of all packets whose position is known; ``packets_of`` has each of them.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not content.is_valid:
                    continue
                found, skipped = demultiplex(content.as_buffer().to_pybytes())
                for s in found:
                    body = [p for _, p in s.packets[1:]]
                    md5 = hashlib.md5()
                    for p in body:
                        md5.update(p)
                    at = [g for g, _ in s.packets[1:]]
                    rows.append((key, s.serial, s.link, s.codec, s.pages, s.bad, len(body), s.lost, sum(map(len, body)), s.seconds(s.granule), s.seconds(at[0]) if at else None, sum(g for g in at if g >= 0), md5.hexdigest(), s.ended, skipped))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=schema)

    return common.own(media, media_id="bigint", content="binary").mapInArrow(run, SCHEMA)


def packets_of(media: DataFrame) -> DataFrame:
    """(media_id, serial, link, packet, granule, seconds, content): one row a packet, the first (number 0) included; what isn't known is null."""
    schema = pa.schema([("media_id", pa.int64()), ("serial", pa.int64()), ("link", pa.int32()), ("packet", pa.int32()), ("granule", pa.int64()), ("seconds", pa.float64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if content.is_valid:
                    rows = [(key, s.serial, s.link, k, g if g >= 0 else None, s.seconds(g), p) for s in demultiplex(content.as_buffer().to_pybytes())[0] for k, (g, p) in enumerate(s.packets)]
                    yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema=schema)

    return common.own(media, media_id="bigint", content="binary").mapInArrow(run, "media_id bigint, serial bigint, link int, packet int, granule bigint, seconds double, content binary")


RATE, FRAME = 16000, 960


def recorded(docs: DataFrame) -> DataFrame:
    """(media_id, content): every document as a container of two streams.

    Stream 1 is raw 8-bit audio at 16 kHz whose samples are the text's bytes, in packets of 960; stream 2 holds
    the source's name as one packet. A null text or source is an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                frames = [(min(at + FRAME, len(data)), data[at : at + FRAME]) for at in range(0, len(data), FRAME)]
                out.append(multiplex([(1, [(0, b"PCMraw\0\0" + struct.pack("<I", RATE)), *frames]), (2, [(0, b"source\0\0"), (0, (source or "").encode())])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["media_id", "content"])

    return common.own(docs, doc_id="bigint", text="string", source="string").mapInArrow(run, "media_id bigint, content binary")


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a two-stream Ogg container, demultiplexed again."""
    return streams_of(recorded(common.table(spark, sf_dir, "documents")))


OP5_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS s, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
laced AS (SELECT *, (n // {FRAME}) * 4 + CASE WHEN n % {FRAME} > 0 THEN (n % {FRAME}) // 255 + 1 ELSE 0 END AS v FROM d)
SELECT doc_id AS media_id, CAST(1 AS BIGINT) AS serial, 0 AS link, 'pcm' AS codec, CAST(1 + (v + 63) // 64 AS INT) AS n_pages, 0 AS n_bad_pages,
  CAST((n + {FRAME - 1}) // {FRAME} AS INT) AS n_packets, 0 AS n_lost, n AS n_bytes, n / {float(RATE)}::DOUBLE AS seconds, CASE WHEN n > 0 THEN least(n, {FRAME}) / {float(RATE)}::DOUBLE END AS first_seconds,
  CAST({FRAME} * (((n + {FRAME - 1}) // {FRAME} - 1) * ((n + {FRAME - 1}) // {FRAME})) // 2 + n AS BIGINT) AS sum_granules, md5(t) AS payload_md5, true AS ended, CAST(0 AS BIGINT) AS n_skipped FROM laced
UNION ALL SELECT doc_id, 2, 0, 'unknown', 2, 0, 1, 0, octet_length(encode(s)), NULL, NULL, 0, md5(s), true, 0 FROM d"""
