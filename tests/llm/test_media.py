"""WARC and Ogg readers against whole-file parsing, and on damaged input."""

from __future__ import annotations

import gzip
import io
import random

from pyspark.sql import functions as F

from talkweave.llm import ogg, warc


def sample(n=7):
    r = random.Random(5)
    return [(i, f"http://h/{i}", "".join(r.choice("abc <>\r\n") for _ in range(r.randrange(0, 5000)))) for i in range(n)]


def test_records_by_any_chunk():
    pages = sample()
    data = b"".join(warc.response(*p) for p in pages)
    whole = gzip.decompress(data)
    for chunk in (1, 13, 1 << 16):
        got = list(warc.read_records(io.BytesIO(data), chunk))
        assert [x["payload"].decode() for x in got] == [p[2] for p in pages]
        assert all(x["digest_ok"] for x in got) and got[0]["position"] == 0
        for x in got:
            assert data[x["position"] : x["position"] + 3] == warc.MAGIC and x["block"] in whole


def test_damage_costs_one_record():
    parts = [warc.response(*p) for p in sample(5)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    got = list(warc.read_records(io.BytesIO(parts[0] + parts[1] + bytes(broken) + parts[3] + parts[4])))
    assert [x["record_id"] for x in got if "error" not in x][-2:] == ["<urn:page:3>", "<urn:page:4>"]
    assert any("error" in x for x in got)
    cut = list(warc.read_records(io.BytesIO(parts[0] + parts[1][:-20])))
    assert "error" not in cut[0] and "error" in cut[1]
    junk = list(warc.read_records(io.BytesIO(b"not gzip at all" + parts[0])))
    assert "error" in junk[0] and junk[-1]["record_id"] == "<urn:page:0>"


def test_digests():
    assert warc.digest_holds(warc.digest("sha1", b"x"), b"x") and not warc.digest_holds(warc.digest("sha1", b"x"), b"y")
    assert warc.digest_holds("SHA-256:2D711642B726B04401627CA9FBAC32F5C8530FB1903CC4DB02258717921A4881", b"x")
    assert warc.digest_holds(None, b"x") is None and warc.digest_holds("crc:1", b"x") is None
    bad = warc.record({"WARC-Type": "resource", "WARC-Block-Digest": warc.digest("sha1", b"other")}, b"body")
    plain = warc.record({"WARC-Type": "resource"}, b"body")
    a, b = warc.read_records(io.BytesIO(bad + plain))
    assert a["digest_ok"] is False and b["digest_ok"] is None and b["payload"] == b"body"
    short = gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nbody")
    (x,) = warc.read_records(io.BytesIO(short))
    assert "missing" in x["error"]


def test_warc_files(spark, tmp_path):
    pages = sample(9)
    for k in range(3):
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(warc.response(*p) for p in pages[3 * k : 3 * k + 3]))
    got = warc.read_warc(spark, f"file://{tmp_path}").select("record_id", F.col("payload").cast("string").alias("p"), "digest_ok").collect()
    assert sorted((r.record_id, r.p) for r in got) == sorted((f"<urn:page:{i}>", t) for i, _, t in pages)


def streams(r, n=3):
    return [(7 + k, [(0, b"PCMraw\0\0" + (8000).to_bytes(4, "little")), *((100 * (i + 1), r.randbytes(r.choice([0, 1, 254, 255, 256, 510, 9000, 70000]))) for i in range(12))]) for k in range(n)]


def test_ogg_round_trip():
    for seed in range(6):
        want = streams(random.Random(seed))
        for segments in (1, 7, 255):
            found, skipped = ogg.demultiplex(ogg.multiplex(want, segments))
            assert skipped == 0 and len(found) == 3
            for s in found:
                packets = dict(want)[s.serial]
                assert [p for _, p in s.packets] == [p for _, p in packets]
                assert s.ended and s.bad == s.lost == 0 and s.seconds(s.granule) == 1200 / 8000


def test_ogg_damage():
    want = streams(random.Random(3), 1)
    data = ogg.multiplex(want, 16)
    pages = [p for p in ogg.pages_of(data)]
    assert all(p.good for p in pages)
    at = data.index(ogg.CAPTURE, len(data) // 2) + 60
    hurt = bytearray(data)
    hurt[at] ^= 1
    (s,), skipped = ogg.demultiplex(bytes(hurt))
    assert s.bad == 1 and skipped == 0 and len(s.packets) < len(want[0][1])
    assert {p for _, p in s.packets} <= {p for _, p in want[0][1]}  # what is left is right
    (s,), skipped = ogg.demultiplex(b"xx" + data[:-10])
    assert skipped > 2 and not s.ended
    first = data.index(ogg.CAPTURE, 60)
    second = data.index(ogg.CAPTURE, first + 4)
    (s,), _ = ogg.demultiplex(data[:first] + data[second:])  # a page is gone
    assert {p for _, p in s.packets} <= {p for _, p in want[0][1]}


def crc_by_bits(page):
    crc = 0
    for b in page:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for x in (b"", b"OggS", bytes(range(256)), random.Random(1).randbytes(1000)):
        assert ogg.checksum(x) == crc_by_bits(x)


def test_codecs():
    assert ogg.codec_of(b"OpusHead\x01\x02" + (312).to_bytes(2, "little") + b"\0" * 7) == ("opus", 48000, 312)
    assert ogg.codec_of(b"\x01vorbis" + b"\0\0\0\0\x02" + (44100).to_bytes(4, "little") + b"\0" * 14) == ("vorbis", 44100, 0)
    assert ogg.codec_of(b"?") == ("unknown", 0, 0)


def test_packet_positions():
    """Positions that only the page's end tells are derived backwards from the packets' lengths."""
    sizes = [3, 700, 20, 255, 0, 9, 4000]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    (s,), _ = ogg.demultiplex(ogg.multiplex([(4, [(0, b"PCMraw\0\0" + (100).to_bytes(4, "little")), *((e, bytes(n)) for e, n in zip(ends, sizes))])], 255))
    assert [g for g, _ in s.packets[1:]] == ends and [s.seconds(g) for g in ends] == [e / 100 for e in ends]
    head = b"OpusHead\x01\x02" + (312).to_bytes(2, "little") + b"\0" * 7
    frames = [bytes([config << 3 | code, count]) for config, code, count in ((31, 0, 0), (3, 1, 0), (12, 3, 5), (16, 2, 0))]  # 20 ms, two of 60, five of 10, two of 2.5
    lengths = [960, 5760, 2400, 240]
    (s,), _ = ogg.demultiplex(ogg.multiplex([(1, [(0, head), *((1000 + sum(lengths[: i + 1]), f) for i, f in enumerate(frames))])], 255))
    assert [g for g, _ in s.packets[1:]] == [1000 + sum(lengths[: i + 1]) for i in range(4)]
    (s,), _ = ogg.demultiplex(ogg.multiplex([(1, [(0, b"?"), (5, b"a"), (9, b"b")])], 255))
    assert [g for g, _ in s.packets] == [0, -1, 9]


def test_chained_streams():
    """A serial number that begins again is another stream."""
    one, two = streams(random.Random(1), 1), streams(random.Random(2), 1)
    found, skipped = ogg.demultiplex(ogg.multiplex(one) + ogg.multiplex(two))
    assert skipped == 0 and [(s.serial, s.link, s.lost) for s in found] == [(7, 0, 0), (7, 1, 0)]
    assert [[p for _, p in s.packets] for s in found] == [[p for _, p in x[0][1]] for x in (one, two)]


def test_lost_packets():
    """Each break across which a packet goes on counts once, whatever was damaged before."""
    packets = [(0, b"PCMraw\0\0" + (100).to_bytes(4, "little")), *((i, bytes([i]) * 700) for i in range(1, 7))]
    data = ogg.multiplex([(1, packets)], 2)  # a packet of 700 bytes has three lacing values: pages end within packets
    cuts = [i for i in range(len(data)) if data[i : i + 4] == ogg.CAPTURE] + [len(data)]
    pages = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    for gone in ([2], [3], [2, 3], [2, 6], [4, 7], [1, 3, 5]):
        hurt = b"".join(p if i not in gone else p[:-1] + bytes([p[-1] ^ 1]) for i, p in enumerate(pages))
        for kept in (hurt, b"".join(p for i, p in enumerate(pages) if i not in gone)):
            (s,), _ = ogg.demultiplex(kept)
            ends = [[i for i in range(1, len(pages)) if 2 * (i - 1) <= 3 * k + 2 and 2 * i > 3 * k] for k in range(6)]  # pages of each packet
            runs = [g for g in gone if g - 1 not in gone]
            across = sum(any(g in e and (set(e) - set(gone)) for g in range(r, max(x for x in gone if set(range(r, x + 1)) <= set(gone)) + 1) for e in ends) for r in runs)
            assert [p for _, p in s.packets[1:]] == [p for (_, p), e in zip(packets[1:], ends) if not set(e) & set(gone)]
            assert s.lost == across


def test_packets_of(spark):
    docs = spark.createDataFrame([(1, "x" * 2000, "here"), (2, None, None)], "doc_id bigint, text string, source string")
    got = sorted(tuple(r) for r in ogg.packets_of(ogg.recorded(docs)).select("media_id", "serial", "packet", "granule", "seconds", F.length("content")).collect())
    assert got == [
        (1, 1, 0, 0, 0.0, 12), (1, 1, 1, 960, 0.06, 960), (1, 1, 2, 1920, 0.12, 960), (1, 1, 3, 2000, 0.125, 80), (1, 2, 0, 0, None, 8), (1, 2, 1, 0, None, 4),
        (2, 1, 0, 0, 0.0, 12), (2, 2, 0, 0, None, 8), (2, 2, 1, 0, None, 0),
    ]
