"""Literal cases and properties of the operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from talkweave.functions import arrays, ids, nested, signal, timebase
from talkweave.operators import catalog, frames, intervals
from talkweave.operators import overlap as ov
from talkweave.sources import audio, sinks, text
from talkweave.streaming import activity as streaming


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def spans(spark, *pairs, key="k"):
    return spark.createDataFrame([(key, a, b) for a, b in pairs], "k string, start bigint, end bigint")


def points(df):
    return {(r.k, p) for r in df.collect() for p in range(r.start, r.end)}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalise(spark):
    assert rows(intervals.normalise(spans(spark, (0, 1), (1, 3), (3, 10)), ["k"])) == [("k", 0, 10)]
    assert rows(intervals.normalise(spans(spark, (5, 5), (9, 2), (None, 3), (1, None)), ["k"])) == []
    chain = intervals.union(["k"], *(spans(spark, p) for p in [(10, 15), (5, 10), (1, 4), (15, 20), (21, 25)]))
    assert intervals.encode(chain, ["k"]).first().intervals == "1:4, 5:20, 21:25"


def test_assign_and_runs(spark):
    flags = spark.createDataFrame([("k", [True, False, True])], "k string, flags array<boolean>")
    got = intervals.assign(spans(spark, (0, 50)), flags, ["k"], 3, 6)
    assert intervals.encode(got, ["k"]).first().intervals == "0:4, 5:50"
    runs = spark.createDataFrame([("k", [bool(x) for x in (1, 1, 0, 1, 0, 0, 1, 1, 0)])], "k string, f array<boolean>")
    assert intervals.encode(intervals.from_flags(runs, ["k"], "f"), ["k"]).first().intervals == "0:2, 3:4, 6:8"
    with pytest.raises(PySparkException):
        intervals.assign(spans(spark, (0, 50)), flags, ["k"], 3, 7).collect()


def test_codec(spark):
    got = spark.createDataFrame([("a", "1:4, 5:20"), ("b", ""), ("c", None)], "k string, intervals string")
    assert rows(intervals.decode(got, ["k"])) == [("a", 1, 4), ("a", 5, 20)]
    with pytest.raises(PySparkException):
        intervals.decode(spark.createDataFrame([("a", "1-4")], "k string, intervals string"), ["k"]).collect()


def test_clear_cuts_shared_borders(spark):
    got = intervals.clear(spans(spark, (3, 6), (0, 6), (3, 8)), 3, 6)
    assert rows(got) == [("k", 0, 3), ("k", 6, 8)]


@pytest.mark.parametrize("width", [None, 7, 10])
def test_set_algebra(spark, width):
    r = random.Random(width)
    a, b = (spark.createDataFrame([(k, s, s + r.randrange(-1, 12)) for k in "xy" for s in (r.randrange(0, 90) for _ in range(12))], "k string, start bigint, end bigint") for _ in range(2))
    pa, pb = points(a), points(b)
    for got, want in (
        (intervals.union(["k"], a, b, width=width), pa | pb), (intervals.intersect(a, b, ["k"], width), pa & pb),
        (intervals.subtract(a, b, ["k"], width), pa - pb), (intervals.normalise(a, ["k"], width=width), pa),
    ):
        assert points(got) == want
        assert rows(got) == rows(intervals.normalise(got, ["k"]))  # sorted, disjoint, not touching
    counted = intervals.concurrency(a, ["k"], width).collect()
    depth = {}
    for x in a.collect():
        for p in range(x.start, x.end):
            depth[x.k, p] = depth.get((x.k, p), 0) + 1
    assert {(x.k, p): x.n for x in counted for p in range(x.start, x.end)} == depth
    assert sorted(map(tuple, counted)) == rows(intervals.concurrency(a, ["k"]))


def test_window_rules():
    assert intervals.window(50, None, None) == (0, 50) and intervals.window(None, 3, 6) == (3, 6)
    for bad in ((50, 0, 51), (50, -1, 5), (None, 0, None)):
        with pytest.raises(ValueError):
            intervals.window(*bad)
    with pytest.raises(ValueError):
        intervals.window(50, 0, 10, 2)


def test_overlap_join(spark):
    r = random.Random(2)
    data = [("s", r.randrange(4), s, s + r.randrange(0, 30), i) for i, s in enumerate(r.randrange(0, 300) for _ in range(60))]
    df = spark.createDataFrame(data, "session string, speaker int, start bigint, end bigint, utt int")
    for width in (5, 20, 1000):
        got = {(x.utt, x.utt_r) for x in ov.cross_talk(df, width).collect()}
        assert got == {(a[4], b[4]) for a in data for b in data if a[1] < b[1] and a[2] <= b[3] and a[3] >= b[2]}


def test_frames(spark):
    df = spans(spark, (5, 7), (8, 9))
    assert [r[1] for r in rows(frames.active_frames(df, ["k"], 4, 2, fading=True))] == [2, 3, 4, 5]
    assert [r[1] for r in rows(frames.active_frames(df, ["k"], 4, 2))] == [1, 2, 3, 4]
    back = spark.createDataFrame([("k", 1), ("k", 3), ("k", 6)], "k string, frame bigint")
    assert rows(frames.frames_to_samples(back, ["k"], 4, 2)) == [("k", 2, 10), ("k", 12, 16)]


def test_times(spark):
    assert one(spark, timebase.to_samples(F.lit("0:47:52.708375"))) == 45963334
    assert one(spark, timebase.to_samples(F.lit("0:01:04.62"))) == 1033920
    with pytest.raises(PySparkException):
        one(spark, timebase.to_samples(F.lit("0:00:00.00001")))
    for pair, want in (((10, 19), (10, 20)), ((10, 21), (10, 20)), ((10, 20), (10, 20))):
        got = spark.range(1).select(*timebase.adjusted(F.lit(pair[0]), F.lit(pair[1]), F.lit(10))).first()
        assert got[1] - got[0] == 10 and tuple(got) == want


def test_ids(spark):
    args = F.lit("P09"), F.lit("S03"), F.lit(45963520), F.lit(45987360)
    assert one(spark, ids.example_id(*args)) == "P09_S03_0287272-0287421"
    assert "1234567890" in one(spark, ids.zero_filled(F.lit(1234567890), 9))  # never cut


def test_arrays(spark):
    x = F.array(*(F.lit(float(i)) for i in range(10)))
    assert one(spark, arrays.roll_zeropad(x, 2)) == [0, 0, 0, 1, 2, 3, 4, 5, 6, 7]
    assert one(spark, arrays.roll_zeropad(x, -12)) == [0] * 10
    assert one(spark, arrays.segments(x, 4, 3, "pad")) == [[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9]]
    assert one(spark, arrays.segments(x, 4, 4, "pad"))[-1] == [8, 9, 0, 0]
    assert one(spark, arrays.segments(x, 4, 4, "cut"))[-1] == [4, 5, 6, 7]
    with pytest.raises(ValueError):
        arrays.segments(x, 4, 0)


def test_nested(spark):
    got = spark.createDataFrame([(1, '{"a": {"b": 1, "c": [2, 3]}, "d": null}')], "id int, j string")
    paths = {str(tuple(r)[1:]) for r in nested.flatten_tree(got, ["id"], "j").collect()}
    assert len(paths) == 3


def test_catalog_gates(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    assert catalog.merge(df, df).count() == 2
    with pytest.raises(PySparkException):
        catalog.merge(df, spark.createDataFrame([("a", 5)], "key string, value int")).collect()
    with pytest.raises(PySparkException):
        catalog.disjoint_union(df, df, key="key").collect()
    with pytest.raises(ValueError):
        catalog.shard(df, ["key"], 3, 2)
    assert catalog.shard(df, ["key"], 2, 2).first().key == "b"


def test_wer_line(spark):
    line = spark.createDataFrame([("%WER 72.78 [ 42853 / 58881, 2518 ins, 22449 del, 17886 sub ] file",), ("other",)], "line string")
    assert rows(text.wer(line)) == [(72.78, 42853, 58881, 2518, 22449, 17886)]


def test_rttm(spark):
    line = spark.createDataFrame([("SPEAKER S09 1 65.58 1.75 <NA> <NA> P25 <NA> <NA>",)], "value string")
    assert rows(text.rttm(line)) == [("S09", "P25", 1049280, 1077280)]
    with pytest.raises(PySparkException):
        text.rttm(spark.createDataFrame([("LEXEME S09 1 1 1 a b c d",)], "value string")).collect()


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.dump_database(spark.createDataFrame([("d", 1)], "dataset string, x int"), str(tmp_path / "x"))
    bad = spark.createDataFrame([("u", 2000.0)], "key string, value double")
    with pytest.raises(PySparkException):
        sinks.keyed_lines(bad, "utt2dur").collect()
    gender = spark.createDataFrame([("b", "Male"), ("a", "f")], "key string, value string")
    assert [r.line for r in sinks.keyed_lines(gender, "spk2gender").collect()] == ["a f", "b m"]


def test_audio(spark):
    x = np.random.default_rng(0).uniform(-0.9, 0.9, (2, 333))
    for kind, tolerance in (("int16", 1e-4), ("int32", 1e-9), ("float32", 1e-6), ("float64", 0)):
        data = audio.write(x, 8000, kind)
        h = audio.header(data)
        assert (h.channels, h.rate, h.samples) == (2, 8000, 333)
        assert np.abs(audio.read(data) - x).max() <= tolerance
        assert np.abs(audio.read(data, 10, 20) - x[:, 10:20]).max() <= tolerance
    assert audio.read(data, 300, 400).shape == (2, 33) and audio.read(data, 300, 400, fill=0.0).shape == (2, 100)
    assert np.abs(audio.read(audio.write(x * 0.1, normalise=True))).max() == pytest.approx((2**15 - 1) / 2**15, abs=1e-4)
    with pytest.raises(ValueError):
        audio.header(b"no wav")


def test_signal():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 5000))
    assert np.allclose(signal.istft(signal.stft(x), samples=5000), x, atol=1e-8)
    a, b = rng.normal(size=(5, 4, 4)), rng.normal(size=(5, 4, 2))
    assert np.allclose(signal.stable_solve(a, b), np.linalg.solve(a, b))
    a[2] = 0
    got = signal.stable_solve(a, b)
    assert np.isfinite(got).all() and np.allclose(got[3], np.linalg.solve(a[3], b[3]))


def test_streaming(spark, tmp_path):
    events = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:02d}") for s in (0, 2, 4, 40)], "speaker string, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = streaming.talk_sessions(stream, "10 seconds", "1 minute", ["speaker"]).writeStream.format("memory").queryName("talks").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("talks").count() == 2
