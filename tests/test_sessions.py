"""Session chains from files on, and what must raise."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.functions import signal
from talkweave.operators import catalog, enhance, sessions
from talkweave.sources import audio, text

MAP = "map<string,bigint>"


def raises(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


def time(ms):
    return f"0:{ms // 60000:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def test_places_dont_depend_on_the_files(spark, tmp_path):
    """Sessions of three rows, small and large, in one folder or several, by one task or many: places count from 0 in every file."""
    for k, size in enumerate((1, 40_000)):
        folder = tmp_path / str(k)
        for s in range(4):
            (folder / "sub").mkdir(parents=True, exist_ok=True)
            rows = [{"start_time": time(1000 * i), "end_time": time(1000 * i + 500), "words": f"w{i} " * (size if s % 2 else 1), "speaker": "P01", "session_id": f"S{s:02d}"} for i in range(3)]
            (folder / ("sub" if s > 1 else "") / f"S{s:02d}.json").write_text(json.dumps(rows))
    got = [text.transcripts(spark, str(tmp_path / k), multi=False) for k in ("0", "1")]
    for df in got:
        assert sorted((r.session_id, r.pos, r.start_time) for r in df.collect()) == [(f"S{s:02d}", i, 16000 * i) for s in range(4) for i in range(3)]
    names = {"start_time": "start", "end_time": "end"}
    rows = text.examples(*(df.select("session_id", "pos", "speaker", "words", "start_time", "end_time").withColumnsRenamed(names) for df in got), least=3)
    assert rows.count() == 12
    (tmp_path / "bad.json").write_text('[{"start_time": {"a": 1}, "words": ]')
    raises(text.transcripts(spark, str(tmp_path / "bad.json"), multi=False), "MALFORMED|FAILFAST|Malformed")


def test_word_ids_after_a_shuffle(spark):
    rows = spark.createDataFrame([(i, f"a b{i % 7}  c" if i % 5 else "") for i in range(200)], "k int, t string").repartition(7)
    symbols = spark.createDataFrame([("a", 1), ("c", 3), *((f"b{i}", 10 + i) for i in range(6))], "word string, id bigint")
    got = {r.k: r.t_ids for r in text.word_ids(rows, "t", symbols, oov=99).collect()}
    assert got == {i: [1, 10 + i % 7 if i % 7 < 6 else 99, 3] if i % 5 else [] for i in range(200)}


def one_session(spark, turns=4):
    """Transcripts, dimensions and files of a session with two arrays and two speakers."""
    clock = lambda s: {"original": s, "U01": s + 100, "U02": s + 300, "P01": s + 50, "P02": s + 70}
    rows = [("S01", i, "P01" if i % 2 else "P02", f"word{i}", clock(4000 * i + 2000), clock(4000 * i + 5000 + 40 * i), None, "U02") for i in range(turns)]
    first = spark.createDataFrame(rows, f"session_id string, pos int, speaker string, words string, start_time {MAP}, end_time {MAP}, location string, ref string")
    arrays = spark.createDataFrame([("S01", "U01", True), ("S01", "U02", True)], "session_id string, array string, present boolean")
    speakers = spark.createDataFrame([("S01", "P01"), ("S01", "P02")], "session_id string, speaker_id string")
    files = spark.createDataFrame([("S01", u, [f"{u}.wav"]) for u in ("U01", "U02", "P01", "P02")], "session_id string, unit string, files array<string>")
    return first, arrays, speakers, files


def test_example_rows_that_raise(spark):
    first, arrays, speakers, files = one_session(spark)
    good = sessions.examples(first, first, arrays, speakers, files)
    assert good.count() == 4
    raises(sessions.examples(first, first.where("pos < 3"), arrays, speakers, files), "differ in length")
    least = spark.createDataFrame([("S01", 5)], "session_id string, least int")
    raises(sessions.examples(first, first, arrays, speakers, files, least=least), "too few rows")
    more = spark.createDataFrame([("S01", "U03", True)], arrays.schema)
    raises(sessions.examples(first, first, arrays.union(more), speakers, files.union(spark.createDataFrame([("S01", "U03", ["x"])], files.schema))), "no time of U03")
    without = sessions.examples(first, first, arrays.union(more), speakers, files).first()
    assert without.notes == ["Array U03 is missing, this may be expected"] and set(without.start.observation) == {"U01", "U02"}
    unworn = sessions.examples(first, first, arrays, speakers, files, worn=False).first()
    assert unworn.start.worn == {} and unworn.start.original is not None


def test_activity_that_raises(spark):
    first, arrays, speakers, files = one_session(spark)
    rows = sessions.examples(first, first, arrays, speakers, files)
    of = sessions.perspectives("global_worn", rows)
    lengths = spark.createDataFrame([("S01", m, 50_000) for m in ("U01", "P", "P01", "P02")], "session_id string, mic string, num_samples bigint")
    assert sessions.activity(rows, of, lengths).where("speaker_id = 'Noise'").count() == 1
    raises(sessions.activity(sessions.examples(first, first, arrays, speakers, files, worn=False), of, lengths), "no time")
    with pytest.raises(ValueError, match="noise"):
        sessions.activity(rows, of, lengths, noise=-1)
    some = rows.limit(0).select("example_id", F.lit("P01").alias("source"), F.array(F.lit(True)).alias("active"))
    raises(sessions.activity(rows, of, lengths, None, some), "alignments are missing")
    db = catalog.Catalog(rows.withColumn("dataset", F.col("session_id")))
    with pytest.raises(ValueError, match="drop_unknown"):
        sessions.session_rows(db, "S01", adjust_times=True)
    with pytest.raises(KeyError, match="S01"):
        sessions.session_rows(db, "S02")


def test_phone_channels(spark):
    rows = spark.createDataFrame([("P28_S09_LIVING.R-0714562-0714764", [1]), ("P28_S09_LIVING.L-0714562-0714764", [2]), ("P09_S03_NOLOCATION.L-0007974-0008116", [3])], "utt_id string, ids array<int>")
    symbols = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "word string, id bigint")
    got = lambda p: {r.example_id: r.phones for r in sessions.phone_alignment(rows, symbols, p).collect()}
    assert got(["R", "L"]) == {"P28_S09_0714562-0714764": ["x"], "P09_S03_0007974-0008116": ["z"]}
    assert got(["L", "R"])["P28_S09_0714562-0714764"] == ["y"]
    raises(sessions.phone_alignment(rows, symbols, ["L"]), "the channels aren't")
    raises(sessions.phone_alignment(rows, symbols, None), "isn't unique")
    raises(sessions.phone_alignment(rows, symbols.where("id < 3"), ["R", "L"]), "no symbol")


@pytest.mark.parametrize("multiarray", [True, False])
def test_enhanced_sessions(spark, multiarray):
    """From wav files and transcripts to samples, against the chain over slices cut by hand."""
    first, arrays, speakers, _ = one_session(spark, 2)
    files = spark.createDataFrame([("S01", u, [f"{u}.CH{k}.wav" for k in (1, 2)] if u[0] == "U" else [f"{u}.wav"]) for u in ("U01", "U02", "P01", "P02")], "session_id string, unit string, files array<string>")
    rows = sessions.examples(first, first, arrays, speakers, files)
    rng = np.random.default_rng(1)
    wave = {f"{u}.CH{k}.wav": rng.normal(size=14_000) * 0.1 for u in ("U01", "U02") for k in (1, 2)}
    content = spark.createDataFrame([(p, bytearray(audio.write(x, kind="float64"))) for p, x in wave.items()], "path string, content binary")
    lengths = spark.createDataFrame([("S01", m, 14_000) for m in ("U01", "U02")], "session_id string, mic string, num_samples bigint")
    config = enhance.Config(context_samples=600, stft_size=128, stft_shift=32, wpe_taps=2, em_iterations=3, multiarray=multiarray)
    db = catalog.Catalog(rows.withColumn("dataset", F.col("session_id")))
    got = {r.utt: np.array(r.samples) for r in enhance.enhance_sessions(db, "S01", content, arrays, speakers, lengths, config).collect()}
    assert len(got) == 2
    for i, name in enumerate(sorted(r.example_id for r in rows.orderBy("start.original").collect())):
        i = 0 if name.startswith("P02") else 1
        span = lambda u, j=i: (4000 * j + 2000 + (100 if u == "U01" else 300), 4000 * j + 5000 + 40 * j + (100 if u == "U01" else 300))
        units = ("U01", "U02") if multiarray else ("U02",)
        x = np.stack([wave[f"{u}.CH{k}.wav"][max(0, span(u)[0] - 600) : span(u)[1] + 600] for u in units for k in (1, 2)])
        lo, hi = span("U02")
        begin = max(0, lo - 600)
        y = signal.stft(x, 128, 32)
        frames = y.shape[1]
        on = np.zeros((3, frames))
        for j, c in ((0, 1), (1, 0)):
            a, b = (z - begin for z in span("U02", j))
            a, b = max(a, 0), min(b, hi + 600 - begin)
            for f in range(frames):
                on[c, f] = max(on[c, f], float(a < b and a < f * 32 - 96 + 128 and f * 32 - 96 < b))
        on[2] = 1
        y = np.stack([signal.wpe(y[..., f], 2, 2, 3) for f in range(y.shape[-1])], -1)
        m = np.stack([signal.guided_masks(y[..., f], on, 3, 1) for f in range(y.shape[-1])], -1)
        inside = [f for f in range(frames) if f * 32 - 96 + 128 > lo - begin and f * 32 - 96 < hi - begin]
        m[:, [f for f in range(frames) if f not in inside]] = 0
        own = 1 if i == 0 else 0
        want = signal.istft(signal.beamform(y, m[own], np.delete(m, own, 0).sum(0)), 128, 32, True, x.shape[1])[lo - begin : hi - begin]
        assert len(got[name]) == hi - lo and np.allclose(got[name], want, atol=1e-6)


def test_enhanced_single_clock_sessions(spark):
    """Rows on one clock, with transcription and diarised ones with their own activity, give what the chain gives by hand."""
    rng = np.random.default_rng(2)
    wave = [rng.normal(size=9000) * 0.1 for _ in range(3)]
    content = spark.createDataFrame([(f"{k}.wav", bytearray(audio.write(x, kind="float64"))) for k, x in enumerate(wave)], "path string, content binary")
    rows = spark.createDataFrame(
        [("a", "S01", "S01", "P01", "x", 1000, 4000, 3000, ["0.wav", "1.wav", "2.wav"]), ("b", "S01", "S01", "P02", "y", 3500, 7000, 3500, ["0.wav", "1.wav", "2.wav"]), ("c", "S01", "S01", None, "[redacted]", 0, 10, 10, ["0.wav"])],
        "example_id string, dataset string, session_id string, speaker_id string, transcription string, start bigint, end bigint, num_samples bigint, audio_path array<string>",
    )
    speakers = spark.createDataFrame([("S01", "P01"), ("S01", "P02")], "session_id string, speaker_id string")
    config = enhance.Config(context_samples=500, stft_size=128, stft_shift=32, wpe=False, em_iterations=3)
    got = {r.utt: np.array(r.samples) for r in enhance.enhance_sessions(catalog.Catalog(rows), "S01", content, None, speakers, None, config).collect()}
    plain = rows.where("speaker_id is not null").drop("transcription")
    active = sessions.single_clock_activity(rows, True)
    again = {r.utt: np.array(r.samples) for r in enhance.enhance_sessions(catalog.Catalog(plain), "S01", content, None, speakers, None, config, active=active).collect()}
    assert sorted(got) == sorted(again) == ["a", "b"] and all(np.array_equal(got[k], again[k]) for k in got)
    lo, hi = 500, 4500
    y = signal.stft(np.stack(wave)[:, lo:hi], 128, 32)
    on = np.array([[float(a - lo < f * 32 - 96 + 128 and f * 32 - 96 < min(b, hi) - lo) for f in range(y.shape[1])] for a, b in ((1000, 4000), (3500, 7000), (0, 10**9))])
    m = np.stack([signal.guided_masks(y[..., f], on, 3, 1) for f in range(y.shape[-1])], -1)
    m[:, [f for f in range(y.shape[1]) if not (f * 32 - 96 + 128 > 500 and f * 32 - 96 < 3500)]] = 0
    want = signal.istft(signal.beamform(y, m[0], m[1] + m[2]), 128, 32, True, hi - lo)[500:3500]
    assert len(got["a"]) == 3000 and np.allclose(got["a"], want, atol=1e-6)


def test_audio_of_branches_and_units(spark):
    first, arrays, speakers, files = one_session(spark, 1)
    rows = sessions.examples(first, first, arrays, speakers, files)
    wave = {u: np.round(np.random.default_rng(k).normal(size=6000) * 1000) / 2**15 for k, u in enumerate(("U01", "U02", "P01", "P02"))}
    content = spark.createDataFrame([(f"{u}.wav", bytearray(audio.write(x))) for u, x in wave.items()], "path string, content binary")
    late = {"U01": 100, "U02": 300, "P01": 50, "P02": 70}
    for kwargs, want in (({}, {"U01", "U02"}), ({"branch": "worn"}, {"P01", "P02"}), ({"units": ["U02"]}, {"U02"}), ({"branch": "worn", "units": ["P01", "U01"]}, {"P01"})):
        got = {r.unit: r.samples for r in sessions.session_audio(rows, content, **kwargs).collect()}
        assert set(got) == want and all(np.array_equal(x, wave[u][2000 + late[u] : 5000 + late[u]]) for u, x in got.items())


def test_raw_audio():
    x = np.array([[0, 100, -200], [5, -32768, 32767]])
    assert np.array_equal(audio.read_raw(x.T.astype("<i2").tobytes() + b"?", "int16", 2), x / 2**15)
    assert np.array_equal(audio.read_raw(np.array([0.5, -2.0], "<f4").tobytes(), "float32"), [[0.5, -2.0]])
    with pytest.raises(ValueError, match="sample type"):
        audio.read_raw(b"", "int24")
