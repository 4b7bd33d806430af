"""Sessions: example rows of multi-clock recordings, activity by perspective, and the chains that prepare a session.

Dimensions are tables: ``arrays`` (session_id, array, present), ``speakers``
(session_id, speaker_id), ``lengths`` (session_id, mic, num_samples).  A
microphone is an array (``U..``) or a speaker's own (``P..``), each with a
clock of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.functions import ids, timebase
from talkweave.sources import audio

from . import catalog, overlap
from . import intervals as iv

#: Ids of rows whose end lies before their start.
BROKEN = ("P45_S21_0356170-0356149", "P45_S21-0356170-0356149")
#: Arrays that were not recorded; the later generation of the corpus lacks two more.
MISSING = (("S05", "U03"), ("S22", "U03"), ("S09", "U05"))
MISSING_LATER = (*MISSING, ("S01", "U03"), ("S05", "U04"))
LONGEST = 10 * 3600 * 16000


def expected_arrays(sessions: DataFrame, later: bool = False, count: int = 6) -> DataFrame:
    """(session_id, array, present) of every session: arrays U01 .. and whether each is to be there."""
    missing = sessions.sparkSession.createDataFrame(list(MISSING_LATER if later else MISSING), "session_id string, array string").withColumn("_m", F.lit(True))
    every = sessions.select("session_id").distinct().select("session_id", F.explode(F.array(*(F.lit(f"U{k:02d}") for k in range(1, count + 1)))).alias("array"))
    return every.join(missing, ["session_id", "array"], "left").select("session_id", "array", F.col("_m").isNull().alias("present"))


def picked_times(times: Column, arrays: Column, speakers: Column, worn: bool = True) -> Column:
    """Of a flat map of clocks the arrays', the speakers' and the original one as a multi-clock time; one that is missing raises."""
    wanted = F.concat(arrays, speakers, F.array(F.lit("original"))) if worn else F.concat(arrays, F.array(F.lit("original")))
    lost = F.array_except(wanted, F.map_keys(times))
    sound = F.when(F.size(lost) > 0, F.raise_error(F.concat(F.lit("no time of "), F.array_join(lost, ", "))).cast("map<string,bigint>")).otherwise(times)
    none = F.create_map().cast("map<string,bigint>")
    return F.struct(
        F.map_filter(sound, lambda k, _: F.array_contains(arrays, k)).alias("observation"),
        (F.map_filter(sound, lambda k, _: F.array_contains(speakers, k)) if worn else none).alias("worn"),
        F.element_at(sound, "original").alias("original"),
    )


def examples(
    original: DataFrame, realigned: DataFrame, arrays: DataFrame, speakers: DataFrame, files: DataFrame, women: Sequence[str] = (), notes: DataFrame | None = None,
    other_words: DataFrame | None = None, least: DataFrame | None = None, worn: bool = True, broken: Sequence[str] = BROKEN,
) -> DataFrame:
    """Multi-clock example rows of two transcripts put together by position: ids from the original times, times from the realigned.

    Transcripts have session_id, pos, start_time, end_time (maps of samples), and the original one speaker, words,
    location, ref. ``files``: (session_id, unit, files); an array without files is left out everywhere, with a note.
    ``notes``: (session_id, note); ``other_words``: (example_id, other_transcription); ``least``: (session_id, least)
    rows, fewer raise. A row without a speaker has the id of an unknown one and a note. Ids of ``broken`` are left out.
    """
    both = catalog.positional(original, realigned.select("session_id", "pos", "start_time", "end_time"), ["session_id"])
    if least is not None:
        few = both.groupBy("session_id").agg(F.count("*").alias("_n")).join(least, "session_id").where("_n < least")
        both = catalog.gated_by(both, few, "a session has too few rows")
    here = F.sort_array(F.collect_list(F.when(F.col("present"), F.col("array"))))
    gone = F.sort_array(F.collect_list(F.when(~F.col("present"), F.col("array"))))
    of = arrays.groupBy("session_id").agg(here.alias("_arrays"), gone.alias("_gone"))
    of = of.join(speakers.groupBy("session_id").agg(F.sort_array(F.collect_set("speaker_id")).alias("_speakers")), "session_id")
    of = of.join(files.groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("unit", "files")))).alias("_files")), "session_id", "left")
    none = F.array().cast("array<string>")
    of = of.withColumn("_files", F.coalesce("_files", F.create_map().cast("map<string,array<string>>")))
    of = of.withColumn("_lost", F.array_except("_arrays", F.map_keys("_files"))).withColumn("_arrays", F.array_except("_arrays", "_lost"))
    expected = F.when(F.size("_gone") > 0, F.array(F.concat(F.lit("Array "), F.array_join("_gone", " and "), F.when(F.size("_gone") > 1, " are").otherwise(" is"), F.lit(" missing, this is expected")))).otherwise(none)
    unknown = F.when(F.col("speaker").isNull(), F.array(F.lit("target_speaker_id is missing"))).otherwise(none)
    surprising = F.transform("_lost", lambda a: F.concat(F.lit("Array "), a, F.lit(" is missing, this may be expected")))
    rows = both.join(of, "session_id")
    if notes is not None:
        rows = rows.join(notes.groupBy("session_id").agg(F.sort_array(F.collect_list("note")).alias("_notes")), "session_id", "left")
    told = F.concat(unknown, expected, surprising, F.coalesce("_notes", none) if notes is not None else none)
    name = ids.example_id(F.coalesce("speaker", F.lit("unknown")), F.col("session_id"), F.element_at("start_time", "original"), F.element_at("end_time", "original"))
    times = {at: picked_times(F.col(f"{at}_time_r"), F.col("_arrays"), F.col("_speakers"), worn) for at in ("start", "end")}
    paths = F.struct(
        F.map_filter("_files", lambda k, _: F.array_contains(F.col("_arrays"), k)).alias("observation"),
        F.transform_values(F.map_filter("_files", lambda k, _: F.array_contains(F.col("_speakers"), k)), lambda _, v: F.element_at(v, 1)).alias("worn"),
    )
    gender = F.when(F.col("speaker").isNotNull(), F.when(F.col("speaker").isin(list(women)), "female").otherwise("male"))
    rows = rows.select(
        name.alias("example_id"), "session_id", F.col("speaker").alias("speaker_id"), gender.alias("gender"), F.col("words").alias("transcription"), times["start"].alias("start"), times["end"].alias("end"),
        paths.alias("audio_path"), told.alias("notes"), "location", F.col("ref").alias("reference_array"),
    )
    rows = rows.where(~F.col("example_id").isin(list(broken))) if broken else rows
    rows = rows.withColumn("num_samples", timebase.duration(F.col("start"), F.col("end")))
    return rows if other_words is None else rows.join(other_words.select("example_id", "other_transcription"), "example_id", "left")


def perspectives(kind: str | Sequence[str], sessions: DataFrame, arrays: DataFrame | None = None, speakers: DataFrame | None = None) -> DataFrame:
    """(session_id, perspective): ``array``, ``worn``, ``global_worn`` (``P``: each speaker's own clock), or a list of microphones."""
    if kind == "array":
        return arrays.where("present").select("session_id", F.col("array").alias("perspective")).distinct()
    if kind == "worn":
        return speakers.select("session_id", F.col("speaker_id").alias("perspective")).distinct()
    names = ["P"] if kind == "global_worn" else [kind] if isinstance(kind, str) else list(kind)
    return sessions.select("session_id").distinct().select("session_id", F.explode(F.array(*(F.lit(n) for n in names))).alias("perspective"))


def _noise(lengths: DataFrame, keys: Sequence[str], noise: bool | int | None) -> DataFrame | None:
    """Intervals of the noise classes that are always on: (keys, speaker_id, start, end); ``lengths`` has keys and num_samples."""
    if noise is None or noise is False:
        return None
    if noise is not True and (not isinstance(noise, int) or noise <= 0):
        raise ValueError(f"no noise class {noise!r}")
    names = ["Noise"] if noise is True else [f"Noise{k}" for k in range(noise)]
    zero = F.lit(0).cast("bigint")
    return lengths.select(*keys, F.explode(F.array(*(F.lit(n) for n in names))).alias("speaker_id"), zero.alias("start"), F.col("num_samples").cast("bigint").alias("end"))


def activity(rows: DataFrame, of: DataFrame, lengths: DataFrame, noise: bool | int | None = True, alignment: DataFrame | None = None) -> DataFrame:
    """(session_id, perspective, speaker_id, start, end): when each speaker is active on the clock of each perspective of ``of``.

    Redacted rows count for nothing, and rows that an array didn't record not for that array; a speaker's microphone
    without a time raises. Intervals end at the perspective's length (``lengths``: session_id, mic, num_samples; ``P``
    too). With an ``alignment`` (see ``aligned``) only its active frames count, and an example without one is active as
    a whole; a session in which that is so for more than half raises. A class that is never active has no row.
    """
    told = catalog.not_redacted(rows).join(of, "session_id")
    mic = F.when(F.col("perspective") == "P", F.col("speaker_id")).otherwise(F.col("perspective"))
    told = told.withColumn("mic", mic)
    at = {c: F.when(F.col("mic").startswith("P"), F.element_at(f"{c}.worn", F.col("mic"))).otherwise(F.element_at(f"{c}.observation", F.col("mic"))) for c in ("start", "end", "num_samples")}
    told = told.withColumns({f"_{c}": x for c, x in at.items()})
    told = catalog.gate(told, F.col("mic").startswith("P") & F.col("_start").isNull(), "a speaker's microphone has no time").where("_start is not null")
    keys = ["session_id", "perspective", "speaker_id"]
    own = told.select(*keys, "example_id", "mic", F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_num_samples").alias("length"), "num_samples")
    if alignment is not None:
        own = aligned(own, alignment)
    size = lengths.select("session_id", F.col("mic").alias("perspective"), F.col("num_samples").alias("_size"))
    own = own.select(*keys, "start", "end").join(size, ["session_id", "perspective"])
    out = iv.normalise(iv.clip(own, F.lit(0).cast("bigint"), F.col("_size")), keys)
    always = _noise(of.join(size.withColumnRenamed("_size", "num_samples"), ["session_id", "perspective"]), ["session_id", "perspective"], noise)
    return out if always is None else out.unionByName(always)


def aligned(rows: DataFrame, alignment: DataFrame, length: int = 400, shift: int = 160) -> DataFrame:
    """Rows cut to what an alignment (example_id, source, active: array<boolean>) says; ``source`` is the microphone it was made on.

    Its frames become samples of the source's length, are centred in (or cut to) the row's own length and moved to its
    start. A row without an alignment stays whole; if there are more of these in a session than half of its examples,
    it raises. ``rows`` has session_id, example_id, mic, start, end, length, num_samples (a multi-clock one).
    """
    kept = [c for c in rows.columns if c not in ("start", "end")]
    met = rows.join(alignment.select("example_id", "source", "active"), "example_id", "left")
    lost = met.groupBy("session_id").agg(F.count_if(F.col("source").isNull()).alias("_lost"), F.count_distinct("example_id").alias("_n"))
    met = catalog.gated_by(met, lost.where("_lost > floor(_n / 2)"), "too many alignments are missing")
    whole = met.where("source is null").select(*kept, "start", "end")
    size = F.coalesce(F.element_at("num_samples.worn", F.col("source")), F.element_at("num_samples.observation", F.col("source")))
    some = catalog.gate(met.where("source is not null").withColumn("_source_length", size), F.col("_source_length").isNull(), "the alignment's microphone has no length")
    on = some.select(*kept, "start", "_source_length", F.posexplode("active").alias("frame", "_on")).where("_on")
    spans = iv.clip(on.withColumns({"_at": F.col("start"), "start": (F.col("frame") * shift).cast("bigint"), "end": (F.col("frame") * shift + length).cast("bigint")}), F.lit(0).cast("bigint"), F.col("_source_length"))
    delta = F.col("length") - F.col("_source_length")
    moved = F.signum(delta).cast("bigint") * F.call_function("div", F.abs(delta), F.lit(2).cast("bigint"))
    spans = iv.clip(spans.withColumns({"start": F.col("start") + moved, "end": F.col("end") + moved}), F.lit(0).cast("bigint"), F.col("length"))
    return whole.unionByName(spans.select(*kept, (F.col("start") + F.col("_at")).alias("start"), (F.col("end") + F.col("_at")).alias("end")))


def single_clock_activity(rows: DataFrame, noise: bool | int | None = True, length: int = LONGEST) -> DataFrame:
    """(session_id, speaker_id, start, end) on the one clock of a session, of a fixed length that is enough for any."""
    own = catalog.not_redacted(rows).select("session_id", "speaker_id", "start", "end")
    out = iv.normalise(iv.clip(own, F.lit(0).cast("bigint"), F.lit(length).cast("bigint")), ["session_id", "speaker_id"])
    always = _noise(rows.select("session_id").distinct().withColumn("num_samples", F.lit(length)), ["session_id"], noise)
    return out if always is None else out.unionByName(always)


def diarised_activity(lines: DataFrame, noise: bool | None = True, length: int = LONGEST) -> DataFrame:
    """The same of diarisation lines (value): file ids cleaned, two files of one id raise; ``noise`` is True, False or None."""
    from talkweave.sources import text

    if noise not in (True, False, None):
        raise ValueError(f"no noise class {noise!r}")
    rows = text.rttm_examples(text.rttm_intervals(lines)).select("session_id", "speaker_id", "start", "end")
    always = _noise(rows.select("session_id").distinct().withColumn("num_samples", F.lit(length)), ["session_id"], noise)
    return rows if always is None else rows.unionByName(always)


def classes(speakers: DataFrame, noise: bool | int | None = True) -> DataFrame:
    """(session_id, class_idx, speaker_id): a session's classes in their order, speakers first, then noise, whether on or off."""
    names = [] if noise is None else ["Noise"] if isinstance(noise, bool) else [f"Noise{k}" for k in range(noise)]
    per = speakers.groupBy("session_id").agg(F.sort_array(F.collect_set("speaker_id")).alias("_c"))
    return per.select("session_id", F.posexplode(F.concat("_c", F.array(*(F.lit(n) for n in names)).cast("array<string>"))).alias("class_idx", "speaker_id"))


def session_rows(
    of: catalog.Catalog, sessions: str | Sequence[str], drop_unknown: bool = False, adjust_times: bool = False, context_samples: int | tuple[int, ...] | dict = 0, equal_start_context: bool = False,
) -> DataFrame:
    """Example rows of sessions, prepared: redacted ones left out, times adjusted and kept as ``*_orig``, context added, in this order.

    Works on multi-clock and on single-clock rows (diarised ones too, which have no transcription); the latter can't
    be adjusted. ``adjust_times`` needs ``drop_unknown``, as a redacted row has no speaker whose times count.
    """
    df = of.get_datasets(sessions)
    multi = dict(df.dtypes)["start"].startswith("struct")
    if drop_unknown:
        df = catalog.not_redacted(df)
    if adjust_times:
        if not drop_unknown or not multi:
            raise ValueError("times are adjusted on several clocks, and with drop_unknown only")
        df = timebase.adjust_start_end(df)
    if adjust_times or context_samples:
        df = timebase.backup(df)
    if context_samples:
        df = timebase.add_context(df, context_samples, equal_start_context) if multi else timebase.add_context_flat(df, context_samples)
    return df


def session_audio(rows: DataFrame, files: DataFrame, branch: str = "observation", units: Sequence[str] | None = None) -> DataFrame:
    """(example_id, unit, channel, samples) of the arrays' files (``files``: path, content), each on its own clock between start and end.

    Multi-clock rows have ``audio_path`` by branch, of which ``branch`` is read, or of that only ``units``; single-clock
    ones have a list of paths and the unit ``U``.
    """
    if dict(rows.dtypes)["start"].startswith("struct"):
        paths = F.col(f"audio_path.{branch}")
        paths = paths if branch == "observation" else F.transform_values(paths, lambda _, p: F.array(p))
        long = rows.select("example_id", F.explode(paths).alias("unit", "_p"), "start", "end")
        long = long if units is None else long.where(F.col("unit").isin(list(units)))
        long = long.select("example_id", "unit", F.posexplode("_p").alias("_k", "path"), F.element_at(f"start.{branch}", F.col("unit")).alias("start"), F.element_at(f"end.{branch}", F.col("unit")).alias("end"))
    else:
        long = rows.select("example_id", F.lit("U").alias("unit"), F.posexplode("audio_path").alias("_k", "path"), "start", "end")
    got = audio.load(long.join(files, "path"), F.col("start"), F.col("end"), keep=("example_id", "unit", "_k"))
    return got.select("example_id", "unit", (F.col("_k") * 1000 + F.col("channel")).cast("int").alias("channel"), "samples")


def chosen_channels(channels: DataFrame, reference: DataFrame, multiarray: bool | str) -> DataFrame:
    """(utt, channel, samples): channels of all arrays (True), of each one's outer or first microphones, or of the reference array alone (False).

    ``channels``: (utt, unit, channel, samples), ``reference``: (utt, reference_array).
    """
    from pyspark.sql import Window

    if multiarray not in (True, False, "outer_array_mics", "first_array_mics"):
        raise ValueError(f"no selection {multiarray!r}")
    if multiarray is False:
        channels = channels.join(reference.select("utt", F.col("reference_array").alias("unit")), ["utt", "unit"])
    elif multiarray is not True:
        of = Window.partitionBy("utt", "unit")
        last = F.col("channel") == F.max("channel").over(of)
        first = F.col("channel") == F.min("channel").over(of)
        channels = channels.withColumn("_on", first | last if multiarray == "outer_array_mics" else first).where("_on")
    return channels.select("utt", F.concat("unit", F.lit("/"), F.lpad(F.col("channel").cast("string"), 8, "0")).alias("channel"), "samples")


def prepared(rows: DataFrame, channels: DataFrame, active: DataFrame, speakers: DataFrame, noise: bool | int | None, multiarray: bool | str, reference: str | None = None, width: int = 60 * 16000) -> tuple[DataFrame, ...]:
    """What ``enhance.enhance`` takes: channels, activity, classes and targets of every example of ``rows``.

    ``active`` is the activity of the reference arrays' clocks (see ``activity``); ``rows`` come from ``session_rows``
    and have ``reference_array`` unless ``reference`` names one for all. A row without either raises. Rows on a single
    clock have one unit, ``U``, whose activity is the session's (see ``single_clock_activity``).
    """
    if dict(rows.dtypes)["start"].startswith("struct"):
        unit = F.lit(reference) if reference else F.col("reference_array")
        of = lambda c: F.element_at(f"{c}.observation", F.col("reference_array"))
    else:
        unit, of, active = F.lit("U"), F.col, active.withColumn("perspective", F.lit("U"))
    rows = rows.withColumn("reference_array", unit)
    rows = catalog.gate(rows, F.col("reference_array").isNull(), "a row has no reference_array").withColumnRenamed("example_id", "utt")
    kept = "start_orig" in rows.columns
    window = rows.select("session_id", F.col("reference_array").alias("perspective"), "utt", of("start").alias("start"), of("end").alias("end"))
    inside = overlap.window_slice(active.select("session_id", "perspective", "speaker_id", "start", "end"), window, ["session_id", "perspective"], width)
    every = rows.select("utt", "session_id", "speaker_id").withColumnRenamed("speaker_id", "_own").join(classes(speakers, noise), "session_id")
    found = inside.select("utt", F.col("speaker_id_r").alias("speaker_id"), "start", "end").join(every.select("utt", "speaker_id", "class_idx"), ["utt", "speaker_id"])
    own = every.where(F.col("_own") == F.col("speaker_id")).select("utt", "class_idx")
    target = rows.select("utt", (of("start_orig") - of("start") if kept else F.lit(0)).cast("bigint").alias("context_start"), of("num_samples_orig" if kept else "num_samples").alias("num_samples")).join(own, "utt")
    return chosen_channels(channels, rows, multiarray), found.select("utt", "class_idx", "start", "end"), every.select("utt", "class_idx"), target


def active_speakers(active: DataFrame, cross: DataFrame, windows: DataFrame, width: int = overlap.HOUR_US) -> DataFrame:
    """What is said and what is cross-talk on a microphone within windows, counted from their starts: (.., window_id, kind, speaker_id, start, end).

    ``active``: (session_id, mic, speaker_id, start, end), ``cross``: (session_id, mic, start, end), whose speaker is the
    microphone's, ``windows``: (session_id, mic, window_id, start, end). Touching or overlapping parts are united.
    """
    keys = ["session_id", "mic"]
    both = active.select(*keys, F.lit("activity").alias("kind"), "speaker_id", "start", "end").unionByName(cross.select(*keys, F.lit("cross_talk").alias("kind"), F.col("mic").alias("speaker_id"), "start", "end"))
    met = overlap.window_slice(both, windows, keys, width)
    rows = met.select(*keys, "window_id", F.col("kind_r").alias("kind"), F.col("speaker_id_r").alias("speaker_id"), "start", "end")
    return iv.normalise(rows, [*keys, "window_id", "kind", "speaker_id"])


def cross_talk_per_mic(rows: DataFrame, width: int = overlap.HOUR_US) -> DataFrame:
    """(session_id, active, pos, second, second_pos, mic, start, end): overlaps of two speakers on every worn microphone's clock.

    Whether two utterances overlap (touching ones do) is decided on the clock of the active speaker's own microphone;
    the later start and the earlier end are then read on every clock from the row that has them there. Both orders of
    a pair are given, as their clocks differ. ``rows``: (session_id, pos, speaker_id, start, end), maps by microphone.
    """
    long = rows.where("speaker_id is not null").select("session_id", "pos", "speaker_id", F.col("start").alias("starts"), F.col("end").alias("ends"))
    long = long.select("*", F.explode("starts").alias("mic", "start")).withColumn("end", F.element_at("ends", F.col("mic")))
    met = overlap.overlap_join(long.where("speaker_id = mic"), long.where("speaker_id <> mic"), ["session_id", "mic"], width, closed=True)
    start = F.when(F.col("start") > F.col("start_r"), F.col("starts")).otherwise(F.col("starts_r"))
    end = F.when(F.col("end") < F.col("end_r"), F.col("ends")).otherwise(F.col("ends_r"))
    both = F.map_entries(F.map_zip_with(start, end, lambda _, s, e: F.struct(s.alias("start"), e.alias("end"))))
    out = met.select("session_id", F.col("speaker_id").alias("active"), "pos", F.col("speaker_id_r").alias("second"), F.col("pos_r").alias("second_pos"), F.explode(both).alias("_m"))
    return out.select("session_id", "active", "pos", "second", "second_pos", F.col("_m.key").alias("mic"), "_m.value.start", "_m.value.end")


def phone_alignment(alignment: DataFrame, symbols: DataFrame, preference: Sequence[str] | None = None) -> DataFrame:
    """(example_id, utt_id, phones): an utterance's alignment (utt_id, ids) of the preferred channel, its ids as symbols (word, id).

    Every channel of ``preference`` must occur and no other; without a preference an utterance has one alignment only.
    An id without a symbol raises.
    """
    named = alignment.select("utt_id", "ids", ids.plain_id(F.col("utt_id")).alias("example_id"), ids.channel_of(F.col("utt_id")).alias("channel"))
    if preference is None:
        named = catalog.unique_ids(named)
    else:
        wrong = named.agg(F.sort_array(F.collect_set("channel")).alias("c")).where(F.col("c") != F.array(*(F.lit(c) for c in sorted(preference))))
        named = catalog.prefer_first(catalog.gated_by(named, wrong, f"the channels aren't {sorted(preference)}"), "example_id", "channel", preference)
    long = named.select("example_id", "utt_id", F.posexplode_outer("ids").alias("_pos", "_id"))
    long = long.join(symbols.select(F.col("id").cast("int").alias("_id"), "word"), "_id", "left")
    long = catalog.gate(long, F.col("_id").isNotNull() & F.col("word").isNull(), "an id has no symbol")
    phones = F.transform(F.sort_array(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "word")))), lambda x: x["word"])
    return long.groupBy("example_id", "utt_id").agg(phones.alias("phones"))


def non_silence(phones: DataFrame, silence: str = "sil") -> DataFrame:
    """(example_id, source, active) for ``aligned`` of ``phone_alignment``; the source is the id's array, or its speaker's microphone."""
    return phones.select("example_id", ids.id_parts(F.col("utt_id"))["array_id_or_speaker"].alias("source"), F.transform("phones", lambda p: p != silence).alias("active"))
