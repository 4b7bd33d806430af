"""Queries over multi-clock sessions: transcripts as files, example rows, activity by perspective, preparation, cross-talk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions import ids
from talkweave.functions import timebase as tb
from talkweave.operators import catalog as cat
from talkweave.operators import sessions as ss
from talkweave.sources import shared, sinks, text

from .annotations import ORACLES as ANNOTATED
from .annotations import QUERIES as ANNOTATIONS
from .fixtures import table
from .intervals import merged_sql

Q = {}
S = {}
ARRAYS, WORN, SIZE = range(1, 7), range(1, 4), 100_000
MICS = [(f"U{k:02d}", "U", k) for k in ARRAYS] + [(f"P{k:02d}", "P", k) for k in WORN] + [("original", "o", 0)]
KEYS = ["session_id", "pos"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that overlap the next one: session_id, pos, speaker (none for redacted ones), words, s, e (samples on the original clock)."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    b = F.coalesce(F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    own = F.when(F.col("role") == "user", "P01").when(F.col("role") == "assistant", "P02")
    words = F.when(F.col("role") == "system", "[redacted]").otherwise(F.coalesce("text", F.lit("")))
    return c.select(F.concat(F.lit("S"), ids.zero_filled(F.col("conv_id"), 2)).alias("session_id"), "conv_id", F.col("turn").alias("pos"), own.alias("speaker"), words.alias("words"), (b * 160).alias("s"), ((b + 2 * n + 1 + F.col("turn")) * 160).alias("e"))


def _clocks(df: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """Adds start_time and end_time on every clock: arrays drift and are longer on odd turns, worn microphones are late."""
    odd, third = F.pmod("pos", F.lit(2)), F.pmod("pos", F.lit(3))
    late = {m: 1600 * k + 160 * k * third if kind == "U" else 16000 * k + 160 * k * odd if kind == "P" else F.lit(0) for m, kind, k in MICS}
    first = F.create_map(*(x for m, _, _ in MICS for x in (F.lit(m), (F.col("s") + late[m] + start).cast("bigint"))))
    last = F.create_map(*(x for m, kind, k in MICS for x in (F.lit(m), (F.col("e") + late[m] + end + (160 * k * odd if kind == "U" else 0)).cast("bigint"))))
    return df.withColumns({"start_time": first, "end_time": last})


TURNS = """turns AS (SELECT 'S' || lpad(CAST(conv_id AS VARCHAR), CAST(greatest(length(CAST(conv_id AS VARCHAR)), 2) AS INT), '0') AS session_id, conv_id, turn AS pos,
    CASE role WHEN 'user' THEN 'P01' WHEN 'assistant' THEN 'P02' END AS speaker, CASE WHEN role = 'system' THEN '[redacted]' ELSE coalesce(text, '') END AS words, b * 160 AS s, (b + 2 * n + 1 + turn) * 160 AS e
  FROM (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM (SELECT *, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM conversations))),
mics(mic, kind, k) AS (VALUES """ + ", ".join(f"('{m}', '{kind}', {k})" for m, kind, k in MICS) + """),
clocks AS (SELECT t.*, mic, kind, k, s + late AS "start", e + late + CASE kind WHEN 'U' THEN 160 * k * (pos % 2) ELSE 0 END AS "end" FROM
  (SELECT *, CASE kind WHEN 'U' THEN 1600 * k + 160 * k * (pos % 3) WHEN 'P' THEN 16000 * k + 160 * k * (pos % 2) ELSE 0 END AS late FROM turns, mics) t)"""  # fmt: skip
#: Clocks of the example rows (realigned times) without arrays that are missing or have no files.
HERE = f"""{TURNS}, there AS (SELECT * FROM clocks WHERE (session_id, mic) NOT IN (('S05', 'U03'), ('S22', 'U03'), ('S09', 'U05'))),
here AS (SELECT * REPLACE ("start" + 320 AS "start", "end" + 480 AS "end"), coalesce(speaker, 'unknown') || '_' || session_id || '_' || lpad(CAST(s // 160 AS VARCHAR), CAST(greatest(length(CAST(s // 160 AS VARCHAR)), 7) AS INT), '0')
  || '-' || lpad(CAST(e // 160 AS VARCHAR), CAST(greatest(length(CAST(e // 160 AS VARCHAR)), 7) AS INT), '0') AS example_id FROM there WHERE NOT (mic = 'U04' AND conv_id % 4 = 1))"""


def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts written as a JSON file a session, of all sizes, and read: every row's place in its file and its time on every clock."""
    rows = _clocks(_turns(spark, sf_dir))
    said = lambda c: F.transform_values(c, lambda _, v: tb.samples_to_text(v))
    entry = F.to_json(F.struct(said(F.col("start_time")).alias("start_time"), said(F.col("end_time")).alias("end_time"), "words", "speaker", "session_id"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", entry.alias("j")))), lambda x: x["j"]), ",")
    path = shared.path(spark, "transcripts")
    sinks.write_documents(rows.groupBy(F.col("session_id").alias("name")).agg(F.concat(F.lit("["), listed, F.lit("]")).alias("value")), path)
    got = text.transcripts(spark, path, multi=True)
    long = got.select("session_id", "pos", "speaker", F.explode("start_time").alias("mic", "start"), "end_time")
    return long.select("session_id", "pos", "speaker", "mic", "start", F.element_at("end_time", F.col("mic")).alias("end"))


Q["transcript_files"] = transcript_files
S["transcript_files"] = f'WITH {TURNS} SELECT session_id, CAST(pos AS INT) AS pos, speaker, mic, "start", "end" FROM clocks'


def _dimensions(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Arrays, speakers and files of the sessions; every fourth session has no files of U04."""
    of = turns.select("session_id", "conv_id").distinct()
    speakers = of.select("session_id", F.explode(F.array(*(F.lit(f"P{k:02d}") for k in WORN))).alias("speaker_id"))
    units = of.select("*", F.explode(F.array(*(F.lit(m) for m, kind, _ in MICS if kind != "o"))).alias("unit")).where("not (unit = 'U04' and conv_id % 4 = 1)")
    stem = F.concat(F.lit("/audio/"), F.col("session_id"), F.lit("_"), F.col("unit"))
    files = F.when(F.col("unit").startswith("U"), F.array(F.concat(stem, F.lit(".CH1.wav")), F.concat(stem, F.lit(".CH2.wav")))).otherwise(F.array(F.concat(stem, F.lit(".wav"))))
    return ss.expected_arrays(of), speakers, units.select("session_id", "unit", files.alias("files"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).withColumns({"location": F.lit(None).cast("string"), "ref": F.when(F.col("pos") % 2 == 0, "U01").otherwise("U02")})
    arrays, speakers, files = _dimensions(turns)
    first = _clocks(turns).drop("s", "e", "conv_id")
    notes = spark.createDataFrame([("S03", "a note of this session")], "session_id string, note string")
    other = turns.where("speaker = 'P01'").select(ids.example_id(F.col("speaker"), F.col("session_id"), F.col("s"), F.col("e")).alias("example_id"), F.concat(F.lit("T: "), "words").alias("other_transcription"))
    least = turns.groupBy("session_id").agg(F.count("*").alias("least"))
    return ss.examples(first, _clocks(turns, 320, 480), arrays, speakers, files, women=("P02",), notes=notes, other_words=other, least=least)


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-clock example rows, all but their times."""
    e = _examples(spark, sf_dir)
    units = lambda b: F.array_join(F.sort_array(F.map_keys(f"audio_path.{b}")), ",")
    return e.select("example_id", "session_id", "speaker_id", "gender", "transcription", F.array_join("notes", "; ").alias("notes"), units("observation").alias("arrays"), units("worn").alias("worn"), "location", "reference_array", "other_transcription")


Q["create_database_multi"] = built
S["create_database_multi"] = f"""WITH {HERE}, per AS (SELECT example_id, session_id, pos, conv_id, speaker, words, string_agg(mic, ',' ORDER BY mic) FILTER (kind = 'U') AS arrays, string_agg(mic, ',' ORDER BY mic) FILTER (kind = 'P') AS worn FROM here GROUP BY ALL)
SELECT example_id, session_id, speaker AS speaker_id, CASE speaker WHEN 'P02' THEN 'female' WHEN 'P01' THEN 'male' END AS gender, words AS transcription,
  concat_ws('; ', CASE WHEN speaker IS NULL THEN 'target_speaker_id is missing' END, CASE session_id WHEN 'S09' THEN 'Array U05 is missing, this is expected' WHEN 'S05' THEN 'Array U03 is missing, this is expected' WHEN 'S22' THEN 'Array U03 is missing, this is expected' END,
    CASE WHEN conv_id % 4 = 1 THEN 'Array U04 is missing, this may be expected' END, CASE WHEN session_id = 'S03' THEN 'a note of this session' END) AS notes,
  arrays, worn, CAST(NULL AS VARCHAR) AS location, CASE WHEN pos % 2 = 0 THEN 'U01' ELSE 'U02' END AS reference_array, CASE WHEN speaker = 'P01' THEN 'T: ' || words END AS other_transcription FROM per"""


def _long(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each clock of the multi-clock columns."""
    flat = lambda c: F.map_concat(f"{c}.observation", f"{c}.worn", F.create_map(F.lit("original"), F.col(f"{c}.original")))
    rows = df.select("example_id", F.explode(flat(columns[0])).alias("mic", columns[0]), *(flat(c).alias(f"_{c}") for c in columns[1:]))
    return rows.select("example_id", "mic", columns[0], *(F.element_at(f"_{c}", F.col("mic")).alias(c) for c in columns[1:]))


Q["create_database_clocks"] = lambda spark, d: _long(_examples(spark, d), "start", "end", "num_samples")
S["create_database_clocks"] = f'WITH {HERE} SELECT example_id, mic, "start", "end", "end" - "start" AS num_samples FROM here'


def _lengths(of: DataFrame) -> DataFrame:
    return of.select("session_id", F.explode(F.array(*(F.lit(m) for m, _, _ in MICS[:-1]), F.lit("P"))).alias("mic"), F.lit(SIZE).alias("num_samples"))


def _activity(spark: SparkSession, sf_dir: str, kind: str | list[str], noise: bool | int | None, alignment: DataFrame | None = None) -> DataFrame:
    turns = _turns(spark, sf_dir)
    arrays, speakers, _ = _dimensions(turns)
    of = turns.select("session_id").distinct()
    return ss.activity(_examples(spark, sf_dir), ss.perspectives(kind, of, arrays, speakers), _lengths(of), noise, alignment)


def _activity_sql(where: str, perspective: str, noise: str) -> str:
    """Merged intervals of the microphones that ``where`` takes, cut at SIZE, and rows of the noise classes."""
    return f"""WITH {HERE}, own AS (SELECT session_id, {perspective} AS perspective, speaker AS speaker_id, "start", least("end", {SIZE}) AS "end" FROM here WHERE speaker IS NOT NULL AND {where}),
{merged_sql('session_id, perspective, speaker_id', 'own')} SELECT * FROM merged {noise}"""


Q["activity_by_array"] = lambda spark, d: _activity(spark, d, "array", True)
S["activity_by_array"] = _activity_sql("kind = 'U'", "mic", f"UNION ALL SELECT DISTINCT session_id, mic, 'Noise', 0, {SIZE} FROM there WHERE kind = 'U'")
Q["activity_worn"] = lambda spark, d: _activity(spark, d, "worn", None)
S["activity_worn"] = _activity_sql("kind = 'P'", "mic", "")
Q["activity_global_worn"] = lambda spark, d: _activity(spark, d, "global_worn", 2)
S["activity_global_worn"] = _activity_sql("mic = speaker", "'P'", f"UNION ALL SELECT DISTINCT session_id, 'P', n, 0, {SIZE} FROM turns, (VALUES ('Noise0'), ('Noise1')) v(n)")
Q["activity_of_microphones"] = lambda spark, d: _activity(spark, d, ["U02", "P02"], False)
S["activity_of_microphones"] = _activity_sql("mic IN ('U02', 'P02')", "mic", "")


def one_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity on a session's one clock with an always active noise class, of the fixed length."""
    rows = _turns(spark, sf_dir).select("session_id", F.col("speaker").alias("speaker_id"), F.col("words").alias("transcription"), F.col("s").alias("start"), F.col("e").alias("end"))
    return ss.single_clock_activity(rows, True)


Q["activity_one_clock"] = one_clock
S["activity_one_clock"] = f"""WITH {TURNS}, own AS (SELECT session_id, speaker AS speaker_id, s AS "start", e AS "end" FROM turns WHERE speaker IS NOT NULL), {merged_sql('session_id, speaker_id', 'own')}
SELECT * FROM merged UNION ALL SELECT DISTINCT session_id, 'Noise', 0, {ss.LONGEST} FROM turns"""


def diarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of diarisation lines, with a noise class that is never active."""
    from .annotations import _rttm

    return ss.diarised_activity(_rttm(spark, sf_dir), False)


Q["activity_diarised"] = diarised
S["activity_diarised"] = f'SELECT session_id, speaker_id, "start", "end" FROM ({ANNOTATED["rttm_examples"]})'


def by_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity from alignments made on the speakers' own microphones, of 40 frames each; every fifth turn has none."""
    turns = _turns(spark, sf_dir).where("speaker is not null and pos % 5 <> 4")
    name = ids.example_id(F.col("speaker"), F.col("session_id"), F.col("s"), F.col("e"))
    active = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.pmod(i + F.col("pos"), F.lit(8)) < 5)
    return _activity(spark, sf_dir, "U06", None, turns.select(name.alias("example_id"), F.col("speaker").alias("source"), active.alias("active")))


Q["activity_aligned"] = by_alignment
S["activity_aligned"] = f"""WITH {HERE}, pairs AS (SELECT t.*, t."end" - t."start" AS own, w."end" - w."start" AS source FROM here t JOIN here w ON t.example_id = w.example_id AND w.mic = t.speaker WHERE t.mic = 'U06'),
spans AS (SELECT *, sign(own - source) * (abs(own - source) // 2) AS moved, f * 160 AS lo, least(f * 160 + 400, source) AS hi FROM pairs, range(40) r(f) WHERE pos % 5 <> 4 AND (f + pos) % 8 < 5),
own AS (SELECT session_id, mic AS perspective, speaker AS speaker_id, "start", least("end", {SIZE}) AS "end" FROM (
  SELECT session_id, mic, speaker, "start", "end" FROM pairs WHERE pos % 5 = 4
  UNION ALL SELECT session_id, mic, speaker, CAST("start" + greatest(lo + moved, 0) AS BIGINT), CAST("start" + least(hi + moved, own) AS BIGINT) FROM spans WHERE lo < hi AND greatest(lo + moved, 0) < least(hi + moved, own))),
{merged_sql('session_id, perspective, speaker_id', 'own')} SELECT * FROM merged"""


def _catalog(spark: SparkSession, rows: DataFrame) -> cat.Catalog:
    names = rows.select(F.lit("all").alias("alias"), F.col("session_id").alias("dataset")).distinct()
    return cat.Catalog(rows.withColumn("dataset", F.col("session_id")), names)


def _prepared_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.session_rows(_catalog(spark, _examples(spark, sf_dir)), "all", drop_unknown=True, adjust_times=True, context_samples=1000)


Q["session_chain"] = lambda spark, d: _long(_prepared_rows(spark, d), "start", "end", "num_samples", "start_orig", "end_orig")
CHAIN = f"""{HERE}, fit AS (SELECT h.*, CASE WHEN kind = 'U' THEN (o."end" - o."start") - (h."end" - h."start") ELSE 0 END AS delta FROM here h JOIN (SELECT example_id, "start", "end" FROM here WHERE kind = 'o') o USING (example_id) WHERE speaker IS NOT NULL),
chain AS (SELECT *, "start" - sign(delta) * (abs(delta) // 2) AS start_orig, "end" + sign(delta) * (abs(delta) - abs(delta) // 2) AS end_orig FROM fit)"""
S["session_chain"] = f"""WITH {CHAIN} SELECT example_id, mic, CAST(greatest(start_orig - 1000, 0) AS BIGINT) AS "start", CAST(end_orig + 1000 AS BIGINT) AS "end", CAST(end_orig + 1000 - greatest(start_orig - 1000, 0) AS BIGINT) AS num_samples,
  CAST(start_orig AS BIGINT) AS start_orig, CAST(end_orig AS BIGINT) AS end_orig FROM chain"""


def single_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over diarised rows: context on the one clock."""
    return ss.session_rows(_catalog(spark, ANNOTATIONS["rttm_examples"](spark, sf_dir)), "all", context_samples=(500, 900)).drop("dataset")


Q["session_chain_single"] = single_chain
S["session_chain_single"] = f"""SELECT * REPLACE (greatest("start" - 500, 0) AS "start", "end" + 900 AS "end", "end" + 900 - greatest("start" - 500, 0) AS num_samples), "start" AS start_orig, "end" AS end_orig, num_samples AS num_samples_orig FROM ({ANNOTATED["rttm_examples"]})"""


def _channels(rows: DataFrame) -> DataFrame:
    units = rows.select(F.col("example_id").alias("utt"), F.explode(F.map_keys("audio_path.observation")).alias("unit"))
    return units.select("*", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("channel"), F.array(F.lit(0.0)).alias("samples"))


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """What the enhancement gets: three channels of every array, the activity on the arrays' clocks, a noise class."""
    rows = shared.materialise(_prepared_rows(spark, sf_dir))
    _, speakers, _ = _dimensions(_turns(spark, sf_dir))
    return ss.prepared(rows, _channels(rows), _activity(spark, sf_dir, "array", True), speakers, True, True)


Q["prepared_activity"] = lambda spark, d: _prepared(spark, d)[1]
S["prepared_activity"] = f"""WITH {CHAIN}, own AS (SELECT session_id, mic AS perspective, speaker AS speaker_id, "start", least("end", {SIZE}) AS "end" FROM here WHERE speaker IS NOT NULL AND kind = 'U'), {merged_sql('session_id, perspective, speaker_id', 'own')},
active AS (SELECT * FROM merged UNION ALL SELECT DISTINCT session_id, mic, 'Noise', 0, {SIZE} FROM there WHERE kind = 'U'),
windows AS (SELECT example_id, session_id, mic, greatest(start_orig - 1000, 0) AS lo, end_orig + 1000 AS hi FROM chain WHERE mic = CASE WHEN pos % 2 = 0 THEN 'U01' ELSE 'U02' END)
SELECT example_id AS utt, CASE speaker_id WHEN 'P01' THEN 0 WHEN 'P02' THEN 1 ELSE 3 END AS class_idx, CAST(greatest("start", lo) - lo AS BIGINT) AS "start", CAST(least("end", hi) - lo AS BIGINT) AS "end"
FROM windows w JOIN active a ON w.session_id = a.session_id AND a.perspective = w.mic AND greatest("start", lo) < least("end", hi)"""
Q["prepared_targets"] = lambda spark, d: _prepared(spark, d)[3]
S["prepared_targets"] = f"""WITH {CHAIN} SELECT example_id AS utt, CASE speaker WHEN 'P01' THEN 0 ELSE 1 END AS class_idx, CAST(start_orig - greatest(start_orig - 1000, 0) AS BIGINT) AS context_start, CAST(end_orig - start_orig AS BIGINT) AS num_samples
FROM chain WHERE mic = CASE WHEN pos % 2 = 0 THEN 'U01' ELSE 'U02' END"""


def channel_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many channels each choice takes of each utterance, and which."""
    # the chain is worked out once, not for each choice and side of its joins
    out, rows = None, shared.materialise(_prepared_rows(spark, sf_dir).select("example_id", "reference_array", "audio_path"))
    every = _channels(rows)
    for how in (True, False, "outer_array_mics", "first_array_mics"):
        got = ss.chosen_channels(every, rows.withColumnRenamed("example_id", "utt"), how).groupBy("utt").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat(F.substring("channel", 1, 3), F.lit("."), F.substring("channel", -1, 1)))), ",").alias("channels"))
        got = got.withColumn("choice", F.lit(str(how)))
        out = got if out is None else out.unionByName(got)
    return out


Q["chosen_channels"] = channel_choices
S["chosen_channels"] = f"""WITH {CHAIN}, every AS (SELECT example_id, mic, c, mic = CASE WHEN pos % 2 = 0 THEN 'U01' ELSE 'U02' END AS own FROM chain, range(3) r(c) WHERE kind = 'U'),
choices AS (SELECT *, 'True' AS choice FROM every UNION ALL SELECT *, 'False' FROM every WHERE own UNION ALL SELECT *, 'outer_array_mics' FROM every WHERE c <> 1 UNION ALL SELECT *, 'first_array_mics' FROM every WHERE c = 0)
SELECT example_id AS utt, choice, count(*) AS n, string_agg(mic || '.' || c, ',' ORDER BY mic, c) AS channels FROM choices GROUP BY ALL"""


def per_microphone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of two speakers on every worn microphone's clock."""
    rows = _clocks(_turns(spark, sf_dir))
    worn = lambda c: F.map_filter(c, lambda k, _: k.startswith("P"))
    return ss.cross_talk_per_mic(rows.select("session_id", "pos", F.col("speaker").alias("speaker_id"), worn("start_time").alias("start"), worn("end_time").alias("end")), 1 << 17)


Q["crosstalk_per_microphone"] = per_microphone
MET = f"""{TURNS}, p AS (SELECT * FROM clocks WHERE kind = 'P' AND speaker IS NOT NULL),
met AS (SELECT a.session_id, a.speaker AS active, a.pos, b.speaker AS second, b.pos AS second_pos, a."start" > b."start" AS later, a."end" < b."end" AS sooner FROM p a JOIN p b ON a.session_id = b.session_id AND a.mic = a.speaker AND b.mic = a.speaker AND b.speaker <> a.speaker
  AND a."start" <= b."end" AND a."end" >= b."start")"""
S["crosstalk_per_microphone"] = f"""WITH {MET} SELECT m.session_id, m.active, m.pos, m.second, m.second_pos, x.mic, CASE WHEN later THEN x."start" ELSE y."start" END AS "start", CASE WHEN sooner THEN x."end" ELSE y."end" END AS "end"
FROM met m JOIN p x ON x.session_id = m.session_id AND x.pos = m.pos JOIN p y ON y.session_id = m.session_id AND y.pos = m.second_pos AND y.mic = x.mic"""


def heard_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said and what is cross-talk on each worn microphone in windows of 30000 samples."""
    turns = _clocks(_turns(spark, sf_dir))
    worn = lambda c: F.map_filter(c, lambda k, _: k.startswith("P"))
    own = tb.speaker_times(turns.select(F.col("session_id").alias("session"), "speaker", worn("start_time").alias("start"), worn("end_time").alias("end")))
    own = own.withColumnsRenamed({"session": "session_id", "speaker": "speaker_id"})
    low = F.col("window_id") * 30000
    windows = own.select("session_id", "mic").distinct().select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("window_id")).withColumns({"start": low, "end": low + 30000})
    return ss.active_speakers(own, per_microphone(spark, sf_dir), windows, 1 << 17)


Q["active_speakers"] = heard_in_windows


def speaker_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers' activity and cross-talk written as a JSON file a session and read again: intervals by name and microphone."""
    turns = _clocks(_turns(spark, sf_dir))
    worn = lambda c: F.map_filter(c, lambda k, _: k.startswith("P"))
    own = tb.speaker_times(turns.select(F.col("session_id").alias("session"), "speaker", worn("start_time").alias("start"), worn("end_time").alias("end")))
    path = shared.path(spark, "speakers")
    sinks.write_speaker_activity(own, per_microphone(spark, sf_dir).withColumnRenamed("session_id", "session").select("session", "mic", "start", "end"), path)
    got = text.documents(spark, path).withColumnRenamed("name", "session")
    long = got.select("session", F.explode(F.from_json("value", "map<string,map<string,struct<start:array<bigint>,end:array<bigint>>>>", {"mode": "FAILFAST"})).alias("name", "_m"))
    long = long.select("session", "name", F.explode("_m").alias("mic", "_t"))
    return long.select("session", "name", "mic", F.explode(F.arrays_zip("_t.start", "_t.end")).alias("x")).select("session", "name", "mic", "x.start", "x.end")


Q["speaker_activity_files"] = speaker_documents
S["speaker_activity_files"] = f"""WITH {MET} SELECT session_id AS session, speaker AS name, mic, "start", "end" FROM p
UNION ALL SELECT session_id, 'cross_talk', mic, "start", "end" FROM (SELECT m.session_id, m.active, m.pos, m.second, m.second_pos, x.mic, CASE WHEN later THEN x."start" ELSE y."start" END AS "start", CASE WHEN sooner THEN x."end" ELSE y."end" END AS "end"
FROM met m JOIN p x ON x.session_id = m.session_id AND x.pos = m.pos JOIN p y ON y.session_id = m.session_id AND y.pos = m.second_pos AND y.mic = x.mic)"""


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone alignments of two channels, the right one preferred, ids as symbols, and which frames aren't silent."""
    t = _turns(spark, sf_dir).where("speaker is not null")
    name = lambda c: ids.located_id(ids.example_id(F.col("speaker"), F.col("session_id"), F.col("s"), F.col("e")), F.lit(None).cast("string")) if c == "L" else F.regexp_replace(name("L"), r"\.L-", ".R-")
    items = F.transform(F.sequence(F.lit(0), F.pmod("pos", F.lit(6))), lambda i: F.pmod(i + F.col("pos"), F.lit(4)).cast("int"))
    left = t.select(name("L").alias("utt_id"), items.alias("ids"))
    right = t.where("pos % 2 = 0").select(name("R").alias("utt_id"), F.reverse(items).alias("ids"))
    symbols = spark.createDataFrame([("sil", 0), ("a_B", 1), ("b_I", 2), ("c_E", 3)], "word string, id bigint")
    got = ss.phone_alignment(left.unionByName(right), symbols, ["R", "L"])
    active = ss.non_silence(got).withColumn("active", F.array_join(F.transform("active", lambda a: a.cast("int").cast("string")), ""))
    return got.withColumn("phones", F.array_join("phones", " ")).join(active, "example_id")


S["active_speakers"] = S["speaker_activity_files"].replace("SELECT session_id AS session, speaker AS name, mic", ", said AS (SELECT session_id, 'activity' AS kind, speaker AS speaker_id, mic", 1).replace(
    "UNION ALL SELECT session_id, 'cross_talk', mic", "UNION ALL SELECT session_id, 'cross_talk', mic, mic", 1
) + f"""), cut AS (SELECT session_id, mic, w AS window_id, kind, speaker_id, greatest("start", w * 30000) - w * 30000 AS "start", least("end", w * 30000 + 30000) - w * 30000 AS "end" FROM said, range(10) r(w)),
{merged_sql('session_id, mic, window_id, kind, speaker_id', 'cut')} SELECT * FROM merged"""
Q["phone_alignment"] = phones
S["phone_alignment"] = f"""WITH {TURNS}, t AS (SELECT *, speaker || '_' || session_id || '_' AS head, lpad(CAST(s // 160 AS VARCHAR), CAST(greatest(length(CAST(s // 160 AS VARCHAR)), 7) AS INT), '0') || '-' || lpad(CAST(e // 160 AS VARCHAR), CAST(greatest(length(CAST(e // 160 AS VARCHAR)), 7) AS INT), '0') AS times,
  list_transform(range(pos % 6 + 1), lambda i: (i + pos) % 4) AS x FROM turns WHERE speaker IS NOT NULL), p AS (SELECT *, CASE WHEN pos % 2 = 0 THEN list_reverse(x) ELSE x END AS y FROM t)
SELECT head || times AS example_id, head || 'NOLOCATION.' || CASE WHEN pos % 2 = 0 THEN 'R' ELSE 'L' END || '-' || times AS utt_id, array_to_string(list_transform(y, lambda k: ['sil', 'a_B', 'b_I', 'c_E'][CAST(k + 1 AS INT)]), ' ') AS phones,
  speaker AS source, array_to_string(list_transform(y, lambda k: CASE WHEN k > 0 THEN '1' ELSE '0' END), '') AS active FROM p"""

QUERIES, ORACLES = Q, S
