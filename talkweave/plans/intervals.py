"""Queries over interval sets and concurrency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.operators import analytics as an
from talkweave.operators import frames as fr
from talkweave.operators import intervals as iv
from talkweave.operators import overlap as ov

from .fixtures import ACTIVITY, activity, table

DAY0 = 1704067200000000  # 2024-01-01
DAY = 86_400_000_000
KEYS = ["session", "speaker"]
WIDTH = DAY  # a session is one key of a hot set, so its sweeps are cut into days


def merged_sql(keys: str, src: str, name: str = "merged") -> str:
    """SQL of the normal form of ``src``."""
    return f"""{name} AS (SELECT {keys}, min("start") AS "start", max("end") AS "end" FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY "start", "end", fresh DESC ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT {keys}, "start", "end", CASE WHEN "start" <= max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end"
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {src} WHERE "start" < "end"))
  GROUP BY {keys}, island)"""


def sweep_sql(keys: str, sides: dict[str, str], name: str = "pieces") -> str:
    """SQL of elementary pieces with how many intervals of each side cover them."""
    parts = " UNION ALL ".join(
        f"""SELECT {keys}, "{at}" AS p, {', '.join(f'{step if n == own else 0} AS d_{n}' for n in sides)} FROM {src} WHERE "start" < "end" """
        for own, src in sides.items()
        for at, step in (("start", 1), ("end", -1))
    )
    d = ", ".join(f"sum(d_{n}) AS d_{n}" for n in sides)
    run = ", ".join(f"CAST(sum(d_{n}) OVER (PARTITION BY {keys} ORDER BY p ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_{n}" for n in sides)
    return f"""{name} AS (SELECT * FROM (SELECT {keys}, p AS "start", lead(p) OVER (PARTITION BY {keys} ORDER BY p) AS "end", {run}
  FROM (SELECT {keys}, p, {d} FROM ({parts}) GROUP BY {keys}, p)) WHERE "end" IS NOT NULL)"""


Q = {}
S = {}
FLAT = f"WITH {ACTIVITY}, {merged_sql('session, speaker', 'activity')}"


def _total(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum(F.col("end") - F.col("start")).alias("active_us"))


def talk_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time in which each speaker of each session is active at all."""
    return _total(iv.normalise(activity(spark, sf_dir), KEYS), *KEYS)


Q["talk_time"] = talk_time
S["talk_time"] = f"""{FLAT} SELECT session, speaker, count(*) AS runs, CAST(sum("end" - "start") AS BIGINT) AS active_us FROM merged GROUP BY ALL"""

Q["interval_normalize"] = lambda spark, d: iv.normalise(activity(spark, d), KEYS)
S["interval_normalize"] = f"{FLAT} SELECT * FROM merged"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = activity(spark, sf_dir)
    return a.where(F.col("utt") % 2 == 0), a.where(F.col("utt") % 2 == 1)


EVEN, ODD = "(SELECT * FROM activity WHERE utt % 2 = 0)", "(SELECT * FROM activity WHERE utt % 2 = 1)"
Q["interval_union"] = lambda spark, d: iv.union(["session"], *_halves(spark, d), width=WIDTH)
S["interval_union"] = f"WITH {ACTIVITY}, {merged_sql('session', 'activity')} SELECT * FROM merged"
Q["interval_intersect"] = lambda spark, d: iv.intersect(*_halves(spark, d), ["session"], width=WIDTH)
S["interval_intersect"] = f"""WITH {ACTIVITY}, {sweep_sql('session', {'a': EVEN, 'b': ODD})}, both_ AS (SELECT session, "start", "end" FROM pieces WHERE n_a > 0 AND n_b > 0),
{merged_sql('session', 'both_')} SELECT * FROM merged"""
Q["interval_subtract"] = lambda spark, d: iv.subtract(*_halves(spark, d), ["session"], width=WIDTH)
S["interval_subtract"] = f"""WITH {ACTIVITY}, {sweep_sql('session', {'a': EVEN, 'b': ODD})}, rest AS (SELECT session, "start", "end" FROM pieces WHERE n_a > 0 AND n_b = 0),
{merged_sql('session', 'rest')} SELECT * FROM merged"""

LO, HI = DAY0 + 5 * DAY, DAY0 + 12 * DAY
Q["interval_intersect_window"] = lambda spark, d: iv.clip(iv.normalise(activity(spark, d), KEYS), LO, HI)
S["interval_intersect_window"] = f"""{FLAT} SELECT session, speaker, greatest("start", {LO}) AS "start", least("end", {HI}) AS "end" FROM merged WHERE "start" < {HI} AND "end" > {LO}"""
Q["interval_window_rebased"] = lambda spark, d: iv.clip(iv.normalise(activity(spark, d), KEYS), LO, HI, rebase=True)
S["interval_window_rebased"] = f"""{FLAT} SELECT session, speaker, greatest("start", {LO}) - {LO} AS "start", least("end", {HI}) - {LO} AS "end" FROM merged WHERE "start" < {HI} AND "end" > {LO}"""
Q["interval_clear_window"] = lambda spark, d: iv.clear(iv.normalise(activity(spark, d), KEYS), LO, HI)
S["interval_clear_window"] = f"""{FLAT} SELECT session, speaker, "start", least("end", {LO}) AS "end" FROM merged WHERE "start" < {LO}
UNION ALL SELECT session, speaker, greatest("start", {HI}), "end" FROM merged WHERE "end" > {HI}"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda x: x > 0).alias("flags"))


RUNS = """flags AS (SELECT vec_id, i - 1 AS pos, embedding[i] > 0 AS v FROM embeddings, range(1, 5000) r(i) WHERE i <= len(embedding)),
islands AS (SELECT vec_id, pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS g FROM flags WHERE v),
runs AS (SELECT vec_id, CAST(min(pos) AS BIGINT) AS "start", CAST(max(pos) + 1 AS BIGINT) AS "end" FROM islands GROUP BY vec_id, g)"""
Q["interval_runs_from_flags"] = lambda spark, d: iv.from_flags(_flags(spark, d), ["vec_id"], "flags")
S["interval_runs_from_flags"] = f"WITH {RUNS} SELECT * FROM runs"


def assign_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors' positive runs with positions 8 to 12 replaced by their first four flags."""
    f = _flags(spark, sf_dir)
    return iv.assign(iv.from_flags(f, ["vec_id"], "flags"), f.withColumn("flags", F.slice("flags", 1, 4)), ["vec_id"], 8, 12)


Q["interval_assign_array"] = assign_array
S["interval_assign_array"] = f"""WITH {RUNS}, parts AS (SELECT vec_id, "start", least("end", 8) AS "end" FROM runs WHERE "start" < 8
  UNION ALL SELECT vec_id, greatest("start", 12), "end" FROM runs WHERE "end" > 12 UNION ALL SELECT vec_id, pos + 8, pos + 9 FROM flags WHERE v AND pos < 4),
{merged_sql('vec_id', 'parts')} SELECT * FROM merged"""
Q["interval_encode"] = lambda spark, d: iv.encode(iv.from_flags(_flags(spark, d), ["vec_id"], "flags"), ["vec_id"])
S["interval_encode"] = f"""WITH {RUNS} SELECT vec_id, string_agg("start" || ':' || "end", ', ' ORDER BY "start") AS intervals FROM runs GROUP BY vec_id"""
Q["interval_codec"] = lambda spark, d: iv.decode(iv.encode(iv.from_flags(_flags(spark, d), ["vec_id"], "flags"), ["vec_id"]), ["vec_id"])
S["interval_codec"] = S["interval_runs_from_flags"]


def noise_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity with two noise classes that are always on."""
    a = activity(spark, sf_dir)
    lengths = a.groupBy("session").agg(F.max("end").alias("length"))
    return iv.noise_class(iv.normalise(a, KEYS), lengths, "session", 2)


Q["noise_class_union"] = noise_union
S["noise_class_union"] = f"""{FLAT} SELECT session, CAST(speaker AS VARCHAR) AS speaker, "start", "end" FROM merged
UNION ALL SELECT session, n, 0, max("end") FROM activity, (VALUES ('Noise0'), ('Noise1')) v(n) GROUP BY session, n"""
Q["activity_classes"] = lambda spark, d: iv.classes(activity(spark, d), "session", True).select("session", "class_idx", "speaker")
S["activity_classes"] = f"""WITH {ACTIVITY}, own AS (SELECT DISTINCT session, CAST(speaker AS VARCHAR) AS speaker FROM activity),
every AS (SELECT session, 0 AS k, speaker FROM own UNION ALL SELECT DISTINCT session, 1, 'Noise' FROM own)
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY k, speaker) - 1 AS INT) AS class_idx, speaker FROM every"""

PIECES = f"WITH {ACTIVITY}, {sweep_sql('session', {'a': 'activity'})}"
LEVELS = f"""{PIECES}, marked AS (SELECT *, CASE WHEN lag("end") OVER w = "start" AND lag(n_a) OVER w = n_a THEN 0 ELSE 1 END AS fresh FROM pieces WINDOW w AS (PARTITION BY session ORDER BY "start")),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS run FROM marked),
levels AS (SELECT session, n_a AS n, min("start") AS "start", max("end") AS "end" FROM numbered GROUP BY session, run, n_a HAVING n_a > 0)"""
Q["concurrency_sweep"] = lambda spark, d: iv.concurrency(activity(spark, d), ["session"], width=WIDTH)
S["concurrency_sweep"] = f"{LEVELS} SELECT * FROM levels"
Q["exactly_one_active"] = lambda spark, d: an.exactly_one(activity(spark, d), ["session"], width=WIDTH)
S["exactly_one_active"] = f"""{LEVELS} SELECT session, "start", "end" FROM levels WHERE n = 1"""

OVERLAPS = f"""WITH {ACTIVITY}, pairs AS (SELECT a.session, a.utt, a.speaker, b.utt AS utt_r, b.speaker AS speaker_r, greatest(a."start", b."start") AS overlap_start, least(a."end", b."end") AS overlap_end
  FROM activity a JOIN activity b ON a.session = b.session AND a."start" <= b."end" AND a."end" >= b."start")"""


def crosstalk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-talk by pair of speakers: how often and how long (touching utterances count, with nothing)."""
    return ov.cross_talk_totals(activity(spark, sf_dir))


Q["crosstalk_pairs"] = crosstalk_pairs
S["crosstalk_pairs"] = f"{OVERLAPS} SELECT session, speaker, speaker_r, count(*) AS n, CAST(sum(overlap_end - overlap_start) AS BIGINT) AS overlap_us FROM pairs WHERE speaker < speaker_r GROUP BY ALL"
SHARE = f"""{OVERLAPS}, parts AS (SELECT session, utt, overlap_start AS "start", overlap_end AS "end" FROM pairs WHERE speaker <> speaker_r), {merged_sql('session, utt', 'parts')},
per AS (SELECT a.session, a.utt, a."end" - a."start" AS length, CAST(coalesce(m.o, 0) AS BIGINT) AS "overlap" FROM activity a
  LEFT JOIN (SELECT session, utt, sum("end" - "start") AS o FROM merged GROUP BY ALL) m ON a.session = m.session AND a.utt = m.utt WHERE a."start" < a."end")"""
Q["crosstalk_share"] = lambda spark, d: an.overlap_per_utterance(activity(spark, d))
S["crosstalk_share"] = f"{SHARE} SELECT * FROM per"
Q["overlap_summary"] = lambda spark, d: an.overlap_summary(an.overlap_per_utterance(activity(spark, d)))
S["overlap_summary"] = f"""{SHARE} SELECT session, count(*) AS n, count(*) FILTER ("overlap" > 0) AS n_overlapped, count(*) FILTER ("overlap" > 0)::DOUBLE / count(*)::DOUBLE AS share,
  min("overlap") FILTER ("overlap" > 0) AS least, max("overlap") AS most, CAST(sum("overlap") AS BIGINT) AS total FROM per GROUP BY session"""
Q["overlap_histogram"] = lambda spark, d: an.overlap_histogram(an.overlap_per_utterance(activity(spark, d)))
S["overlap_histogram"] = f"""{SHARE} SELECT session, CASE WHEN "overlap" = 0 THEN -1 ELSE least("overlap" * 10 // length * 10, 90) END AS bin, count(*) AS n FROM per GROUP BY ALL"""
Q["activity_ratio"] = lambda spark, d: an.activity_ratio(activity(spark, d), width=WIDTH)
S["activity_ratio"] = f"""{FLAT}, {merged_sql('session', 'activity', 'anyone')}, span AS (SELECT session, max("end") - min("start") AS w FROM merged GROUP BY session),
shares AS (SELECT session, CAST(speaker AS VARCHAR) AS speaker, sum("end" - "start") AS t FROM merged GROUP BY ALL UNION ALL SELECT session, NULL, sum("end" - "start") FROM anyone GROUP BY ALL)
SELECT s.session, speaker, t::DOUBLE / w::DOUBLE AS ratio FROM shares s JOIN span USING (session)"""
Q["window_activity"] = lambda spark, d: an.window_percentage(activity(spark, d), KEYS, LO, HI)
S["window_activity"] = f"""{FLAT} SELECT session, speaker, CAST(sum(least("end", {HI}) - greatest("start", {LO})) AS BIGINT) AS active, sum(least("end", {HI}) - greatest("start", {LO}))::DOUBLE / {HI - LO}::DOUBLE AS share
FROM merged WHERE "start" < {HI} AND "end" > {LO} GROUP BY ALL"""


def utterance_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every utterance: what is said in its session meanwhile, counted from its start."""
    a = activity(spark, sf_dir)
    windows = a.select("session", F.col("utt").alias("window_id"), "start", "end")
    return ov.window_totals(a, windows)


Q["utterance_activity_slice"] = utterance_slices
S["utterance_activity_slice"] = f"""WITH {ACTIVITY} SELECT w.session, w.utt AS window_id, count(*) AS n, CAST(sum(greatest(a."start", w."start") - w."start") AS BIGINT) AS starts,
  CAST(sum(least(a."end", w."end") - w."start") AS BIGINT) AS ends FROM activity w JOIN activity a ON w.session = a.session AND a."start" < w."end" AND w."start" < a."end" WHERE w."start" < w."end" AND a."start" < a."end" GROUP BY ALL"""

LENGTH, SHIFT = 1024, 256


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = lambda c: F.call_function("div", F.col(c) - F.lit(DAY0), F.lit(1000000).cast("bigint"))
    a = activity(spark, sf_dir)
    return a.select("session", "speaker", second("start").alias("start"), second("end").alias("end"))


SECONDS = f"""{ACTIVITY}, seconds AS (SELECT session, speaker, ("start" - {DAY0}) // 1000000 AS "start", ("end" - {DAY0}) // 1000000 AS "end" FROM activity)"""


def _frames_sql(fading: int) -> str:
    return f"""WITH {SECONDS}, f AS (SELECT DISTINCT speaker, unnest(range(greatest(CAST(floor(("start" + {fading} - {LENGTH}) / {SHIFT}.0) AS BIGINT) + 1, 0),
  CAST(floor(("end" + {fading} - 1) / {SHIFT}.0) AS BIGINT) + 1)) AS frame FROM seconds WHERE "start" < "end")"""


Q["frames_from_intervals"] = lambda spark, d: fr.active_frames(_seconds(spark, d), ["speaker"], LENGTH, SHIFT).groupBy("speaker").agg(F.count("*").alias("n"), F.sum("frame").alias("frames"))
S["frames_from_intervals"] = f"{_frames_sql(0)} SELECT speaker, count(*) AS n, CAST(sum(frame) AS BIGINT) AS frames FROM f GROUP BY speaker"
Q["frames_with_fading"] = lambda spark, d: fr.active_frames(_seconds(spark, d), ["speaker"], LENGTH, SHIFT, fading=True).groupBy("speaker").agg(F.count("*").alias("n"), F.sum("frame").alias("frames"))
S["frames_with_fading"] = f"{_frames_sql(LENGTH - SHIFT)} SELECT speaker, count(*) AS n, CAST(sum(frame) AS BIGINT) AS frames FROM f GROUP BY speaker"
Q["intervals_from_frames"] = lambda spark, d: fr.frames_to_samples(fr.active_frames(_seconds(spark, d), ["speaker"], LENGTH, SHIFT), ["speaker"], LENGTH, SHIFT, 2_000_000)
S["intervals_from_frames"] = f"""{_frames_sql(0)}, spans AS (SELECT speaker, frame * {SHIFT} AS "start", frame * {SHIFT} + {LENGTH} AS "end" FROM f), {merged_sql('speaker', 'spans')}
SELECT speaker, "start", least("end", 2000000) AS "end" FROM merged WHERE "start" < 2000000"""
Q["decimated_activity"] = lambda spark, d: fr.decimated(_seconds(spark, d), ["session"], 86400, 864000, 600)
S["decimated_activity"] = f"""WITH {SECONDS}, parts AS (SELECT session, greatest("start" - 86400, 0) // 600 AS "start", least(("end" - 86400) // 600, 1296) AS "end" FROM seconds WHERE "start" <= 864000 AND "end" >= 86400),
{merged_sql('session', 'parts')} SELECT * FROM merged"""


def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of every text taken as a signal of its characters."""
    n = F.length("text").cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", fr.frame_count(n, 1024, 256).alias("padded"), fr.frame_count(n, 1024, 256, False).alias("cut"), fr.context_frames(n, 1024, 256).alias("context"))


Q["frame_counts"] = frame_counts
S["frame_counts"] = """SELECT doc_id, CASE WHEN n < 1024 THEN 1 ELSE (n - 1024 + 255) // 256 + 1 END AS padded, CASE WHEN n < 1024 THEN 0 ELSE (n - 1024) // 256 + 1 END AS cut,
  greatest(CAST(floor((n + 768 - 1024) / 256.0) AS BIGINT) + 1, 0) AS context FROM (SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents)"""


def alignment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero frames of vectors as samples of a target that is 500 samples longer than they are."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("n_frames"), F.posexplode("embedding").alias("frame", "v")).where("v > 0.1")
    rows = rows.withColumn("n_samples", F.col("n_frames") * 160 + 240 + 500)
    return fr.alignment_to_samples(rows, ["vec_id"], 400, 160)


Q["alignment_to_samples"] = alignment_samples
S["alignment_to_samples"] = f"""WITH rows_ AS (SELECT vec_id, CAST(len(embedding) AS BIGINT) AS nf, CAST(i - 1 AS BIGINT) AS frame FROM embeddings, range(1, 5000) r(i) WHERE i <= len(embedding) AND embedding[i] > CAST(0.1 AS DOUBLE)),
spans AS (SELECT vec_id, frame * 160 + 250 AS "start", frame * 160 + 650 AS "end" FROM rows_), {merged_sql('vec_id', 'spans')} SELECT * FROM merged"""

QUERIES, ORACLES = Q, S
