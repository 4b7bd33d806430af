"""Queries over clocks, identifiers and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.functions import ids, nested, timebase as tb

from .fixtures import CLOCKS, TURNS, clocks, leaves, table, turns

Q = {}
S = {}


def to_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day of the events, written as text, in samples at 16 kHz (16 samples a millisecond)."""
    e = table(spark, sf_dir, "events")
    ntz = F.col("ts").cast("timestamp_ntz")
    text = F.concat_ws(":", F.hour(ntz).cast("string"), F.minute(ntz).cast("string"), F.date_format(ntz, "ss.SSS"))
    samples = tb.to_samples(text)
    return e.select("event_id", text.alias("text"), samples.alias("samples"), tb.samples_to_text(samples).alias("again"))


Q["to_samples"] = to_samples
S["to_samples"] = """SELECT event_id, CAST(hour(ts) AS VARCHAR) || ':' || minute(ts) || ':' || strftime(ts, '%S.%g') AS "text",
  (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 16000 + (epoch_us(ts) // 1000 % 1000) * 16 AS samples,
  hour(ts) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') || ':' || strftime(ts, '%S.%g') AS again FROM events"""

Q["clock_durations"] = lambda spark, d: leaves(clocks(spark, d).withColumn("n", tb.duration(F.col("start"), F.col("end"))), "n")
S["clock_durations"] = f"""WITH {CLOCKS} SELECT utt, mic, "end" - "start" AS n FROM clocks UNION ALL SELECT DISTINCT utt, 'original', od FROM clocks"""


def adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays' times made as long as the original ones; what is kept as the original times are the adjusted ones."""
    return leaves(tb.backup(tb.adjust_start_end(clocks(spark, sf_dir))), "start_orig", "end_orig", "num_samples_orig")


Q["adjust_start_end"] = adjust
S["adjust_start_end"] = f"""WITH {CLOCKS}, moved AS (SELECT utt, mic, "start", "end", od - ("end" - "start") AS delta FROM clocks WHERE mic LIKE 'U%'),
fixed AS (SELECT utt, mic, "start" - sign(delta)::BIGINT * (abs(delta) // 2) AS s, "end" + sign(delta)::BIGINT * (abs(delta) - abs(delta) // 2) AS e FROM moved
  UNION ALL SELECT utt, mic, "start", "end" FROM clocks WHERE mic LIKE 'P%' UNION ALL SELECT DISTINCT utt, 'original', o, o + od FROM clocks)
SELECT utt, mic, s AS start_orig, e AS end_orig, e - s AS num_samples_orig FROM fixed"""
CONTEXT = 700
Q["add_context"] = lambda spark, d: leaves(tb.add_context(clocks(spark, d), CONTEXT), "start", "end", "num_samples")
S["add_context"] = f"""WITH {CLOCKS}, every AS (SELECT utt, mic, "start" AS s, "end" AS e FROM clocks UNION ALL SELECT DISTINCT utt, 'original', o, o + od FROM clocks)
SELECT utt, mic, greatest(s - {CONTEXT}, 0) AS "start", e + {CONTEXT} AS "end", e + {CONTEXT} - greatest(s - {CONTEXT}, 0) AS num_samples FROM every"""
Q["equal_start_context"] = lambda spark, d: leaves(tb.add_context(clocks(spark, d), CONTEXT, equal_start=True), "start", "end", "num_samples")
S["equal_start_context"] = f"""WITH {CLOCKS}, every AS (SELECT utt, mic, "start" AS s, "end" AS e FROM clocks UNION ALL SELECT DISTINCT utt, 'original', o, o + od FROM clocks),
c AS (SELECT utt, min(least(s, {CONTEXT})) AS c FROM every GROUP BY utt)
SELECT utt, mic, s - c AS "start", e + {CONTEXT} AS "end", e + {CONTEXT} - (s - c) AS num_samples FROM every JOIN c USING (utt)"""
Q["add_context_single_clock"] = lambda spark, d: tb.add_context_flat(turns(spark, d), (400, 250)).select("session", "pos", "start", "end", "num_samples")
S["add_context_single_clock"] = f"""WITH {TURNS} SELECT session, pos, greatest("start" - 400, 0) AS "start", "end" + 250 AS "end", "end" + 250 - greatest("start" - 400, 0) AS num_samples FROM turns"""


def dropped_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut to items 10 to 30, widened by 4 on both sides, and cut back."""
    x = F.col("embedding")
    wide = F.slice(x, 7, 28)
    return table(spark, sf_dir, "embeddings").select("vec_id", tb.without_context(wide, F.lit(6), F.lit(10), F.lit(20)).alias("part"))


Q["drop_context"] = dropped_context
S["drop_context"] = "SELECT vec_id, embedding[11:30] AS part FROM embeddings"


def speaker_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each worn microphone of each order."""
    rows = clocks(spark, sf_dir).select(F.col("utt").alias("session"), F.when(F.col("utt") % 7 != 0, F.concat(F.lit("P"), (F.col("utt") % 5).cast("string"))).alias("speaker"), F.col("start.worn").alias("start"), F.col("end.worn").alias("end"))
    return tb.speaker_times(rows)


Q["speaker_times"] = speaker_times
S["speaker_times"] = f"""WITH {CLOCKS} SELECT utt AS session, 'P' || (utt % 5) AS speaker, mic, "start", "end" FROM clocks WHERE mic LIKE 'P%' AND utt % 7 <> 0"""


def example_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all turns in the forms that there are."""
    t = turns(spark, sf_dir)
    p = F.concat(F.lit("P"), F.lpad((F.col("pos") % 50).cast("string"), 2, "0"))
    start, end = F.col("start") * 1600, F.col("end") * 1600
    multi = ids.example_id(p, F.col("session"), start, end)
    place = F.when(F.col("pos") % 3 == 0, "kitchen").when(F.col("pos") % 3 == 1, "living")
    located = ids.located_id(multi, place)
    return t.select(
        "session", "pos", multi.alias("multi"), ids.example_id(p, F.col("session"), start, end, True).alias("single"), ids.diarised_id(F.col("session"), p, start, end).alias("diarised"),
        located.alias("located"), ids.plain_id(located).alias("plain"), ids.channel_of(located).alias("channel"), ids.file_id(F.concat("session", F.lit("_U06.ENH"))).alias("file"),
    )


Q["example_ids"] = example_ids
S["example_ids"] = f"""WITH {TURNS}, t AS (SELECT session, pos, 'P' || lpad(CAST(pos % 50 AS VARCHAR), 2, '0') AS p, CAST("start" * 10 AS VARCHAR) AS a, CAST("end" * 10 AS VARCHAR) AS b,
  CAST("start" * 1600 AS VARCHAR) AS sa, CAST("end" * 1600 AS VARCHAR) AS sb, CASE pos % 3 WHEN 0 THEN 'KITCHEN' WHEN 1 THEN 'LIVING' ELSE 'NOLOCATION' END AS place FROM turns),
f AS (SELECT *, lpad(a, CAST(greatest(length(a), 7) AS INT), '0') || '-' || lpad(b, CAST(greatest(length(b), 7) AS INT), '0') AS times FROM t)
SELECT session, pos, p || '_' || session || '_' || times AS multi, p || '_' || session || '-' || times AS "single",
  session || '_U06.-' || p || '-' || lpad(sa, CAST(greatest(length(sa), 9) AS INT), '0') || '_' || lpad(sb, CAST(greatest(length(sb), 9) AS INT), '0') AS diarised,
  p || '_' || session || '_' || place || '.L-' || times AS located, p || '_' || session || '_' || times AS plain, 'L' AS channel, session AS file FROM f"""


def id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of ids with and without an array and a location."""
    t = turns(spark, sf_dir)
    text = F.concat(F.lit("P"), F.lpad((F.col("pos") % 40).cast("string"), 2, "0"), F.lit("_"), F.col("session"), F.when(F.col("pos") % 2 == 0, F.lit("_U03")).otherwise(F.lit("")), F.lit("_KITCHEN.CH1-"), F.col("start").cast("string"))
    return t.select("session", "pos", text.alias("id")).select("session", "pos", ids.id_parts(F.col("id")).alias("x")).select(F.col("session").alias("of"), "pos", "x.*")


Q["id_parts"] = id_parts
S["id_parts"] = f"""WITH {TURNS}, t AS (SELECT *, 'P' || lpad(CAST(pos % 40 AS VARCHAR), 2, '0') AS p FROM turns)
SELECT session AS "of", pos, p AS speaker, session, p AS "array", 'KITCHEN' AS location, 'CH1' AS channel, CASE WHEN pos % 2 = 0 THEN 'U03' ELSE p END AS array_id_or_speaker FROM t"""


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of the events' properties."""
    return table(spark, sf_dir, "events").select("event_id", F.explode(nested.flatten_json(F.col("props"))).alias("key", "leaf"))


Q["json_flatten"] = json_flatten
S["json_flatten"] = "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS leaf FROM events"


def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of nested JSON made of each event."""
    e = table(spark, sf_dir, "events")
    text = F.to_json(F.struct(F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user")).alias("who")).alias("a"), F.array("event_id", "user_id").alias("b")))
    return nested.flatten_tree(e.select("event_id", text.alias("t")), ["event_id"], "t", lists=True).select("event_id", F.array_join("path", "/").alias("path"), "leaf")


Q["tree_flatten"] = tree_flatten
S["tree_flatten"] = """SELECT event_id, 'a/kind' AS path, '"' || event_type || '"' AS leaf FROM events UNION ALL SELECT event_id, 'a/who/user', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'b/0', CAST(event_id AS VARCHAR) FROM events UNION ALL SELECT event_id, 'b/1', CAST(user_id AS VARCHAR) FROM events"""


def tree_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of aligned trees, a scalar broadcast over a tree, values by key."""
    c = clocks(spark, sf_dir)
    s, e = F.col("start.observation"), F.col("end.observation")
    total = nested.map_aligned(s, e, lambda x, y: x + y)
    return c.select("utt", nested.values_by_key(total).alias("sums"), nested.values_by_key(nested.broadcast_to(F.col("start.original"), s)).alias("origins"), nested.values_by_key(nested.map_leaves(s, lambda v: v * 2)).alias("doubles"), nested.to_list(F.col("utt")).alias("listed"))


Q["tree_map"] = tree_map
S["tree_map"] = f"""WITH {CLOCKS}, g AS (SELECT utt, list("start" + "end" ORDER BY mic) FILTER (mic LIKE 'U%') AS sums, list(o ORDER BY mic) FILTER (mic LIKE 'U%') AS origins, list("start" * 2 ORDER BY mic) FILTER (mic LIKE 'U%') AS doubles FROM clocks GROUP BY utt)
SELECT utt, coalesce(sums, []) AS sums, coalesce(origins, []) AS origins, coalesce(doubles, []) AS doubles, [utt] AS listed FROM g"""


def deep_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level trees: mapped, combined leaf by leaf, and a shallow tree spread over a deep one."""
    c = clocks(spark, sf_dir)
    kind = c.schema["start"].dataType
    shallow = F.struct(F.lit(1).alias("observation"), F.lit(2).alias("worn"), F.lit(3).alias("original"))
    spread = nested.broadcast_tree(shallow, c.select(shallow.alias("x")).schema["x"].dataType, F.col("start"), kind)
    got = c.select("utt", nested.map_tree(F.col("start"), kind, lambda v: v * 2).alias("doubled"), nested.map_trees(F.col("start"), F.col("end"), kind, lambda a, b: a + b).alias("total"), spread.alias("spread"))
    return leaves(got, "doubled", "total", "spread")


Q["tree_map_deep"] = deep_trees
S["tree_map_deep"] = f"""WITH {CLOCKS} SELECT utt, mic, 2 * "start" AS doubled, "start" + "end" AS total, CASE WHEN mic LIKE 'U%' THEN 1 ELSE 2 END AS spread FROM clocks
UNION ALL SELECT DISTINCT utt, 'original', 2 * o, 2 * o + od, 3 FROM clocks"""

QUERIES, ORACLES = Q, S
