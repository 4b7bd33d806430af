"""Views of the supplied tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    since = F.col(column).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(18,6)") * 1000000).cast("bigint")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterance-like intervals: session, speaker, start, end (microseconds), utt."""
    e = table(spark, sf_dir, "events")
    start = micros("ts")
    return e.select(
        F.col("event_type").alias("session"), F.col("user_id").alias("speaker"), start.alias("start"),
        (start + F.floor(F.col("value") * 60000000)).alias("end"), F.col("event_id").alias("utt"),
    )


ACTIVITY = """activity AS (SELECT event_type AS session, user_id AS speaker, epoch_us(ts) AS "start",
  epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS "end", event_id AS utt FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns laid end to end: session, speaker, pos, start, end, transcription; system turns play the redacted ones."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    before = F.coalesce(F.sum(n).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    words = F.when(F.col("role") == "system", F.lit("[redacted]")).otherwise(F.col("text"))
    return c.select(F.concat(F.lit("S"), F.col("conv_id").cast("string")).alias("session"), F.col("role").alias("speaker"), F.col("turn").alias("pos"), before.alias("start"), (before + n).alias("end"), words.alias("transcription"))


TURNS = """turns AS (SELECT 'S' || conv_id AS session, role AS speaker, turn AS pos, b AS "start", b + n AS "end",
    CASE WHEN role = 'system' THEN '[redacted]' ELSE text END AS transcription
  FROM (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
    FROM (SELECT *, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM conversations)))"""


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-clock times, one row an order: odd lines are arrays, even ones speakers' microphones."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("s"), F.max("l_quantity").cast("bigint").alias("d"))
    pair = F.sort_array(F.collect_list(F.struct("l_linenumber", "s", "d")))
    per = rows.groupBy("l_orderkey").agg(pair.alias("p"), F.min("s").alias("o"), F.max("d").alias("od"))

    def branch(odd: int, letter: str, value) -> F.Column:  # noqa: ANN001
        own = F.filter("p", lambda x: x["l_linenumber"] % 2 == odd)
        return F.map_from_entries(F.transform(own, lambda x: F.struct(F.concat(F.lit(letter), F.lpad(x["l_linenumber"].cast("string"), 2, "0")).alias("k"), value(x).alias("v"))))

    def times(value, original) -> F.Column:  # noqa: ANN001
        return F.struct(branch(1, "U", value).alias("observation"), branch(0, "P", value).alias("worn"), original.alias("original"))

    return per.select(F.col("l_orderkey").alias("utt"), times(lambda x: x["s"], F.col("o")).alias("start"), times(lambda x: x["s"] + x["d"], F.col("o") + F.col("od")).alias("end"))


CLOCKS = """mics AS (SELECT l_orderkey AS utt, l_linenumber AS line, min(l_partkey) AS s, CAST(max(l_quantity) AS BIGINT) AS d FROM lineitem GROUP BY ALL),
clocks AS (SELECT m.utt, CASE WHEN line % 2 = 1 THEN 'U' ELSE 'P' END || lpad(CAST(line AS VARCHAR), 2, '0') AS mic, s AS "start", s + d AS "end", o, od
  FROM mics m JOIN (SELECT utt, min(s) AS o, max(d) AS od FROM mics GROUP BY utt) g ON m.utt = g.utt)"""


def leaves(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each microphone of multi-clock columns: utt, mic and the columns' values, also ``original``."""
    out = None
    for b in ("observation", "worn"):
        first = F.explode(F.col(f"{columns[0]}.{b}"))
        part = df.select("utt", first.alias("mic", columns[0]), *(F.col(f"{c}.{b}").alias(f"_{c}") for c in columns[1:]))
        part = part.select("utt", "mic", columns[0], *(F.element_at(F.col(f"_{c}"), F.col("mic")).alias(c) for c in columns[1:]))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(df.select("utt", F.lit("original").alias("mic"), *(F.col(f"{c}.original").alias(c) for c in columns)))
