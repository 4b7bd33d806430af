"""Aggregations over activity and recognition results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv
from . import overlap as ov


def grouped(df: DataFrame, key: str, position: str, *columns: str) -> DataFrame:
    """(key, items): the rows of each key as an array in the order of ``position``."""
    items = F.sort_array(F.collect_list(F.struct(position, *columns)))
    return df.groupBy(key).agg(F.transform(items, lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("items"))


def activity_ratio(df: DataFrame, width: int | None = None) -> DataFrame:
    """(session, speaker, ratio): share of the time between the session's first and last activity; speaker null: of anyone."""
    per = iv.normalise(df, ["session", "speaker"]).groupBy("session", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("on"), F.min("start").alias("lo"), F.max("end").alias("hi"))
    any_ = iv.normalise(df, ["session"], width=width).groupBy("session").agg(F.sum(F.col("end") - F.col("start")).alias("on"))
    span = per.groupBy("session").agg((F.max("hi") - F.min("lo")).alias("span"))
    both = per.select("session", F.col("speaker").cast("string").alias("speaker"), "on").unionByName(any_.select("session", F.lit(None).cast("string").alias("speaker"), "on"))
    return both.join(span, "session").select("session", "speaker", (F.col("on") / F.col("span")).alias("ratio"))


def overlap_per_utterance(df: DataFrame, width: int = ov.HOUR_US) -> DataFrame:
    """(session, utt, length, overlap): how much of each utterance is also spoken in by another speaker of its session.

    No pairs are listed, so the cost doesn't grow with how many speak at once. Within an utterance its own speaker is
    active, so another one is where two speakers or more are. These stretches are measured from each bucket's begin
    by running sums; an utterance's overlap is the difference of the measure at its ends, bucket by bucket.
    """
    own = iv.proper(df).select("session", "speaker", "utt", "start", "end")
    several = iv.concurrency(iv.normalise(own, ["session", "speaker"]), ["session"], width).where("n > 1")
    several, cut = (iv.split(x, width) for x in (several.select("session", "start", "end"), own.select("session", "utt", "start", "end")))
    none = F.lit(None).cast(df.schema["utt"].dataType)
    steps = [(F.col("start"), F.lit(1), none, F.lit(0)), (F.col("end"), F.lit(-1), none, F.lit(0))]
    asked = [(F.col("start"), F.lit(0), F.col("utt"), F.lit(-1)), (F.col("end"), F.lit(0), F.col("utt"), F.lit(1))]
    events = lambda x, ends: x.select("session", "_b", F.inline(F.array(*(F.struct(a.alias("at"), d.alias("d"), u.alias("utt"), s.alias("sign")) for a, d, u, s in ends))))
    every = events(several, steps).unionByName(events(cut, asked))
    upto = Window.partitionBy("session", "_b").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    measure = F.col("at") * F.sum("d").over(upto) - F.sum(F.col("d") * F.col("at")).over(upto)
    overlap = every.withColumn("m", F.col("sign") * measure).where("utt is not null").groupBy("session", "utt").agg(F.sum("m").cast("bigint").alias("overlap"))
    length = own.select("session", "utt", (F.col("end") - F.col("start")).alias("length"))
    return length.join(overlap, ["session", "utt"])


def overlap_summary(per: DataFrame) -> DataFrame:
    """Per session: utterances, overlapped ones, their share, least, mean and greatest overlap of these."""
    hit = F.col("overlap") > 0
    return per.groupBy("session").agg(
        F.count("*").alias("n"), F.count_if(hit).alias("n_overlapped"), (F.count_if(hit) / F.count("*")).alias("share"),
        F.min(F.when(hit, F.col("overlap"))).alias("least"), F.max("overlap").alias("most"), F.sum("overlap").alias("total"),
    )


def overlap_histogram(per: DataFrame) -> DataFrame:
    """(session, bin, n): overlapped share of utterances in bins 0, 10, .. 90 (a whole one is in 90); none at all is bin -1."""
    tenth = F.call_function("div", F.col("overlap") * 10, F.col("length")) * 10
    bin_ = F.when(F.col("overlap") == 0, F.lit(-1)).otherwise(F.least(tenth, F.lit(90))).cast("bigint")
    return per.groupBy("session", bin_.alias("bin")).agg(F.count("*").alias("n"))


def exactly_one(df: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """Stretches in which exactly one interval of the key is active."""
    return iv.concurrency(df, keys, width).where("n = 1").drop("n")


def window_percentage(df: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """(keys, active, share) within ``[low, high)``."""
    got = iv.clip(iv.normalise(df, keys), low, high).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("active"))
    return got.withColumn("share", F.col("active") / F.lit(high - low))


def session_speakers(df: DataFrame) -> DataFrame:
    return df.groupBy("session").agg(F.sort_array(F.collect_set("speaker")).alias("speakers"))


def consistent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value): the one value of each key; several raise."""
    got = df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_hi"))
    same = F.when(F.col(value).eqNullSafe(F.col("_hi")), F.col(value)).otherwise(F.raise_error(F.lit(f"several values of {value}")))
    return got.select(*keys, same.cast(df.schema[value].dataType).alias(value))


def flag_extremes(df: DataFrame, *columns: str) -> DataFrame:
    """Adds ``<c>_is_min`` and ``<c>_is_max``: compared with one row of totals, so that no window holds all rows."""
    ends = df.agg(F.struct(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns)).alias("_e")).scalar()
    return df.withColumns({f"{c}_is_{e}": F.col(c) == ends[c][at] for e, at in (("min", "lo"), ("max", "hi")) for c in columns})


def score_sweep(logs: DataFrame, scores: DataFrame, least: int = 8, most: int = 18) -> DataFrame:
    """A row for each of ``logs`` (log) and weight from ``least`` to ``most``: its scores (log, weight, wer, ..), null where there are none."""
    weights = F.explode(F.sequence(F.lit(least).cast("bigint"), F.lit(most).cast("bigint")))
    every = logs.select("log").distinct().select("log", weights.alias("weight"))
    return every.join(scores.withColumn("weight", F.col("weight").cast("bigint")), ["log", "weight"], "left")


def best_score(scores: DataFrame) -> DataFrame:
    """The row of least word error rate (ties: least weight, then the other columns in their order); rows without a score don't count."""
    cols = scores.columns
    order = ["wer", "weight", *(c for c in cols if c not in ("wer", "weight"))]
    return scores.where("wer is not null").agg(F.min(F.struct(*order)).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in cols))


def missing_annotations(utts: DataFrame, annotated: DataFrame) -> DataFrame:
    """(session, missing, n, n_missing); more than half of a session's utterances missing raises. Utterances count once."""
    left = utts.select("session", "utt").distinct().join(annotated.select("utt").distinct().withColumn("_hit", F.lit(1)), "utt", "left")
    gone = F.col("_hit").isNull() & F.col("utt").isNotNull()
    # each utterance is one row by now, so that a session's task gets counts and the missing ones alone
    per = left.groupBy("session").agg(F.sort_array(F.collect_list(F.when(gone, F.col("utt")))).alias("missing"), F.count("utt").alias("n"), F.count_if(gone).alias("n_missing"))
    too_many = F.col("n_missing") > F.call_function("div", F.col("n"), F.lit(2).cast("bigint"))
    return per.withColumn("n_missing", F.when(too_many, F.raise_error(F.lit("too many annotations are missing")).cast("bigint")).otherwise(F.col("n_missing")))


def word_errors(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Adds ``errors`` (word edit distance) and ``words``: the distance's row is folded over the reference on the JVM."""
    ref, hyp = (F.filter(F.split(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+"), lambda w: w != "") for c in (reference, hypothesis))

    def step(row: Column, word: Column) -> Column:
        first = F.get(row, F.lit(0)) + 1
        cells = F.arrays_zip(F.slice(row, F.lit(1), F.size(row) - 1).alias("diag"), F.slice(row, F.lit(2), F.size(row) - 1).alias("up"), F.col("_h").alias("w"))
        return F.aggregate(
            cells, F.array(first),
            lambda acc, c: F.concat(acc, F.array(F.least(F.element_at(acc, -1) + 1, c["up"] + 1, c["diag"] + F.when(c["w"] == word, 0).otherwise(1)))),
        )

    with_words = df.withColumns({"_r": ref, "_h": hyp})
    start = F.transform(F.sequence(F.lit(0), F.size("_h")), lambda i: i)
    return with_words.withColumn("errors", F.element_at(F.aggregate(F.col("_r"), start, step), -1)).withColumn("words", F.size("_r")).drop("_r", "_h")
