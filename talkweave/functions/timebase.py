"""Time on one or several sample clocks.

A multi-clock time is ``struct<observation: map<string,bigint>, worn:
map<string,bigint>, original: bigint>``, one entry a microphone; a single-clock
time is a bigint.  Samples are bigints, never floating point.  Nulls give
nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 16000
BRANCHES = ("observation", "worn")


def _quotient(a: Column, b: int) -> Column:
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("bigint")), F.lit(b).cast("bigint"))


def to_samples(text: Column, rate: int = RATE) -> Column:
    """``H:M:S.f`` as samples, exactly; hours are unbounded; a time between two samples raises."""
    part = F.split(text, ":")
    seconds = (F.element_at(part, 1).cast("bigint") * 3600 + F.element_at(part, 2).cast("bigint") * 60).cast("decimal(20,0)")
    exact = (seconds + F.element_at(part, 3).cast("decimal(20,7)")) * F.lit(rate).cast("decimal(10,0)")
    whole = exact.cast("bigint")
    return F.when(exact == whole, whole).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a whole sample: "), text)).cast("bigint"))


def samples_to_text(samples: Column, rate: int = RATE) -> Column:
    """``H:MM:SS.mmm`` of a number of samples, cut to milliseconds."""
    ms = _quotient(samples * 1000, rate)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(_quotient(ms, 3600000).cast("string"), F.lit(":"), pad(F.pmod(_quotient(ms, 60000), F.lit(60)), 2), F.lit(":"), pad(F.pmod(_quotient(ms, 1000), F.lit(60)), 2), F.lit("."), pad(F.pmod(ms, F.lit(1000)), 3))


def map_to_samples(times: Column, rate: int = RATE) -> Column:
    """All entries of a ``map<string,string>`` of times."""
    return F.transform_values(times, lambda _, v: to_samples(v, rate))


def clocks(times: Column) -> Column:
    """A flat map of clocks (``original``, ``U..`` arrays, ``P..`` speakers) as the multi-clock struct."""
    return F.struct(
        F.map_filter(times, lambda k, _: k.startswith("U")).alias("observation"),
        F.map_filter(times, lambda k, _: k.startswith("P")).alias("worn"),
        F.element_at(times, "original").alias("original"),
    )


def duration(start: Column, end: Column) -> Column:
    """``end - start`` of each clock of two multi-clock times; a clock of only one of them gives null."""
    return F.struct(
        *(F.map_zip_with(start[b], end[b], lambda _, s, e: e - s).alias(b) for b in BRANCHES),
        (end["original"] - start["original"]).alias("original"),
    )


def adjusted(start: Column, end: Column, original: Column) -> tuple[Column, Column]:
    """An interval made as long as ``original``: half of the difference at the start, the greater half at the end."""
    delta = original - (end - start)
    size, sign = F.abs(delta), F.signum(delta).cast("bigint")
    half = F.call_function("div", size, F.lit(2).cast("bigint"))
    return start - sign * half, end + sign * (size - half)


def adjust_start_end(df: DataFrame, worn: bool = False) -> DataFrame:
    """Multi-clock ``start`` and ``end`` with every array's interval made as long as the original one (worn ones too if asked)."""
    length = F.col("end.original") - F.col("start.original")
    new = {"start": {}, "end": {}}
    for b in BRANCHES:
        s, e = F.col(f"start.{b}"), F.col(f"end.{b}")
        if b == "observation" or worn:
            new["start"][b] = F.map_zip_with(s, e, lambda _, x, y: adjusted(x, y, length)[0])
            new["end"][b] = F.map_zip_with(s, e, lambda _, x, y: adjusted(x, y, length)[1])
        else:
            new["start"][b], new["end"][b] = s, e
    out = {at: F.struct(*(new[at][b].alias(b) for b in BRANCHES), F.col(f"{at}.original").alias("original")) for at in new}
    df = df.withColumns(out)
    return df.withColumn("num_samples", duration(F.col("start"), F.col("end")))


def backup(df: DataFrame) -> DataFrame:
    """Keeps times as ``*_orig``; to be called after the adjustment."""
    return df.withColumns({f"{c}_orig": F.col(c) for c in ("start", "end", "num_samples") if c in df.columns})


def _context(samples: int | tuple[int, ...]) -> tuple[int, int]:
    before, after = (samples, samples) if isinstance(samples, int) else (samples[0], samples[-1])
    if before < 0 or after < 0:
        raise ValueError("a context isn't negative")
    return before, after


def add_context_flat(df: DataFrame, samples: int | tuple[int, ...]) -> DataFrame:
    """Single-clock ``start``, ``end``, ``num_samples`` widened; the start stops at 0, the end is unbounded."""
    before, after = _context(samples)
    df = df.withColumns({"start": F.greatest(F.col("start") - before, F.lit(0).cast("bigint")), "end": F.col("end") + after})
    return df.withColumn("num_samples", F.col("end") - F.col("start"))


def add_context(df: DataFrame, samples: int | tuple[int, ...] | dict[str, int | tuple[int, ...]], equal_start: bool = False) -> DataFrame:
    """Multi-clock times widened on every clock, by branch if a dict is given; with ``equal_start`` all clocks use the least context that any gets."""
    per = samples if isinstance(samples, dict) else {b: samples for b in (*BRANCHES, "original")}
    got = {b: _context(per.get(b, 0)) for b in (*BRANCHES, "original")}
    zero = F.lit(0).cast("bigint")

    def reached(s: Column, n: int) -> Column:
        return F.least(s, F.lit(n).cast("bigint"))

    least = None
    if equal_start:
        leaf = [_each(F.map_values(F.col(f"start.{b}")), lambda s, b=b: reached(s, got[b][0])) for b in BRANCHES]
        leaf.append(F.array(reached(F.col("start.original"), got["original"][0])))
        least = F.array_min(F.concat(*(F.coalesce(x, F.array().cast("array<bigint>")) for x in leaf)))

    def begin(s: Column, b: str) -> Column:
        return s - least if least is not None else F.greatest(s - got[b][0], zero)

    def branch(at: str, b: str) -> Column:
        return F.transform_values(F.col(f"{at}.{b}"), (lambda _, s: begin(s, b)) if at == "start" else (lambda _, e: e + got[b][1])).alias(b)

    start = F.struct(*(branch("start", b) for b in BRANCHES), begin(F.col("start.original"), "original").alias("original"))
    end = F.struct(*(branch("end", b) for b in BRANCHES), (F.col("end.original") + got["original"][1]).alias("original"))
    df = df.withColumns({"start": start, "end": end})
    return df.withColumn("num_samples", duration(F.col("start"), F.col("end")))


def _each(array: Column, fn: Callable[..., Column]) -> Column:
    return F.transform(array, lambda x: fn(x))


def without_context(signal: Column, start: Column, start_orig: Column, num_samples_orig: Column) -> Column:
    """The part of an array that the utterance had before its context was added."""
    return F.slice(signal, (start_orig - start + 1).cast("int"), num_samples_orig.cast("int"))


def speaker_times(df: DataFrame) -> DataFrame:
    """(session, speaker, mic, start, end): a row for each microphone of each transcript row; rows without speaker are left out.

    ``df`` has session, speaker and maps start, end by microphone.
    """
    rows = df.where("speaker is not null").select("session", "speaker", F.explode(F.map_zip_with("start", "end", lambda _, s, e: F.struct(s.alias("start"), e.alias("end")))).alias("mic", "t"))
    return rows.select("session", "speaker", "mic", "t.start", "t.end")
