"""Frames: sliding windows over sample time, computed on intervals.

Frame t covers ``[t * shift, t * shift + length)``.  Integer arithmetic with
floor division throughout (``floor`` on exact values), never a dense array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals as iv




def _floor(a: Column, b: int) -> Column:
    """Floor of a / b for any sign of a, exact on 64-bit integers."""
    whole = F.lit(b).cast("bigint")
    return F.call_function("div", a - F.pmod(a, whole), whole)


def frame_count(samples: Column, length: int, shift: int, pad: bool = True) -> Column:
    """Frames of a signal: padded (one at least, a last partial one counts) or cut (whole ones only)."""
    over = samples - length
    padded = F.when(over < 0, F.lit(1)).otherwise(_floor(over + (shift - 1), shift) + 1)
    cut = F.when(over < 0, F.lit(0)).otherwise(_floor(over, shift) + 1)
    return (padded if pad else cut).cast("bigint")


def active_frames(df: DataFrame, keys: Sequence[str], length: int, shift: int, fading: bool = False, frames: Column | None = None) -> DataFrame:
    """(keys, frame) of the frames in which any sample is active; ``fading`` counts from ``length - shift`` samples earlier."""
    ranges = frame_ranges(df, keys, length, shift, fading, frames)
    return ranges.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("frame"))


def frame_ranges(df: DataFrame, keys: Sequence[str], length: int, shift: int, fading: bool = False, frames: Column | None = None) -> DataFrame:
    """The same as disjoint frame intervals: the form to keep at scale."""
    pad = length - shift if fading else 0
    low = F.greatest(_floor(F.col("start") + F.lit(pad) - length, shift) + 1, F.lit(0).cast("bigint"))
    high = _floor(F.col("end") + F.lit(pad) - 1, shift) + 1
    if frames is not None:
        high = F.least(high, frames)
    own = iv.proper(df).select(*keys, low.alias("start"), high.alias("end"))
    return iv.normalise(own, keys)


def frames_to_samples(df: DataFrame, keys: Sequence[str], length: int, shift: int, time_length: int | None = None) -> DataFrame:
    """Sample intervals that the frames (column frame) cover, cut at ``time_length``."""
    spans = df.select(*keys, (F.col("frame") * shift).cast("bigint").alias("start"), (F.col("frame") * shift + length).cast("bigint").alias("end"))
    out = iv.normalise(spans, keys)
    return out if time_length is None else iv.clip(out, 0, time_length)


def decimated(df: DataFrame, keys: Sequence[str], start: int, end: int, step: int) -> DataFrame:
    """Index ranges ``[from, to)`` of active entries of an array that has one entry per ``step`` samples of ``[start, end)``."""
    size = (end - start) // step
    met = df.where((F.col("start") <= end) & (F.col("end") >= start))
    low = _floor(F.greatest(F.col("start") - start, F.lit(0).cast("bigint")), step)
    high = F.least(_floor(F.col("end") - start, step), F.lit(size).cast("bigint"))
    return iv.normalise(met.select(*keys, low.alias("start"), high.alias("end")), keys)


def alignment_to_samples(df: DataFrame, keys: Sequence[str], length: int, shift: int) -> DataFrame:
    """Frames of an alignment as sample intervals, centred in (or cut to) the target length.

    ``df`` has (keys, frame, n_frames, n_samples).
    """
    total = F.col("n_frames") * shift + (length - shift)
    delta = _floor(F.col("n_samples") - total, 2)
    spans = df.select(*keys, "n_samples", (F.col("frame") * shift + delta).cast("bigint").alias("start"), (F.col("frame") * shift + length + delta).cast("bigint").alias("end"))
    clipped = iv.clip(spans, F.lit(0).cast("bigint"), F.col("n_samples"))
    return iv.normalise(clipped, keys)


def context_frames(samples: Column, length: int, shift: int, fading: bool = True) -> Column:
    """Frames that lie wholly within a context of so many samples."""
    pad = length - shift if fading else 0
    return F.greatest(_floor(samples + F.lit(pad) - length, shift) + 1, F.lit(0).cast("bigint"))
