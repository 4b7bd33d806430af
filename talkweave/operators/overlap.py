"""Overlap joins of intervals.

Spark has no range join: without an equality it compares all with all, and with
a coarse one (a session) nearly so.  Here every interval goes into the buckets
of width ``width`` that it touches, the join is on (key, bucket), and a pair
counts in the one bucket where its common part begins.  ``width`` should be of
the order of a typical interval; rows grow by length / width.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runs

HOUR_US = 3_600_000_000


def _bucketed(df: DataFrame, width: int, closed: bool) -> DataFrame:
    last = F.col("end") if closed else F.col("end") - 1
    held = df.where(F.col("start") <= last)
    return held.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(last / width))))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int, closed: bool = False, extra: Column | None = None) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` (columns of the latter with ``_r``) whose intervals overlap; ``closed`` counts touching ends.

    The common part is (overlap_start, overlap_end). ``extra`` is a further condition on both rows.
    """
    right = b.select(*(F.col(c).alias(c if c in keys else f"{c}_r") for c in b.columns))
    left = _bucketed(a, width, closed)
    right = _bucketed(right.withColumnsRenamed({"start_r": "start", "end_r": "end"}), width, closed).withColumnsRenamed({"start": "start_r", "end": "end_r"})
    both = left.join(right, [*keys, "_b"])
    begin, finish = F.greatest("start", "start_r"), F.least("end", "end_r")
    met = begin <= finish if closed else begin < finish
    both = both.where(met & (F.col("_b") == F.floor(begin / width)))
    if extra is not None:
        both = both.where(extra)
    return both.withColumns({"overlap_start": begin, "overlap_end": finish}).drop("_b")


def cross_talk(activity: DataFrame, width: int = HOUR_US, symmetric: bool = False) -> DataFrame:
    """Overlapping utterances of different speakers of a session, touching ones included; each pair once unless ``symmetric``."""
    order = F.col("speaker") != F.col("speaker_r") if symmetric else F.col("speaker") < F.col("speaker_r")
    return overlap_join(activity, activity, ["session"], width, closed=True, extra=order)


def window_slice(activity: DataFrame, windows: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Activity within each window, clamped to it and counted from its start: windows have (keys, window_id, start, end)."""
    met = overlap_join(windows, activity, keys, width)
    return met.select(*windows.drop("start", "end").columns, *(c for c in met.columns if c.endswith("_r") and c not in ("start_r", "end_r")), (F.col("overlap_start") - F.col("start")).alias("start"), (F.col("overlap_end") - F.col("start")).alias("end"))


def _ranges(lo: np.ndarray, hi: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all ``lo[i] <= j < hi[i]``, some ``most`` pairs at a time."""
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        k = n[at:to]
        i = np.repeat(np.arange(at, to), k)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[at:to], k)
        at = to


def _pair_totals(speaker: np.ndarray, start: np.ndarray, end: np.ndarray, side: np.ndarray, alone: bool, cells: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, n, length) of pairs of speakers of both sides (or of the one side, with another speaker) whose closed intervals meet.

    Speakers are numbered in their order. A few of one side are worked on at a time, so that their pairs with all of
    the other fit into ``cells``.
    """
    order = np.lexsort((start, speaker))
    speaker, start, end, side = speaker[order], start[order], end[order], side[order]
    left, right = (np.ones(len(side), bool),) * 2 if alone else (side == 0, side == 1)
    rid, rcode = np.unique(speaker[right], return_inverse=True)
    by = np.argsort(start[right], kind="stable")
    rs, re, rc = start[right][by], end[right][by], rcode[by]
    ls, le, lsp = start[left], end[left], speaker[left]
    lid, lfirst = np.unique(lsp, return_index=True)
    lfirst = np.append(lfirst, len(lsp))
    few = max(1, cells // max(1, len(rid)))
    for k in range(0, len(lid), few):
        lo, hi = lfirst[k], lfirst[min(k + few, len(lid))]
        own = np.argsort(ls[lo:hi], kind="stable") + lo
        s, e, c = ls[own], le[own], np.searchsorted(lid[k : k + few], lsp[own])
        shape = min(few, len(lid) - k) * len(rid)
        n, length = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        # the right one begins within the left one, or the left one within the right one and later
        first = _ranges(np.searchsorted(rs, s, "left"), np.searchsorted(rs, e, "right"), cells)
        second = _ranges(np.searchsorted(s, rs, "right"), np.searchsorted(s, re, "right"), cells)
        for i, j in first:
            _add(n, length, c[i] * len(rid) + rc[j], np.minimum(e[i], re[j]) - rs[j])
        for j, i in second:
            _add(n, length, c[i] * len(rid) + rc[j], np.minimum(e[i], re[j]) - s[i])
        found = np.flatnonzero(n)
        a, b = lid[k + found // len(rid)], rid[found % len(rid)]
        keep = a < b if alone else a != b
        found, a, b = found[keep], a[keep], b[keep]
        yield np.minimum(a, b), np.maximum(a, b), n[found], length[found]


def _add(n: np.ndarray, length: np.ndarray, cell: np.ndarray, common: np.ndarray) -> None:
    """Counts and sums by cell; sums of doubles are exact below 2^53, so lengths go in two halves."""
    if not len(cell):
        return
    n += np.bincount(cell, minlength=len(n))
    if int(common.max()) * len(cell) < 2**53:
        length += np.bincount(cell, common, len(n)).astype(np.int64)
    else:
        np.add.at(length, cell, common)


def cross_talk_totals(activity: DataFrame, parts: int = 8, cells: int = 1 << 20) -> DataFrame:
    """(session, speaker, speaker_r, n, overlap_us): ``cross_talk`` summed by pair of speakers, without a row for each pair of utterances.

    A session's speakers are dealt into ``parts``, and any two parts (or one by itself) meet in one task: rows are sent
    ``parts`` times, and the pairs of utterances, which grow with the square of how many speak at once, are counted where
    they are found, so that they are neither shuffled nor held.
    """
    rows = activity.where("start <= end").where(F.col("session").isNotNull() & F.col("speaker").isNotNull())
    own = F.pmod(F.xxhash64("session", "speaker"), F.lit(parts)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = rows.select("session", "speaker", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), own.alias("_o")).select("*", other.alias("_p"))
    rows = rows.select("session", F.least("_o", "_p").alias("_i"), F.greatest("_o", "_p").alias("_j"), (F.col("_o") > F.col("_p")).cast("int").alias("_side"), "speaker", "start", "end")
    keys = ["session", "_i", "_j"]
    near = rows.repartition(4 * parts * (parts + 1) // 2, *keys).sortWithinPartitions(*keys)
    kinds = [rows.schema["session"], T.StructField("speaker", rows.schema["speaker"].dataType), T.StructField("speaker_r", rows.schema["speaker"].dataType), T.StructField("n", T.LongType()), T.StructField("overlap_us", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs.whole_groups(batches, keys, 1):
            at = np.append(runs.changes(t, keys), t.num_rows)
            for lo, hi in zip(at[:-1], at[1:]):
                g = t.slice(lo, hi - lo).combine_chunks()
                names = g["speaker"].unique()
                names = names.take(pc.array_sort_indices(names))
                code = pc.index_in(g["speaker"], names).to_numpy()
                for a, b, n, length in _pair_totals(code, g["start"].to_numpy(), g["end"].to_numpy(), g["_side"].to_numpy(), g["_i"][0] == g["_j"][0], cells):
                    for k in range(0, len(n), 1 << 16):
                        part = slice(k, k + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.repeat(g["session"][0], len(n[part])), names.take(pa.array(a[part])), names.take(pa.array(b[part])), pa.array(n[part]), pa.array(length[part])], [f.name for f in kinds])

    return near.mapInArrow(run, T.StructType(kinds))


def window_totals(activity: DataFrame, windows: DataFrame, width: int = HOUR_US) -> DataFrame:
    """(session, window_id, n, starts, ends): ``window_slice`` counted and summed by window, without a row for each slice.

    What begins before a window's end less what ends up to its begin is what meets it, and the same running counts and
    sums give the slices' starts and ends. They run within buckets of ``width``; what lies in earlier buckets is added.
    """
    wide = "decimal(38,0)"
    said = activity.where("start < end").select("session", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    asked = windows.where("start < end").select("session", "window_id", F.col("start").cast("bigint").alias("lo"), F.col("end").cast("bigint").alias("hi"))
    none, bucket = F.lit(None), F.floor(F.col("at") / width)
    point = lambda at, kind, s, e: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(s).alias("s"), F.lit(e).alias("e"))
    kinds = dict(windows.dtypes)
    facts = said.select("session", F.inline(F.array(point(F.col("start"), 1, 1, 0), point(F.col("end"), 1, 0, 1)))).withColumns({"window_id": none.cast(kinds["window_id"]), "lo": none.cast("bigint"), "hi": none.cast("bigint")})
    # at one time, a window's end comes before what begins and ends there, and its begin after that
    asks = asked.select("session", F.inline(F.array(point(F.col("hi"), 0, 0, 0), point(F.col("lo"), 2, 0, 0))), "window_id", "lo", "hi")
    points = facts.unionByName(asks).withColumn("_b", bucket).withColumn("_r", F.col("at") - F.col("_b") * width)
    upto = Window.partitionBy("session", "_b").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"_{c}{k}": F.sum(v).over(upto) for c in "se" for k, v in (("n", F.col(c).cast("bigint")), ("t", F.col(c) * F.col("_r")))}
    near = points.withColumns(sums).where("kind <> 1")
    per = facts.withColumn("_b", bucket).groupBy("session", "_b").agg(*(F.sum(v).alias(f"{c}{k}") for c in "se" for k, v in (("n", F.col(c).cast("bigint")), ("t", F.col(c) * F.col("at").cast("decimal(20,0)")))))
    # buckets with windows alone count too
    per = per.unionByName(asks.select("session", bucket.alias("_b")).distinct(), allowMissingColumns=True).groupBy("session", "_b").agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("sn", "st", "en", "et")))
    before = Window.partitionBy("session").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("session", "_b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).cast(wide).alias(c) for c in ("sn", "st", "en", "et")))
    both = near.join(base, ["session", "_b"])
    dec = lambda c: F.col(c).cast("decimal(20,0)")
    both = both.withColumns({f"{c}k": (F.col(f"{c}n") + F.col(f"_{c}n")).cast("bigint") for c in "se"})
    both = both.withColumns({f"{c}a": (F.col(f"{c}t") + dec(f"_{c}n") * dec("_b") * F.lit(width).cast("decimal(14,0)") + F.col(f"_{c}t")).cast(wide) for c in "se"})
    lo, hi, s, e, total_s, total_e = dec("lo"), dec("hi"), dec("sk"), dec("ek"), F.col("sa"), F.col("ea")
    last = F.col("kind") == 0
    got = both.select("session", "window_id", F.when(last, F.col("sk")).otherwise(-F.col("ek")).alias("n"), F.when(last, total_s - lo * s).otherwise(lo * s - total_s).cast(wide).alias("starts"), F.when(last, total_e + hi * (s - e) - lo * s).otherwise(lo * e - total_e).cast(wide).alias("ends"))
    return got.groupBy("session", "window_id").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("n", "starts", "ends"))).where("n > 0")
