"""Sets of half-open integer intervals ``[start, end)`` kept as rows.

A set is all rows that share the key columns.  Empty and reversed intervals
hold nothing and are dropped; touching intervals merge.  A null start or end
drops the row, a null key is a key of its own.  Nothing here ever expands an
interval into its points.

A key with very many intervals (a long session) would be one task.  With a
``width`` the intervals are cut at multiples of it, the work is done for each
(key, bucket), and only the rows that touch a bucket's border go through a
second step by key, at most two a bucket; all others pass straight through.
The result is the same.  ``width`` should be well above a typical length, as
rows grow by length / width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def proper(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows that hold at least one point."""
    return df.where(F.col(start) < F.col(end))


def split(df: DataFrame, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals cut at multiples of ``width``, with the bucket of each piece in ``_b``."""
    bucket = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    cut = proper(df, start, end).withColumn("_b", bucket)
    return cut.withColumns({start: F.greatest(start, F.col("_b") * width), end: F.least(end, (F.col("_b") + 1) * width)})


def _inner(width: int) -> Column:
    """Whether a row of a bucket touches none of its borders."""
    return (F.pmod(F.col("start"), F.lit(width)) != 0) & (F.pmod(F.col("end"), F.lit(width)) != 0)


def normalise(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """Sorted, disjoint, non-touching intervals of each key: one exchange, one sort (with ``width`` a small second one).

    Range frames make rows of equal start peers, so ties can't split an interval.
    """
    if width:
        named = df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end"))
        merged = normalise(split(named, width), [*keys, "_b"]).drop("_b")
        whole = merged.where(_inner(width)).unionByName(normalise(merged.where(~_inner(width)), keys))
        return whole.withColumnsRenamed({"start": start, "end": end})
    w = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(w.rangeBetween(Window.unboundedPreceding, -1))
    flagged = proper(df, start, end).select(*keys, start, end).withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    island = flagged.withColumn("_island", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def union(keys: Sequence[str], *sets: DataFrame, width: int | None = None) -> DataFrame:
    """Points in any of the sets; one normalisation at the end of the chain."""
    head, *rest = (s.select(*keys, "start", "end") for s in sets)
    for other in rest:
        head = head.unionByName(other)
    return normalise(head, keys, width=width)


def clip(df: DataFrame, low: Column | int, high: Column | int, rebase: bool = False) -> DataFrame:
    """What lies within ``[low, high)``; with ``rebase`` counted from ``low``."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    shift = low if rebase else F.lit(0)
    cut = df.withColumns({"start": F.greatest("start", low) - shift, "end": F.least("end", high) - shift})
    return proper(cut)


def clear(df: DataFrame, low: Column | int, high: Column | int) -> DataFrame:
    """What lies outside ``[low, high)``: true subtraction, so shared boundaries cut as well. An empty window takes nothing."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    parts = F.when(
        low < high,
        F.array(F.struct(F.col("start").alias("s"), F.least("end", low).alias("e")), F.struct(F.greatest("start", high).alias("s"), F.col("end").alias("e"))),
    ).otherwise(F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))))
    cut = proper(df).withColumn("_p", F.explode(parts)).withColumns({"start": F.col("_p.s"), "end": F.col("_p.e")}).drop("_p")
    return proper(cut)


def _sweep(keys: Sequence[str], sides: Sequence[DataFrame], width: int | None = None) -> DataFrame:
    """Elementary pieces ``[start, end)`` of each key with n0, n1, ..: how many intervals of each side cover them.

    With ``width`` pieces are cut at its multiples too.
    """
    if width:
        sides, keys = [split(s.select(*keys, "start", "end"), width) for s in sides], [*keys, "_b"]
    step = [F.array(*(F.struct(F.col(at).alias("at"), *(F.lit(d if j == k else 0).alias(f"d{j}") for j in range(len(sides)))) for at, d in (("start", 1), ("end", -1)))) for k in range(len(sides))]
    parts = [proper(side).select(*keys, F.inline(step[k])) for k, side in enumerate(sides)]
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    steps = events.groupBy(*keys, "at").agg(*(F.sum(f"d{j}").alias(f"d{j}") for j in range(len(sides))))
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*keys, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), *(F.sum(f"d{j}").over(run).alias(f"n{j}") for j in range(len(sides)))).where("end is not null")


def _joined(pieces: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Touching pieces of equal ``value`` (disjoint within a key) put together."""
    w = Window.partitionBy(*keys).orderBy("start")
    same = (F.lag("end").over(w) == F.col("start")) & (F.lag(value).over(w) == F.col(value))
    marked = pieces.withColumn("_new", F.when(same, 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run", value).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def _levels(pieces: DataFrame, keys: Sequence[str], value: str, width: int | None) -> DataFrame:
    if not width:
        return _joined(pieces, keys, value)
    local = _joined(pieces, [*keys, "_b"], value).drop("_b")
    return local.where(_inner(width)).unionByName(_joined(local.where(~_inner(width)), keys, value))


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """Points in both sets of each key, by one sweep and no join."""
    both = _sweep(keys, (a, b), width).where("n0 > 0 and n1 > 0").withColumn("_on", F.lit(1))
    return _levels(both, keys, "_on", width).drop("_on")


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """Points of ``a`` that ``b`` doesn't have."""
    rest = _sweep(keys, (a, b), width).where("n0 > 0 and n1 = 0").withColumn("_on", F.lit(1))
    return _levels(rest, keys, "_on", width).drop("_on")


def concurrency(df: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """How many intervals cover each stretch: (keys, start, end, n), stretches of equal n joined, n = 0 left out."""
    pieces = _sweep(keys, (df,), width).withColumnRenamed("n0", "n").where("n > 0")
    return _levels(pieces, keys, "n", width).select(*keys, "n", "start", "end")


def runs(df: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """Run-length code: (keys, value, start, end) of stretches of equal ``value`` at successive positions."""
    w = Window.partitionBy(*keys).orderBy(position)
    same = F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.lag(position).over(w) == F.col(position) - 1)
    marked = df.withColumn("_new", F.when(same, 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, value, "_run").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end")).drop("_run")


def from_flags(df: DataFrame, keys: Sequence[str], flags: str) -> DataFrame:
    """Intervals where an ``array<boolean>`` column is true (nulls are false)."""
    rows = df.select(*keys, F.posexplode(F.col(flags)).alias("_at", "_on")).where("_on").withColumn("_at", F.col("_at").cast("bigint"))
    return runs(rows, keys, "_at", "_on").drop("_on")


def assign(df: DataFrame, flags: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """The set with ``[low, high)`` replaced by the flags of each key (their length must be ``high - low``)."""
    sized = flags.withColumn("_flags", F.when(F.size("flags") == high - low, F.col("flags")).otherwise(F.raise_error(F.lit("the flags don't fit the window")).cast("array<boolean>")))
    new = from_flags(sized, keys, "_flags").withColumns({"start": F.col("start") + low, "end": F.col("end") + low})
    return union(keys, clear(normalise(df, keys), low, high), new)


def encode(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key's set as text, ``"1:4, 5:20"``; a set without points has no row here."""
    items = F.sort_array(F.collect_list(F.struct("start", "end")))
    text = F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ", ")
    return normalise(df, keys).groupBy(*keys).agg(text.alias("intervals"))


def decode(df: DataFrame, keys: Sequence[str], text: str = "intervals") -> DataFrame:
    """Intervals from their text form; an empty or null text has none, anything malformed raises."""
    item = F.explode(F.split(F.trim(F.col(text)), r"\s*,\s*"))
    rows = df.where(F.trim(F.col(text)) != "").select(*keys, item.alias("_i"))
    good = F.col("_i").rlike(r"^-?\d+:-?\d+$")
    part = F.when(good, F.split("_i", ":")).otherwise(F.raise_error(F.concat(F.lit("no interval: "), F.col("_i"))).cast("array<string>"))
    return proper(rows.withColumn("_p", part).select(*keys, F.get("_p", F.lit(0)).cast("bigint").alias("start"), F.get("_p", F.lit(1)).cast("bigint").alias("end")))


def window(length: int | None, start: int | None, stop: int | None, step: int | None = None) -> tuple[int, int]:
    """A slice as ``(low, high)``: no step, ``0 <= start``, and nothing beyond ``length`` if there is one."""
    if step is not None:
        raise ValueError("a slice of intervals has no step")
    low = 0 if start is None else start
    high = length if stop is None else stop
    if high is None:
        raise ValueError("an unbounded set needs a stop")
    if low < 0 or high < 0 or (length is not None and max(low, high) > length):
        raise ValueError(f"[{low}, {high}) lies outside [0, {length})")
    return low, high


def noise_class(df: DataFrame, lengths: DataFrame, key: str, noise: bool | int | None, speaker: str = "speaker") -> DataFrame:
    """Adds noise classes to an activity table: True one that is always on, False one that never is, None none, k > 0 that many always on.

    ``lengths`` has (key, length). An always-off class is a class without intervals, so it adds no row; it is
    listed by ``classes``.
    """
    if noise is None or noise is False:
        return df
    if noise is not True and (not isinstance(noise, int) or noise <= 0):
        raise ValueError(f"no noise class {noise!r}")
    names = ["Noise"] if noise is True else [f"Noise{k}" for k in range(noise)]
    always = lengths.select(key, F.explode(F.array(*(F.lit(n) for n in names))).alias(speaker), F.lit(0).cast("bigint").alias("start"), F.col("length").cast("bigint").alias("end"))
    return df.select(key, F.col(speaker).cast("string").alias(speaker), "start", "end").unionByName(always)


def classes(df: DataFrame, key: str, noise: bool | int | None, speaker: str = "speaker") -> DataFrame:
    """(key, class_idx, speaker): the classes in their order, speakers first, then noise."""
    own = df.select(key, F.col(speaker).cast("string").alias(speaker)).distinct()
    per = own.groupBy(key).agg(F.sort_array(F.collect_list(speaker)).alias("_c"))
    names = [] if noise is None else ["Noise"] if isinstance(noise, bool) else [f"Noise{k}" for k in range(noise)]
    every = F.concat("_c", F.array(*(F.lit(n) for n in names)).cast("array<string>"))
    return per.select(key, F.posexplode(every).alias("class_idx", speaker))
