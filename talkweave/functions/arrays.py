"""Array reshaping as column expressions. Nulls give nulls."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zeros(n: Column, kind: str = "double") -> Column:
    return F.array_repeat(F.lit(0).cast(kind), F.greatest(n, F.lit(0)).cast("int"))


def pad_axis(x: Column, before: int, after: int, kind: str = "double") -> Column:
    return F.concat(zeros(F.lit(before), kind), x, zeros(F.lit(after), kind))


def pad_to(x: Column, size: int, kind: str = "double") -> Column:
    """Zeros at the end up to ``size``; a longer array raises."""
    return F.when(F.size(x) > size, F.raise_error(F.lit("the array is longer")).cast(f"array<{kind}>")).otherwise(F.concat(x, zeros(F.lit(size) - F.size(x), kind)))


def segments(x: Column, length: int, shift: int, end: str | None = "pad", kind: str = "double") -> Column:
    """Overlapping frames; ``end``: pad with zeros, cut, wrap round, conv_pad (all frames that touch, shift 1), or None (must fit).

    A negative shift gives the frames in reverse order.
    """
    step = abs(shift)
    if not step or length <= 0 or end not in ("pad", "cut", "wrap", "conv_pad", None):
        raise ValueError(f"no frames of {length} by {shift} with end {end}")
    if end == "conv_pad":
        if step != 1:
            raise ValueError("conv_pad goes with shift 1")
        x, end = pad_axis(x, length - 1, length - 1, kind), "cut"
    n = F.size(x)
    over = n - length
    short = F.when(over < 0, -over).otherwise(F.pmod(-over, F.lit(step)))
    if end == "pad":
        x = F.concat(x, zeros(short, kind))
    elif end == "wrap":
        x = F.concat(x, F.slice(x, F.lit(1), short.cast("int")))
    elif end is None:
        x = F.when(short > 0, F.raise_error(F.lit("the frames don't fit")).cast(f"array<{kind}>")).otherwise(x)
    last = F.call_function("div", F.size(x) - length, F.lit(step)).cast("int")
    frames = F.when(F.size(x) < length, F.array().cast(f"array<array<{kind}>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(x, i * step + 1, F.lit(length)))
    )
    return F.reverse(frames) if shift < 0 else frames


def segments_by_overlap(x: Column, length: int, overlap: int, end: str = "cut", kind: str = "double") -> Column:
    """The form that takes an overlap."""
    if not 0 <= overlap < length:
        raise ValueError("the overlap lies under the length")
    return segments(x, length, length - overlap, end, kind)


def roll_zeropad(x: Column, shift: int, kind: str = "double") -> Column:
    """Shifted with zeros filled in; beyond its length all zeros."""
    n = F.size(x)
    k = F.least(F.lit(abs(shift)), n)
    gap = zeros(k, kind)
    return F.concat(gap, F.slice(x, F.lit(1), n - k)) if shift >= 0 else F.concat(F.slice(x, k + 1, n - k), gap)


def one_hot(label: Column, classes: int) -> Column:
    """``classes`` booleans, true at the label."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: i == label)


class Cutter:
    """Cuts ``low`` items at the start and ``-high`` at the end, or puts them back as zeros."""

    def __init__(self, low: int | None, high: int | None):
        low, high = low or 0, high or 0
        if low < 0 or high > 0:
            raise ValueError("low >= 0 >= high")
        self.low, self.high = low, -high

    def cut(self, x: Column) -> Column:
        return F.slice(x, F.lit(self.low + 1), F.greatest(F.size(x) - (self.low + self.high), F.lit(0)))

    def expand(self, x: Column, kind: str = "double") -> Column:
        return pad_axis(x, self.low, self.high, kind)

    def overwrite(self, x: Column) -> Column:
        return F.transform(x, lambda v, i: F.when((i >= self.low) & (i < F.size(x) - self.high), v).otherwise(F.lit(0).cast("double")))


def context_stack(df: DataFrame, keys: list[str], order: str, value: str, left: int, right: int, symmetric: bool = True) -> DataFrame:
    """Adds ``stacked``: each frame's neighbours from ``left`` before to ``right`` after in one array of frames.

    At the edges the first or last frame repeats (``symmetric``) or null stands.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    edge = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(edge), F.last(value).over(edge)
    parts = []
    for k in range(-left, right + 1):
        got = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
        parts.append(F.coalesce(got, first if k < 0 else last) if symmetric else got)
    return df.withColumn("stacked", F.array(*parts))


def unstack_centre(stacked: Column, left: int) -> Column:
    return F.get(stacked, F.lit(left))


def split_complex(re: Column, im: Column) -> Column:
    """Real parts, then imaginary ones, in one array."""
    return F.concat(re, im)


def merge_complex(x: Column) -> Column:
    """Array of struct<re, im> from real parts followed by imaginary ones."""
    half = F.call_function("div", F.size(x), F.lit(2)).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: F.struct(a.alias("re"), b.alias("im")))


def reduce_axis(df: DataFrame, keep: list[str], value: str, how: str) -> DataFrame:
    """Named-axis reduction in long form: axes not in ``keep`` go; ``how``: sum, mean, median, min, max."""
    fn = {"sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[how]
    return df.groupBy(*keep).agg(fn(value).alias(value))


def flatten_axes(df: DataFrame, outer: str, inner: str, size: int, name: str) -> DataFrame:
    """Two index columns as one, row-major."""
    return df.withColumn(name, F.col(outer) * size + F.col(inner)).drop(outer, inner)


def unflatten_axis(df: DataFrame, name: str, size: int, outer: str, inner: str) -> DataFrame:
    """One index column as two, row-major."""
    return df.withColumns({outer: F.call_function("div", F.col(name), F.lit(size)), inner: F.pmod(F.col(name), F.lit(size))}).drop(name)


def morph(df: DataFrame, form: str, value: str, reduce: str | None = None, **sizes: int) -> DataFrame:
    """Reshapes long rows by a text such as ``ACTF->A*CTF`` or ``A*C->AC``: axes are index columns of one letter, ``A*C`` one row-major column.

    ``A*C`` on the right flattens (sizes of all but the first axis are needed), on the left it splits. ``1`` is an axis of
    one item: on the right a new column of zeros, on the left it has no column. An axis that only the left has is reduced
    (``reduce``: sum, mean, median, min, max), or without ``reduce`` must be of one item, else it raises. In long form a
    transposition is only another order of columns.
    """
    left, right = (re.findall(r"[A-Za-z1](?:\*[A-Za-z])*", side.replace(" ", "")) for side in form.split("->"))
    own, new = ([a for group in side for a in group.split("*") if a != "1"] for side in (left, right))
    if len(set(own)) < len(own) or len(set(new)) < len(new) or not set(new) <= set(own):
        raise ValueError(f"no reshaping {form!r}")
    for group in (g for g in left if "*" in g):
        rest, names = F.col(f"`{group}`").cast("bigint"), group.split("*")
        split = {}
        for a in reversed(names[1:]):
            split[a] = F.pmod(rest, F.lit(sizes[a]).cast("bigint"))
            rest = F.call_function("div", rest, F.lit(sizes[a]).cast("bigint"))
        df = df.withColumns({names[0]: rest, **split}).drop(group)
    gone = [a for a in own if a not in new]
    others = [c for c in df.columns if c not in (*own, value)]
    if gone and reduce:
        df = reduce_axis(df, [*others, *new], value, reduce)
    elif gone:
        longer = df.where(" or ".join(f"`{a}` <> 0" for a in gone)).agg((F.count("*") > 0).alias("b")).scalar()
        df = df.where(~F.when(longer, F.raise_error(F.lit(f"axes {gone} aren't of one item")).cast("boolean")).otherwise(F.lit(False))).drop(*gone)
    flat = []
    for k, group in enumerate(right):
        if group == "1":
            flat.append(F.lit(0).cast("bigint").alias(f"one{k}"))
            continue
        index, *names = group.split("*")
        index = F.col(index)
        for a in names:
            index = index * sizes[a] + F.col(a)
        flat.append(index.cast("bigint").alias(group))
    return df.select(*others, *flat, value)


def context_channels(df: DataFrame, keys: list[str], order: str, value: str, left: int, right: int, deltas: int = 1) -> DataFrame:
    """Frames of ``deltas`` blocks of features as (.., channel, height, width): ``stacked`` by block, then feature, then context frame."""
    got = context_stack(df, keys, order, value, left, right)
    size = F.call_function("div", F.size(value), F.lit(deltas)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(deltas - 1)), lambda c: F.transform(F.sequence(F.lit(0), size - 1), lambda h: F.transform("stacked", lambda x: F.get(x, c * size + h))))
    return got.withColumn("stacked", blocks)
