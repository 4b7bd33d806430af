"""The example catalog: one table of utterances with a ``dataset`` column and a small alias table."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkweave.sources import shared


def gate(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """``df``, which fails while running if any row is bad (null counts as good)."""
    check = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return df.where(check)


def gated_by(df: DataFrame, bad: DataFrame, message: str) -> DataFrame:
    """``df``, which fails while running if ``bad`` has a row: one flag, checked once a partition and not joined to rows."""
    flag = bad.agg((F.count("*") > 0).alias("_bad"))
    return df.where(~F.when(flag.select("_bad").scalar(), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(False)))


class Catalog:
    """Datasets and aliases over a table ``examples`` with columns example_id, dataset, ...; alias: (alias, dataset).

    The names (a row a dataset or alias, so few) are read once.
    """

    def __init__(self, examples: DataFrame, alias: DataFrame | None = None):
        self.examples, self.alias = examples, alias

    @cached_property
    def _aliases(self) -> dict[str, list[str]]:
        rows = [] if self.alias is None else self.alias.groupBy("alias").agg(F.sort_array(F.collect_set("dataset")).alias("datasets")).collect()
        return {r.alias: r.datasets for r in sorted(rows, key=lambda r: r.alias)}

    @cached_property
    def dataset_names(self) -> list[str]:
        """Datasets, then aliases."""
        return sorted(r[0] for r in self.examples.select("dataset").distinct().collect()) + list(self._aliases)

    def members(self, name: str) -> list[str]:
        return self._aliases.get(name, [name])

    def get_datasets(self, names: str | Sequence[str]) -> DataFrame:
        """UNION ALL of the named datasets: a name given twice gives its rows twice. An alias's rows carry the alias's name."""
        names = [names] if isinstance(names, str) else list(names)
        out = None
        for name in names:
            if name not in self._aliases and name not in self.dataset_names:
                known = self.dataset_names
                near = difflib.get_close_matches(name, known)
                raise KeyError(f"no dataset {name!r}; close: {near}; there are {known}")
            members = self.members(name)
            part = self.examples.where(F.col("dataset").isin(members))
            if len(members) > 1 or members != [name]:
                part = unique_ids(part).withColumn("dataset", F.lit(name))
            out = part if out is None else out.unionAll(part)
        if out is None:
            raise ValueError("no dataset named")
        return out

    def get_lengths(self, names: str | Sequence[str], fn: Callable[[Column], Column] = lambda n: n) -> DataFrame:
        """(example_id, length) with ``fn`` applied to num_samples (of a multi-clock one: its observation map)."""
        rows = self.get_datasets(names)
        multi = dict(rows.dtypes)["num_samples"].startswith("struct")
        return rows.select("example_id", fn(F.col("num_samples.observation" if multi else "num_samples")).alias("length"))


def unique_ids(df: DataFrame, key: str = "example_id") -> DataFrame:
    """``df``, which fails if a key occurs twice. Only the keys are counted; rows stay where they are."""
    twice = df.groupBy(key).count().where("count > 1").select(key).limit(1)
    return gated_by(df, twice, f"{key} isn't unique")


def not_redacted(df: DataFrame, column: str = "transcription") -> DataFrame:
    """Rows whose transcription isn't ``[redacted]``; a missing one raises."""
    return gate(df, F.col(column).isNull(), f"{column} is missing").where(F.col(column) != "[redacted]")


def id_filter(df: DataFrame, ids: DataFrame | Iterable[str], key: str = "example_id") -> DataFrame:
    """Rows with one of the ids: a semi join with a table, ``isin`` for a list in hand."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    return df.where(F.col(key).isin(list(ids)))


def session_filter(df: DataFrame, session: str) -> DataFrame:
    return df.where(F.col("session_id") == session)


def not_empty(df: DataFrame, *lengths: str) -> DataFrame:
    """Rows with the first known of the lengths above zero."""
    return df.where(F.coalesce(*(F.col(c) for c in lengths)) > 0)


def undamaged(session: Column, array: Column) -> Column:
    """False for the two broken recordings."""
    return ~(session.isin("S05", "S22") & (array == "U03"))


def without_missing_arrays(df: DataFrame, missing: DataFrame) -> DataFrame:
    """Anti join with (session_id, array)."""
    return df.join(missing, ["session_id", "array"], "left_anti")


def cross_talk_filter(df: DataFrame, most: float) -> DataFrame:
    """Rows whose overlapped share (overlap samples / samples) is at most ``most``."""
    return df.where(F.col("overlap_samples") <= most * F.col("num_samples"))


def dataset_slice(df: DataFrame, part: bool | int | slice, order: Sequence[str], key: str | None = None) -> DataFrame:
    """True: the first two rows, n: the first n, a slice: its stride; of each ``key`` if given, else of all.

    Over all rows the numbering is by range partitions and per-partition counts, not by one task.
    """
    if part is False:
        return df
    cut = slice(0, 2) if part is True else slice(0, part) if isinstance(part, int) else part
    start, step = cut.start or 0, cut.step or 1
    if key is not None:
        ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    elif cut.stop is not None and step == 1 and start == 0:
        return df.orderBy(*order).limit(cut.stop)
    else:
        ranked = numbered(df, order, "_n")
    n = F.col("_n")
    want = (n >= start) & ((n - start) % step == 0)
    return ranked.where(want & (n < cut.stop) if cut.stop is not None else want).drop("_n")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds consecutive numbers from 0 in ``order``: sorted by range partitions, each offset by the counts of those before it.

    The numbered partitions are written once, as range bounds are sampled and would differ if they were computed twice.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ordered = ordered.withColumn("_m", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("bigint"), 33))
    ordered = shared.materialise(ordered)
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return ordered.join(before, "_p").withColumn(name, F.col("_m") + F.col("_o")).drop("_p", "_m", "_o")


def shard(df: DataFrame, order: Sequence[str], job: int, jobs: int) -> DataFrame:
    """Rows ``job - 1``, ``job - 1 + jobs``, ... in ``order``."""
    if not 1 <= job <= jobs:
        raise ValueError(f"job {job} of {jobs}")
    return dataset_slice(df, slice(job - 1, None, jobs), order)


def limit_length(df: DataFrame, signal: str, most: int, key: str = "example_id", seed: int = 0, alignment: str | None = None, length: int = 400, shift: int = 160) -> DataFrame:
    """Crops longer signals to ``most`` items from an offset in [0, max(1, (n - most) div 2)) that the id's hash gives.

    An ``alignment`` column (an item a frame of ``length`` by ``shift``) is cropped alike: by frames, or if it has as many
    items as the cropped signal has threefold frames, by these.
    """
    n = F.size(signal)
    span = F.greatest(F.lit(1), F.call_function("div", n - most, F.lit(2)).cast("int"))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8)
    offset = F.pmod(F.conv(digits, 16, 10).cast("bigint"), span).cast("int")
    cropped = F.when(n > most, F.slice(signal, offset + 1, F.lit(most))).otherwise(F.col(signal))
    new = {signal: cropped, "num_samples": F.least(n, F.lit(most)).cast("bigint")}
    if alignment:
        frame = lambda s: F.greatest(F.lit(0), F.call_function("div", s - length + shift, F.lit(shift)).cast("int"))
        third = lambda f: F.call_function("div", f + 2, F.lit(3)).cast("int")
        low = F.size(alignment) == third(frame(F.lit(most)))
        first, count = (F.when(low, third(frame(x))).otherwise(frame(x)) for x in (offset, F.lit(most)))
        new[alignment] = F.when(n > most, F.slice(alignment, first + 1, count)).otherwise(F.col(alignment))
    return df.withColumns(new)


def session_ids(wanted: DataFrame, groups: DataFrame) -> DataFrame:
    """(session): names of ``wanted`` (name) expanded by ``groups`` (name, session), unknown ones as they are; distinct."""
    return wanted.join(groups, "name", "left").select(F.coalesce("session", "name").alias("session")).distinct()


def merge(*tables: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Union of key -> value; a key with different values in any two of the tables raises."""
    head, *rest = (t.select(key, value) for t in tables)
    for t in rest:
        head = head.unionByName(t)
    got = head.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_hi"), F.count("*").alias("_n"), F.count(value).alias("_v"))
    bad = (F.col(value) != F.col("_hi")) | ((F.col("_v") > 0) & (F.col("_v") < F.col("_n")))
    return gate(got, bad, "the tables differ").drop("_hi", "_n", "_v")


def prefer_first(df: DataFrame, key: str, channel: str, preference: Sequence[str]) -> DataFrame:
    """Of each key the row of the channel that comes first in ``preference``; other channels count for nothing."""
    place = F.array_position(F.lit(list(preference)), F.col(channel))
    ranked = df.withColumn("_p", place).where("_p > 0")
    others = [c for c in df.columns if c != key]
    best = ranked.groupBy(key).agg(F.min_by(F.struct(*others), "_p").alias("_r"))
    return best.select(*(F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns))


def disjoint_union(*tables: DataFrame, key: str) -> DataFrame:
    head, *rest = tables
    for t in rest:
        head = head.unionByName(t)
    return unique_ids(head, key)


def missing_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys of ``df`` that ``other`` lacks."""
    return df.select(key).join(other.select(key), key, "left_anti").distinct()


def shared_keys(key: str, *tables: DataFrame) -> DataFrame:
    head, *rest = (t.select(key) for t in tables)
    for t in rest:
        head = head.intersect(t)
    return head.distinct()


def combine_file_lists(a: DataFrame, b: DataFrame, postfix: str) -> DataFrame:
    """Long file lists (utt, type, channel, path): ``b``'s ids get a postfix; only (type, channel) of both stay."""
    common = a.select("type", "channel").intersect(b.select("type", "channel"))
    both = a.unionByName(b.withColumn("utt", F.concat("utt", F.lit(postfix))))
    return both.join(common, ["type", "channel"], "left_semi").select(*a.columns)


def for_channel(files: DataFrame, channel: str) -> DataFrame:
    return files.where(F.col("channel") == channel)


def available_channels(files: DataFrame) -> DataFrame:
    """(type, channels) over all utterances."""
    return files.groupBy("type").agg(F.sort_array(F.collect_set("channel")).alias("channels"))


def all_exist(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """``paths`` (path), which fails while running if an audio file of it isn't in ``listing``, or there is none at all."""
    audio = paths.where(F.col("path").rlike(r"\.(wav|wv1|wv2|flac)$"))
    found = audio.join(listing.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    found = found.withColumn("path", F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("audio file is missing: "), F.col("path"))).cast("string")).otherwise(F.col("path")))
    none = audio.agg(F.count("*").alias("_n")).where("_n = 0").select(F.raise_error(F.lit("no audio file")).cast("string").alias("path"))
    return found.drop("_hit").unionByName(none, allowMissingColumns=True)


def resolve(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Inner join with a small dimension; a key without match raises. Spark broadcasts it while it is small."""
    got = df.join(dimension.withColumn("_hit", F.lit(True)), key, "left")
    return gate(got, F.col("_hit").isNull(), f"{key} without a match").drop("_hit")


def positional(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of two lists put together by (keys, pos); lists of different length raise. Columns of ``b`` get ``_r``."""
    right = b.select(*(F.col(c).alias(c if c in (*keys, "pos") else f"{c}_r") for c in b.columns)).withColumn("_b", F.lit(True))
    both = a.withColumn("_a", F.lit(True)).join(right, [*keys, "pos"], "full")
    return gate(both, F.col("_a").isNull() | F.col("_b").isNull(), "the lists differ in length").drop("_a", "_b")
