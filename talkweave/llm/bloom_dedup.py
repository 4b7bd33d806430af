"""Exact dedup by two-pass Bloom filtering.

Pass 1 reads only the texts, as 64-bit hashes, and finds those that may repeat.
A task first drops the copies among its own hashes, so a text that a third of
all rows have is sent once a task; then the hashes alone (9 bytes each) go to
parts of the hash space.  A part streams its hashes through one Bloom filter:
a hash that the filter holds already may be a repeated one.  Parts are as many
as it takes for a part's filter to have ``PART_BITS`` at most.

Pass 2 puts the hashes that may repeat into a second filter (16 bits each) and
tests every row against it: rows that can't be copies pass straight through,
the others alone are shuffled, grouped by (hash, SHA-256 of the text) with
map-side combining, so that a text with millions of copies is no hot key.  The
second filter is broadcast in ranges of the hash space, each of
``max_filter_bytes`` at most: with more hashes than that holds, the rows are
read once for each range and a range's rows are judged by its filter.  So texts
that are no copies are never shuffled, however many rows there are.

Which row stays: of equal texts that of the least ``doc_id`` (nulls last), of
equal ones any, chosen by the hash of the other columns.  Cases: a null text
equals nothing, so its row stays; empty texts are equal to each other; texts
are compared whole and exactly, so case and white space count.  Any other
columns, of any name, are kept.  Of an empty table the result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .kernel import mix

BITS = 16
PART_BITS, SLICE = 1 << 28, 1 << 14


class Filter:
    """A Bloom filter in words of 64 bits; a hash sets four bits of one word."""

    def __init__(self, words: int):
        self.words = np.zeros(max(1, words), np.uint64)

    def address(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word of the filter and the four bits of it for each hash."""
        g = mix(h)
        word = ((g >> np.uint64(24)) % np.uint64(len(self.words))).astype(np.int64)
        one, bits = np.uint64(1), np.zeros(len(h), np.uint64)
        for shift in (0, 6, 12, 18):
            bits |= one << ((g >> np.uint64(shift)) & np.uint64(63))
        return word, bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        word, bits = self.address(h)
        return (self.words[word] & bits) == bits

    def add_new(self, h: np.ndarray) -> np.ndarray:
        """Adds hashes, each of them once; says which the filter may have held before."""
        word, bits = self.address(h)
        held = (self.words[word] & bits) == bits
        np.bitwise_or.at(self.words, word, bits)
        return held


def words_for(hashes: int) -> int:
    return -(-hashes * BITS // 64)


def possibly_repeated(hashes: DataFrame, rows: int) -> DataFrame:
    """(h): the hashes (column ``h``, ``rows`` of them) that occur twice, and few others; each once or more."""
    parts = min(max(1, int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * BITS // PART_BITS)), 1 << 20)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], ["h", "twice"])

        for batch in batches:
            held.append(np.asarray(batch.column(0)).view(np.uint64))
            size += batch.num_rows
            if size > 4_000_000:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Filter(words_for(2 * rows // parts + 1024))
        for batch in batches:
            h, twice = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1))
            u, at = np.unique(h, return_index=True)  # a batch may have a hash from several tasks
            copy = np.ones(len(h), bool)
            copy[at] = False
            again = np.concatenate([h[copy | twice], u[seen.add_new(u)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(again).view(np.int64))], ["h"])

    sent = hashes.mapInArrow(first, "h bigint, twice boolean")
    return sent.repartition(parts, "h").mapInArrow(second, "h bigint")


def filter_of(hashes: DataFrame, words: int) -> Filter:
    """The filter of the hashes (column ``h``), built in slices; the driver receives its words alone."""
    whole = Filter(words)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, bits = whole.address(np.asarray(batch.column(0)).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word // SLICE), pa.array(word % SLICE), pa.array(bits.view(np.int64))], ["slice", "word", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            part, word, bits = (np.asarray(c) for c in batch.columns)
            for s in np.unique(part).tolist():
                own = part == s
                np.bitwise_or.at(found.setdefault(s, np.zeros(SLICE, np.uint64)), word[own], bits[own].view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["slice", "words"])

    empty, whole.words = whole.words, np.broadcast_to(np.uint64(0), len(whole.words))  # only its length goes to the tasks
    got = hashes.mapInArrow(spread, "slice bigint, word bigint, bits bigint").repartition("slice").mapInArrow(join, "slice bigint, words binary").collect()
    for s, blob in got:
        own = np.frombuffer(blob, np.uint64)[: len(empty) - s * SLICE]
        empty[s * SLICE : s * SLICE + len(own)] = own
    whole.words = empty
    return whole


def tester(shared: Broadcast) -> Callable[[str], Column]:
    """A column function: whether the broadcast filter holds a hash."""

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(shared.value.holds(h.to_numpy(np.int64).view(np.uint64)))

    return maybe


def range_of(h: Column, ranges: int) -> Column:
    """The range of a hash, of so many."""
    return F.pmod(F.xxhash64(h), F.lit(ranges))


def exact_dedup(docs: DataFrame, max_filter_bytes: int = 256 << 20) -> DataFrame:
    """One row of each text; columns as they were."""
    common.need(docs, "doc_id", "text")
    spark = docs.sparkSession
    plain, names = common.numbered(docs)
    text, key = F.col(f"c{names.index('text')}"), F.col(f"c{names.index('doc_id')}")
    hashed = plain.withColumn("h", F.xxhash64(text))
    repeated = common.materialise(possibly_repeated(hashed.where(text.isNotNull()).select("h"), docs.count()).distinct())
    words = words_for(repeated.count())
    ranges = max(1, -(-words * 8 // max(max_filter_bytes, 8)))
    through, suspect = [], []
    for k in range(ranges):
        of = lambda df: df.where(range_of(F.col("h"), ranges) == k) if ranges > 1 else df  # noqa: B023, E731
        maybe = tester(spark.sparkContext.broadcast(filter_of(of(repeated), -(-words // ranges))))
        flagged = of(hashed).withColumn("m", text.isNotNull() & maybe("h"))
        through.append(flagged.where(~F.col("m")))
        suspect.append(flagged.where("m"))
    own = [f"c{i}" for i in range(len(names))]
    plainly = [c for c, f in zip(own, plain.schema.fields) if _hashable(f.dataType)]
    rank = F.struct(key.isNull(), key, F.xxhash64(*plainly))
    kept = reduce(DataFrame.unionByName, suspect).groupBy("h", F.sha2(text.cast("binary"), 256).alias("s")).agg(F.min_by(F.struct(*own), rank).alias("r")).select("r.*")
    return reduce(DataFrame.unionByName, through).select(*own).unionByName(kept).toDF(*names)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without exact copies."""
    return exact_dedup(common.table(spark, sf_dir, "documents"))


OP3_SQL = """SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS place FROM documents) WHERE place = 1 OR text IS NULL"""
