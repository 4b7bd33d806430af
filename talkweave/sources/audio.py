"""Wav audio: header facts, ranged reads, writing. Pure standard library on the executors.

PCM of 8, 16, 24 and 32 bits and IEEE float of 32 and 64 bits.  Anything that
isn't RIFF/WAVE raises; a null content gives a null result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHAPE = "channels int, samples bigint, rate int, bits int"


@dataclass
class Header:
    channels: int
    rate: int
    bits: int
    floating: bool
    data: int
    size: int

    @property
    def block(self) -> int:
        return self.channels * self.bits // 8

    @property
    def samples(self) -> int:
        return self.size // self.block


def header(content: bytes) -> Header:
    """Reads the chunks up to ``data``."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a wav file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if kind == 0xFFFE:
                kind = struct.unpack_from("<H", content, at + 32)[0]
            form = channels, rate, bits, kind == 3
        elif name == b"data" and form:
            return Header(*form, at + 8, min(size, len(content) - at - 8))
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def read(content: bytes, start: int = 0, stop: int | None = None, frames: int = -1, fill: float | None = None) -> np.ndarray:
    """(channel, sample) in [-1, 1) for samples ``[start, stop)`` (or ``frames`` of them); shorter at the end of the file unless ``fill`` is given."""
    h = header(content)
    want = h.samples if stop is None and frames < 0 else stop if stop is not None else start + frames
    last = min(want, h.samples)
    start = min(start, last)
    raw = content[h.data + start * h.block : h.data + last * h.block]
    if h.floating:
        x = np.frombuffer(raw, f"<f{h.bits // 8}").astype(np.float64)
    elif h.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
    elif h.bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    else:
        x = np.frombuffer(raw, f"<i{h.bits // 8}") / 2.0 ** (h.bits - 1)
    x = x.reshape(-1, h.channels).T
    if fill is not None and last < want:
        x = np.concatenate([x, np.full((h.channels, want - last), fill)], 1)
    return x


def read_raw(content: bytes, kind: str = "int16", channels: int = 1) -> np.ndarray:
    """(channel, sample) of samples without a header, little-endian; whole numbers are scaled to [-1, 1)."""
    if kind not in ("int8", "int16", "int32", "float32", "float64"):
        raise ValueError(f"no sample type {kind!r}")
    size = np.dtype(kind).itemsize * channels
    x = np.frombuffer(content[: len(content) // size * size], np.dtype(kind).newbyteorder("<")).astype(np.float64)
    return (x / 2.0 ** (8 * np.dtype(kind).itemsize - 1) if kind.startswith("int") else x).reshape(-1, channels).T


def write(signal: np.ndarray, rate: int = 16000, kind: str = "int16", normalise: bool = False, start: int = 0) -> bytes:
    """A wav file of a (channel, sample) or (sample,) signal; ``normalise`` scales its peak to (2^15 - 1) / 2^15; ``start`` samples of silence come first."""
    x = np.atleast_2d(np.asarray(signal, np.float64))
    if normalise and x.size and np.abs(x).max() > 0:
        x = x * ((2**15 - 1) / 2**15 / np.abs(x).max())
    x = np.concatenate([np.zeros((len(x), start)), x], 1)
    if kind in ("int16", "int32"):
        top = 2 ** (int(kind[3:]) - 1)
        body, form, bits = np.clip(np.rint(x * top), -top, top - 1).astype(f"<i{int(kind[3:]) // 8}"), 1, int(kind[3:])
    elif kind in ("float32", "float64"):
        body, form, bits = x.astype(f"<f{int(kind[5:]) // 8}"), 3, int(kind[5:])
    else:
        raise ValueError(f"no sample type {kind!r}")
    data = np.ascontiguousarray(body.T).tobytes()
    block = len(x) * bits // 8
    return b"".join((b"RIFF", struct.pack("<I", 36 + len(data)), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, form, len(x), rate, rate * block, block, bits), b"data", struct.pack("<I", len(data)), data))


def clipped(signal: np.ndarray) -> int:
    """How many samples lie outside [-1, 1)."""
    return int(((signal < -1) | (signal >= 1)).sum())


def shape(content: Column) -> Column:
    """struct<channels, samples, rate, bits> from the header alone."""

    @F.pandas_udf(SHAPE)
    def of(c: pd.Series) -> pd.DataFrame:
        rows = []
        for x in c:
            h = header(bytes(x)) if x is not None else None
            rows.append((h.channels, h.samples, h.rate, h.bits) if h else (None,) * 4)
        return pd.DataFrame(rows, columns=["channels", "samples", "rate", "bits"])

    return of(content)


def load(df: DataFrame, start: Column | int = 0, stop: Column | int | None = None, unit: str = "samples", rate: int = 16000, keep: Sequence[str] = (), more: Mapping[str, tuple[int, int | None]] | None = None) -> DataFrame:
    """(path, channel, samples) of rows (path, content): a row for each channel of ``[start, stop)``, with the columns ``keep``.

    ``more``: further ranges of the same files, each in a column of its own.
    """
    if unit not in ("samples", "seconds"):
        raise ValueError(f"no unit {unit!r}")
    scale = rate if unit == "seconds" else 1
    at = [F.round((c if isinstance(c, Column) else F.lit(c)) * scale).cast("bigint") for c in (start, stop)]
    others = {n: (round(lo * scale), None if hi is None else round(hi * scale)) for n, (lo, hi) in (more or {}).items()}
    found = ["samples", *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(names)}
            row, channel, samples = [], [], [[] for _ in found]
            for i, (c, lo, hi) in enumerate(zip(column["content"], column["_lo"].to_pylist(), column["_hi"].to_pylist())):
                content = c.as_py()
                for k, y in enumerate(zip(*(read(content, *r) for r in ((lo or 0, hi), *others.values()))) if c.is_valid else ()):
                    row.append(i)
                    channel.append(k)
                    for to, part in zip(samples, y):
                        to.append(part)
            values = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, s)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0), *s]))) for s in samples]
            took = [column[n].take(pa.array(row, pa.int64())) for n in (*keep, "path")]
            yield pa.RecordBatch.from_arrays([*took, pa.array(channel, pa.int32()), *values], [*keep, "path", "channel", *found])

    names = [*keep, "path", "content", "_lo", "_hi"]
    own = df.select(*keep, "path", "content", at[0].alias("_lo"), at[1].alias("_hi"))
    fields = [own.schema[n] for n in (*keep, "path")]
    schema = T.StructType([*fields, T.StructField("channel", T.IntegerType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in found)])
    return own.mapInArrow(run, schema)


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of wav files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")


def encode(df: DataFrame, key: str, rate: int = 16000, kind: str = "int16", normalise: bool = False) -> DataFrame:
    """(key, content, n_clipped): wav files of rows (key, channel, samples), channels in order.

    A key's rows lie together in one part, and files are made of them as they come, many to a batch; no more than one
    file's rows and a batch are held.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("content", T.BinaryType()), T.StructField("n_clipped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name, made, size = [], None, [], 0

        def finish() -> None:
            x = np.stack(held)
            made.append((name, write(x, rate, kind, normalise), 0 if normalise else clipped(x)))

        def batch_of(like: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*made))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], like), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], schema.names)

        for batch in batches:
            like, samples = batch.schema.field(0).type, batch.column(1)
            if samples.null_count:
                raise ValueError("a channel has no samples")
            flat, ends = samples.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), samples.offsets.to_numpy()
            for i, k in enumerate(batch.column(0).to_pylist()):
                if held and k != name:
                    finish()
                    held, size = [], size + len(made[-1][1])
                    if size > 1 << 23 or len(made) == 10_000:
                        yield batch_of(like)
                        made, size = [], 0
                name = k
                held.append(flat[ends[i] : ends[i + 1]])
        if held:
            finish()
            yield batch_of(like)

    rows = df.select(key, "channel", "samples").repartition(key).sortWithinPartitions(key, F.col("channel").asc_nulls_last())
    return rows.select(key, "samples").mapInArrow(run, schema)


def scaled(signal: Column) -> Column:
    """Peak-normalised array, on the JVM."""
    peak = F.array_max(F.transform(signal, lambda x: F.abs(x)))
    return F.transform(signal, lambda x: F.when(peak > 0, x * F.lit((2**15 - 1) / 2**15) / peak).otherwise(x))


def truncated(df: DataFrame, key: str, signal: str, least: int, may_drop: int = 8) -> DataFrame:
    """Signals of fewer than ``least`` samples go (at most ``may_drop`` of a key, else it raises); the rest is cut to the key's shortest."""
    from pyspark.sql import Window

    from talkweave.operators import catalog

    w = Window.partitionBy(key)
    n = F.size(signal)
    marked = df.withColumn("_short", F.count_if(n < least).over(w))
    kept = catalog.gate(marked, F.col("_short") > may_drop, "too many short files").where(n >= least)
    return kept.withColumn(signal, F.slice(signal, F.lit(1), F.min(n).over(w))).drop("_short")


def load_nested(df: DataFrame, tree: str, files: DataFrame, key: str) -> DataFrame:
    """A tree of paths (``map<string,array<string>>``) as a tree of signals: paths are exploded, joined with what was loaded, and put together again.

    ``files`` has path, samples (one channel). Result: (key, branch, signals) with signals in the order of the list.
    """
    long = df.select(key, F.explode(tree).alias("branch", "_p")).select(key, "branch", F.posexplode("_p").alias("pos", "path"))
    got = long.join(files.select("path", "samples"), "path")
    stacked = F.transform(F.sort_array(F.collect_list(F.struct("pos", "samples"))), lambda x: x["samples"])
    return got.groupBy(key, "branch").agg(stacked.alias("signals"))
