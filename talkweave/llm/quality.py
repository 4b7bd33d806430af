"""Quality classifier: a factorisation machine over words, structure and metadata.

Features of a document: its hashed words (counts on a log scale, L2-normalised), twelve
structure statistics in bins, and hashed language and source.  The score is

    b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

so all pairs of features interact through ``RANK`` factors in time linear in
the number of features.  It is trained by AdaGrad in numpy on a bounded sample
of labelled rows; the threshold is the middle of the range that separates
held-out good and bad rows best.

Cases: null and empty texts have no words; they are scored by their statistics
and metadata alone (``n_words`` 0) and ``keep`` is false.  Null language or
source is a value of its own.  Very long texts are used whole.  Repeated rows
give repeated results; a null ``doc_id`` is carried through.  Labels: rows
without a label or id are no evidence, several labels of an id count by their
mean, several texts of one are one (the least).  With no labelled row, or one class only, every document with words is
kept at score 0.5.  Of an empty table the result is empty; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel

WORD_BITS = 18
BINS = 16
STATS = 12
META = 1 << 12
SIZE = (1 << WORD_BITS) + STATS * BINS + META
RANK = 8
STAT_X, META_X = 0.35, 0.2

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 punctuation, 6 line end, 7 beyond ASCII
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 3
_CLASS[list(b" \t\r\f\v")] = 4
_CLASS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 5
_CLASS[10] = 6
_CLASS[128:] = 7
_CLASS8 = _CLASS.astype(np.uint8)
_ODD = np.zeros(256, bool)
_ODD[list(b"#$%&*|<>{}[]=~^_@!\\")] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set within each row."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))


def features(text: pa.Array, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every feature, by row and feature; and the word counts."""
    w = kernel.words(text)
    rows = w.rows
    data, offsets = kernel.raw(text)
    kind = _CLASS8[data]
    size = np.maximum(np.diff(offsets), 1)
    n = np.bincount(w.row, minlength=rows)
    key = np.sort(w.row.astype(np.int64) << WORD_BITS | (w.hash & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    row, bucket = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    x = 1 + np.log(count)
    x /= np.sqrt(np.bincount(row, x * x, rows))[row]
    some = np.maximum(n, 1)
    different = np.bincount(row, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, count)
    lines = _sums(kind == 6, offsets) + 1
    letters = np.maximum(_sums((kind == 1) | (kind == 2), offsets), 1)
    stats = np.stack([
        _sums(kind == 5, offsets) / size, _sums(_ODD[data], offsets) / some, _sums(kind == 2, offsets) / letters,
        _sums(kind == 3, offsets) / size, _sums(kind == 4, offsets) / some, _sums(kind == 7, offsets) / size,
        np.minimum(np.bincount(w.row, (w.end - w.start), rows) / some / 16, 1), different / some, top / some,
        np.minimum(lines / some, 1), np.minimum(np.log2(some) / BINS, 1), np.minimum(np.log2(np.maximum(some / lines, 1)) / 10, 1),
    ], 1)
    bins = np.clip((np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64), 0, BINS - 1)
    base = 1 << WORD_BITS
    stat = base + np.arange(STATS) * BINS + bins
    base += STATS * BINS
    meta = []
    for k, column in enumerate((lang, source)):
        coded = pc.dictionary_encode(column.cast(pa.string()), null_encoding="encode")
        named = np.array([base + (kernel.hash_word(f"{k}:{v}".encode()) % META) for v in coded.dictionary.to_pylist()], np.int64)
        meta.append(named[np.asarray(coded.indices)] if rows else np.zeros(0, np.int64))
    every = np.arange(rows)
    all_row = np.concatenate([row, np.repeat(every, STATS), every, every])
    all_f = np.concatenate([bucket, stat.reshape(-1), *meta])
    all_x = np.concatenate([x, np.full(rows * STATS, STAT_X), np.full(2 * rows, META_X)])
    order = np.argsort(all_row, kind="stable")
    return all_row[order], all_f[order], all_x[order], n


@dataclass
class Machine:
    """Bias, weights and factors; the threshold on the probability."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    threshold: float = 0.0

    def score(self, row: np.ndarray, f: np.ndarray, x: np.ndarray, rows: int) -> np.ndarray:
        """Logit of each row (every row has features)."""
        if not rows:
            return np.zeros(0)
        first = np.searchsorted(row, np.arange(rows))
        vx = self.factor[f] * x[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), first)
        return self.bias + np.add.reduceat(self.weight[f] * x, first) + 0.5 * ((sums * sums).sum(1) - squares)


def logistic(z: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(row: np.ndarray, f: np.ndarray, x: np.ndarray, good: np.ndarray, epochs: int = 6, rate: float = 0.15, decay: float = 1e-5, seed: int = 5) -> Machine | None:
    """Fits a machine to the features of rows; every fifth row is held out for the threshold. None if there is only one class."""
    good = np.asarray(good, float)
    if not len(good) or good.min() == good.max():
        return None
    ends = np.searchsorted(row, np.arange(len(good) + 1))
    rng = np.random.default_rng(seed)
    held = np.arange(len(good)) % 5 == 4
    if len(set(good[held].tolist())) < 2 or len(set(good[~held].tolist())) < 2:
        held[:] = False
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)))
    gw, gv, gb = np.full(SIZE, 1e-2), np.full((SIZE, RANK), 1e-2), 1e-2
    fit = np.flatnonzero(~held)
    share = np.array([0.5 / max(1 - good[fit].mean(), 1e-9), 0.5 / max(good[fit].mean(), 1e-9)])
    for _ in range(epochs):
        for d in rng.permutation(fit):
            i, v = f[ends[d] : ends[d + 1]], x[ends[d] : ends[d + 1]]
            factor = m.factor[i]
            vx = factor * v[:, None]
            s = vx.sum(0)
            y = m.bias + m.weight[i] @ v + 0.5 * ((s * s).sum() - (vx * vx).sum())
            g = (logistic(y) - good[d]) * share[int(good[d])]
            dw, dv = g * v + decay * m.weight[i], g * (v[:, None] * s - factor * (v * v)[:, None]) + decay * factor
            gb += g * g
            gw[i] += dw * dw
            gv[i] += dv * dv
            m.bias -= rate * g / gb**0.5
            m.weight[i] -= rate * dw / np.sqrt(gw[i])
            m.factor[i] -= rate * dv / np.sqrt(gv[i])
    p = logistic(m.score(row, f, x, len(good)))
    m.threshold = best_cut(p[held] if held.any() else p, good[held] if held.any() else good)
    return m


def best_cut(p: np.ndarray, good: np.ndarray) -> float:
    """Middle of the range of thresholds with the greatest sum of both classes' shares of right rows."""
    order = np.argsort(p, kind="stable")
    p, good = p[order], good[order]
    lost, found = np.append(0, np.cumsum(good)) / max(good.sum(), 1), np.append(0, np.cumsum(1 - good)) / max((1 - good).sum(), 1)
    edge = np.concatenate([[0.0], p, [1.0]])
    gain = found - lost
    gain[1:-1][p[1:] == p[:-1]] = -1
    k = int(np.argmax(gain))
    return float((edge[k] + edge[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, seed: int = 5) -> Machine | None:
    """Trains on at most ``sample_rows`` labelled documents, whole texts.

    The driver receives their features (of a text of any length ``SIZE`` at most), and of an id that is repeated one row.
    """
    docs = common.own(docs, doc_id="bigint", text="string", lang="string", source="string").where("text is not null")
    labels = common.own(labels, doc_id="bigint", quality="double").where("doc_id is not null and quality is not null")
    known = labels.join(F.broadcast(common.sampled_ids(labels, sample_rows, seed)), "doc_id").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("good"))
    rows = common.one_a_doc(docs.join(F.broadcast(known), "doc_id"), "text", "lang", "source", "good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kernel.groups(batch.column(1), 1 << 20):
                own = batch.slice(lo, hi - lo)
                row, f, x, _ = features(own.column(1), own.column(2), own.column(3))
                ends = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(4), pa.ListArray.from_arrays(ends, pa.array(f.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x))], ["doc_id", "good", "f", "x"])

    got = rows.mapInArrow(run, "doc_id bigint, good double, f array<int>, x array<double>").toArrow().sort_by("doc_id").combine_chunks()
    if not got.num_rows:
        return None
    row = np.repeat(np.arange(got.num_rows), pc.list_value_length(got["f"]).to_numpy())
    return train(row, pc.list_flatten(got["f"]).to_numpy().astype(np.int64), pc.list_flatten(got["x"]).to_numpy(), got["good"].to_numpy(), seed=seed)


def classify(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, n_words, score, keep) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi in kernel.groups(batch.column(1), 1 << 20):
                own = batch.slice(lo, hi - lo)
                row, f, x, n = features(own.column(1), own.column(2), own.column(3))
                p = np.full(hi - lo, 0.5) if m is None else logistic(m.score(row, f, x, hi - lo))
                keep = (n > 0) & (p >= (m.threshold if m else 0))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(n.astype(np.int32)), pa.array(np.round(p, 6)), pa.array(keep)], ["doc_id", "n_words", "score", "keep"])

    return common.own(docs, doc_id="bigint", text="string", lang="string", source="string").mapInArrow(run, "doc_id bigint, n_words int, score double, keep boolean")


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and decision for every document."""
    docs = common.table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, common.table(spark, sf_dir, "labels")))
