"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its subwords (byte 3- and 4-grams
of the lower-cased text that don't cross a word boundary, hashed into
``BUCKETS`` rows); a linear softmax turns it into language probabilities.
Embeddings and weights are trained together by stochastic gradient descent in
numpy on a bounded sample of rows that carry a language.  For scoring, the
embedding table times the weights is one integer table, so that a text costs a
lookup per byte and its sums don't depend on how rows are batched.

Texts that mix languages: a text is judged by parts of ``PART`` bytes, each
with its own probabilities.  The language is that of the greatest mean
probability over all subwords; the confidence is the mean of the parts' best
probabilities, each times the share of its subwords that training has seen.
So a text of two known languages is as sure as its parts are, and a foreign
script or noise isn't.

Rejection is calibrated on held-out documents.  The temperature is fitted by
likelihood; the threshold is the least confidence above which the error on
held-out whole texts stays under ``max_error`` (beyond the noise of their
labels); texts that are less sure than all such ones are rejected.

Cases: a null or empty text, or one without letters, has no subword, so no
language: ``predicted`` is null, ``confidence`` 0, ``keep`` false.  Very long
texts are scored whole.  Repeated rows give repeated results.  A null
``doc_id`` is carried through.  Of an empty table the result is empty (the
model then knows no language and rejects all).  Other columns are ignored.
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

BUCKETS = 1 << 17
DIMS = 12
SCALE = 1 << 20
RUNS, PART = 64, 256

_LETTER = kernel.WORD.copy()
_LETTER[list(b"0123456789")] = False
_FOLD = np.where(_LETTER, np.arange(256), 32).astype(np.uint32)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bucket of the subword that begins at each byte, whether there is one, and the first byte's place."""
    size = len(data)
    for lo in range(0, size, kernel.PIECE):
        hi = min(lo + kernel.PIECE, size)
        n = hi - lo
        x = np.full(n + 3, 32, np.uint32)
        x[: min(hi + 3, size) - lo] = _FOLD[data[lo : min(hi + 3, size)]]
        letter = x != 32
        cut = np.zeros(n + 4, bool)
        inner = offsets[(offsets > lo) & (offsets <= hi + 3)] - lo
        cut[inner] = True
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        three = letter[1 : n + 1] & ~cut[1 : n + 1] & ~cut[2 : n + 2]
        yield _bucket(h[:n]), three, lo
        four = three & letter[2 : n + 2] & ~cut[3 : n + 3]
        yield _bucket(h[:n] * np.uint32(0x27D4EB2F) + x[3:] * np.uint32(0x165667B1) + np.uint32(1)), four, lo


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def buckets_of(text: str | None) -> list[int]:
    """Subword buckets of one text, one by one (what ``subwords`` finds for a column)."""
    m = 0xFFFFFFFF
    d = [32, *(int(_FOLD[b]) for b in text.lower().encode()), 32] if text else []

    def bucket(h: int) -> int:
        h ^= h >> 15
        h = h * 0x2C1B3C6D & m
        return (h ^ (h >> 13)) & (BUCKETS - 1)

    out = []
    for i in range(len(d) - 2):
        a, b, c = d[i : i + 3]
        if b != 32:
            h = ((a * 0x9E3779B1) & m) ^ ((b * 0x85EBCA77) & m) ^ ((c * 0xC2B2AE3D) & m)
            out.append(bucket(h))
            if c != 32 and i + 3 < len(d):
                out.append(bucket((h * 0x27D4EB2F + d[i + 3] * 0x165667B1 + 1) & m))
    return out


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the lower-cased texts, each between two spaces."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    space = pa.scalar(" ", column.type)
    return kernel.raw(pc.binary_join_element_wise(space, pc.utf8_lower(column), space, pa.scalar("", column.type)))


@dataclass
class Model:
    """Languages, integer table of shares in the logits by bucket (last row: seen in training), bias, temperature, threshold."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 1.0

    def parts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number of subwords and sums of the table (share of each language, seen last) of each part of ``PART`` bytes."""
        data, offsets = _padded(column)
        n = np.maximum(-(-np.diff(offsets) // PART), 1)
        row = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        ends = np.append(offsets[row] + (np.arange(len(row)) - first[row]) * PART, offsets[-1])
        sums, count = np.zeros((len(row), len(self.langs) + 1), np.int64), np.zeros(len(row), np.int64)
        for h, ok, lo in subwords(data, offsets):
            at = np.flatnonzero(ok)
            place = np.searchsorted(at, np.clip(ends - lo, 0, len(ok)))
            count += np.diff(place)
            h = h[at]
            for k in range(sums.shape[1]):
                run = np.zeros(len(at) + 1, np.int64)
                np.cumsum(self.table[k][h], out=run[1:])
                sums[:, k] += np.diff(run[place])
        return row, count, sums

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Average share of each language for each row with the share of seen subwords last, and the number of subwords."""
        row, count, sums = self.parts(column)
        first = np.searchsorted(row, np.arange(len(column)))
        if not len(row):
            return np.zeros((0, len(self.langs) + 1)), count
        count = np.add.reduceat(count, first)
        return np.add.reduceat(sums, first) / SCALE / np.maximum(count, 1)[:, None] + np.append(self.bias, 0), count

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Best class of each row (-1: none) and its calibrated confidence."""
        if not self.langs or not len(column):
            return np.full(len(column), -1), np.zeros(len(column))
        row, count, sums = self.parts(column)
        first = np.searchsorted(row, np.arange(len(column)))
        z = sums / SCALE / np.maximum(count, 1)[:, None] + np.append(self.bias, 0)
        p = _softmax(z[:, :-1] / self.temperature)
        each = np.maximum(np.add.reduceat(count, first), 1)
        sure = np.add.reduceat(count * p.max(1) * z[:, -1], first) / each
        best = np.add.reduceat(count[:, None] * p, first).argmax(1)
        some = np.add.reduceat(count, first) > 0
        return np.where(some, best, -1), np.where(some, sure, 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _chunks(text: str, sizes: np.random.Generator) -> Iterator[str]:
    """The whole text, then all its words in runs of varied length: short texts must be learnt too.

    Runs are longer in a long text, which so has at most ``RUNS`` of them and no more weight than others.
    """
    yield text
    w = text.split()
    at = 0
    while at < len(w) and len(w) > 8:
        n = max(int(sizes.choice((2, 4, 8, 16, 40, 120))), -(-len(w) // RUNS))
        yield " ".join(w[at : at + n])
        at += n


def train(rows: list[tuple[str, str]], epochs: int = 2, rate: float = 0.5, max_error: float = 0.01, seed: int = 7) -> Model:
    """Fits a model to (text, language) rows; every fifth row is held out for the calibration."""
    langs = sorted({b for a, b in rows if a and b})
    if not langs:
        return Model([], np.zeros((1, BUCKETS), np.int32), np.zeros(0))
    rng = np.random.default_rng(seed)
    fit, held, whole = [], [], []
    for i, (text, lang) in enumerate(rows):
        if text and lang:
            parts = [(c, langs.index(lang)) for c in _chunks(text, rng)]
            (held if i % 5 == 4 else fit).extend(parts)
            if i % 5 == 4:
                whole += [True] + [False] * (len(parts) - 1)
    fit = fit or held
    held, whole = (held, whole) if held else (fit, [True] * len(fit))
    column, parts, done = pa.array([c for c, _ in fit]), [], 0
    for lo, hi in kernel.groups(column, 1 << 19):  # only distinct subwords of each text are held
        data, offsets = _padded(column.slice(lo, hi - lo))
        found = [(h[at], np.searchsorted(offsets, at + lo_, "right") - 1) for h, ok, lo_ in subwords(data, offsets) for at in (np.flatnonzero(ok),)]
        h, row, n = kernel.distinct(*(np.concatenate(x) for x in zip(*found))) if found else (np.zeros(0, np.int64),) * 3
        parts.append((h.astype(np.int32), n.astype(np.float32), done + np.searchsorted(row, np.arange(1, hi - lo + 1))))
        done += len(h)
    h, n, ends = (np.concatenate(x) for x in zip(*parts))
    ends = np.append(0, ends)
    del column, parts
    label = np.array([k for _, k in fit])
    balance = len(label) / (len(langs) * np.maximum(np.bincount(label, minlength=len(langs)), 1))
    embed = np.zeros((BUCKETS, DIMS))
    used = np.unique(h)
    embed[used] = rng.normal(0, 0.1, (len(used), DIMS))
    weight, bias = rng.normal(0, 0.5, (DIMS, len(langs))), np.zeros(len(langs))
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for d in rng.permutation(len(fit)):
            lo, hi = ends[d], ends[d + 1]
            step += 1
            if lo == hi:
                continue
            b, share = h[lo:hi], n[lo:hi] / n[lo:hi].sum()
            mean = share @ embed[b]
            g = _softmax(mean @ weight + bias)
            g[label[d]] -= 1
            lr = rate * (1 - step / (steps + 1)) * balance[label[d]]
            back = weight @ g
            weight -= lr * 0.1 * np.outer(mean, g)
            embed[b] -= (lr * min(hi - lo, 40)) * share[:, None] * back
            bias -= lr * 0.01 * g
    shares = np.zeros((len(langs) + 1, BUCKETS), np.int32)
    shares[:-1] = np.clip(np.rint(embed @ weight * SCALE), -(2**31) + 1, 2**31 - 1).T
    shares[-1, used] = SCALE
    model = Model(langs, shares, bias)
    column, truth, whole = pa.array([c for c, _ in held]), np.array([k for _, k in held]), np.array(whole)
    cuts = list(kernel.groups(column, 1 << 19))
    z, count = (np.concatenate(x) for x in zip(*(model.logits(column.slice(lo, hi - lo)) for lo, hi in cuts)))
    runs = (count > 0) & ~whole if (~whole & (count > 0)).any() else count > 0
    if runs.any():
        grid, z, label = np.geomspace(0.005, 20, 81), z[runs, :-1], truth[runs]
        model.temperature = float(min(grid, key=lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), label], 1e-12)).mean()))
        best, sure = (np.concatenate(x) for x in zip(*(model.score(column.slice(lo, hi - lo)) for lo, hi in cuts)))
        whole &= best >= 0
        model.threshold = rejection(sure[whole], best[whole] != truth[whole], max_error)
    return model


def rejection(sure: np.ndarray, wrong: np.ndarray, max_error: float) -> float:
    """The least confidence of a held-out text above which at most ``max_error`` of them are wrong, beyond what is wrong among the surer half of them.

    The latter is noise of the labels, which no threshold takes away.
    """
    if not len(sure):
        return 1.0
    order = np.argsort(-sure, kind="stable")
    errors = np.cumsum(wrong[order])
    half = (len(sure) + 1) // 2
    good = np.flatnonzero(errors <= (max_error + errors[half - 1] / half) * np.arange(1, len(sure) + 1))
    return float(sure[order][good[-1]]) if len(good) else 1.0


def fit(docs: DataFrame, sample_rows: int = 2000, seed: int = 7) -> Model:
    """Trains on at most ``sample_rows`` documents that carry a language; the driver receives their texts, whole, and of an id that is repeated one row."""
    docs = common.own(docs, doc_id="bigint", text="string", lang="string").where("text is not null and lang is not null")
    picked = common.sampled_ids(docs, sample_rows, seed)
    got = common.one_a_doc(docs.join(F.broadcast(picked), "doc_id"), "lang", "text").toPandas().sort_values("doc_id")
    return train(list(zip(got["text"], got["lang"])), seed=seed)


def predict(docs: DataFrame, model: Model, keep_columns: bool = False) -> DataFrame:
    """One row a document: doc_id, lang (as declared), predicted, confidence, keep.

    With ``keep_columns`` instead the documents that aren't rejected, all columns as they were.
    """
    common.need(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        m, best, sure = shared.value, [], []
        for lo, hi in kernel.groups(column, 1 << 18):
            b, s = m.score(column.slice(lo, hi - lo))
            best.append(b)
            sure.append(s)
        return np.concatenate([np.zeros(0, int), *best]), np.concatenate([np.zeros(0), *sure])

    if keep_columns:
        at = docs.columns.index("text")

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best, sure = judged(batch.column(at))
                yield batch.filter(pa.array((best >= 0) & (sure >= shared.value.threshold)))

        plain, names = common.numbered(docs)
        return plain.mapInArrow(kept, plain.schema).toDF(*names)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, sure = judged(batch.column(1))
            names = pa.array([*shared.value.langs, None], pa.string())
            predicted = names.take(pa.array(np.where(best < 0, len(shared.value.langs), best)))
            keep = pa.array((best >= 0) & (sure >= shared.value.threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), predicted, pa.array(np.round(sure, 6)), keep], ["doc_id", "lang", "predicted", "confidence", "keep"])

    kinds = {"doc_id": "bigint", "text": "string"} | {"lang": "string" for c in docs.columns if c == "lang"}
    rows = common.own(docs, **kinds)
    rows = rows if "lang" in kinds else rows.withColumn("lang", F.lit(None).cast("string"))
    return rows.mapInArrow(scored, "doc_id bigint, lang string, predicted string, confidence double, keep boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and decision for every document."""
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
