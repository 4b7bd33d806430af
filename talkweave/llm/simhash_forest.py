"""Near-dedup: SimHash signatures searched by an LSH forest.

The signature of a text has ``BITS`` bits: the signs of the sum of the +-1
hash vectors of its distinct words.  Two documents are near copies if their
signatures differ in at most ``radius`` bits and their word counts by at most
the factor ``ratio``.

Equal (signature, word count) rows first fold into one, so that thousands of
copies are one point.  The forest holds each point in ``tries`` tries, each
over its own random permutation of the bits.  A point's path in a trie is the
prefix of its permuted bits; depth adapts to density: the climb starts at a bottom
depth that follows the number of points (``log2`` of it less ``SPARE``, at least
``LEAST_DEPTH``), and the number of tries is what the target recall then needs at
``radius`` itself, the farthest pairs that count.  From there each sub-trie climbs to the shortest prefix
that at most ``DENSE`` points share, so in sparse regions near copies meet though they
differ in bits of the bottom prefix; only a sub-trie that is denser already at the
bottom stays there.  A task holds the points of a trie that share the few first bits
(some ``REGION`` points), where the climb ends.  Points may crowd in a region, as near copies
of one text do: with more than ``CROWD`` of them they are dealt into chunks by their ids, and each
pair of chunks is a task of its own.  There every two points meet as in the whole region (a chunk
is less dense, so it climbs as high or higher), and no task has more than some twice ``CROWD`` points.  A sparse sub-trie is compared all with all.  In a dense one
every component floods the sub-trie: it takes out whatever it reaches, so a
tight family of any size costs one pass, the components are exact within the
sub-trie, and the edges emitted are a spanning forest and not all pairs.  Every
pair is verified on whole signatures.  Recall against brute force is tested.

Cases: null texts and null ids are no points (such a row is in no group); texts without
words have the all-zero signature and no words, so they are copies of each
other only; rows that share a ``doc_id`` count as one document (of several
texts each is searched); repeated rows and ties change nothing, as the least
``doc_id`` of a group stays.  Long texts are hashed whole.  Of an empty table
the result is empty.  Other columns are ignored, or kept by ``near_dedup``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel
from .components import components

BITS = 256
LANES = BITS // 64
SPARE, LEAST_DEPTH = 2, 16
DENSE, REGION, CROWD = 48, 1 << 14, 1 << 20
RADIUS, RECALL, RATIO = 40, 0.93, 0.6
SEED = 20240229


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, LANES) uint64 signatures and the word counts."""
    w = kernel.words(column)
    bounds = w.bounds()
    h, row, _ = kernel.distinct(w.hash, w.row)
    u, at = np.unique(h, return_inverse=True)
    signs = np.empty((len(u), BITS), np.int8)
    for k in range(LANES):
        bits = np.unpackbits(kernel.mix(u + np.uint64((k + 1) * kernel.MULT & 0xFFFFFFFFFFFFFFFF)).view(np.uint8).reshape(-1, 8), axis=1)
        signs[:, 64 * k : 64 * k + 64] = bits
    signs *= 2
    signs -= 1
    ends = np.searchsorted(row, np.arange(w.rows + 1))
    packed = np.zeros((w.rows, BITS // 8), np.uint8)
    for r in range(w.rows):
        total = np.zeros(BITS, np.int32)
        for lo in range(ends[r], ends[r + 1], 8192):
            total += signs[at[lo : min(lo + 8192, ends[r + 1])]].sum(0, dtype=np.int32)
        packed[r] = np.packbits(total > 0)
    return packed.view(np.uint64), np.diff(bounds)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, s0 .. s3) of every document with an id and a text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kernel.groups(batch.column(1), 1 << 20):
                s, n = signatures(batch.column(1).slice(lo, hi - lo))
                lanes = [pa.array(np.ascontiguousarray(s[:, k]).view(np.int64)) for k in range(LANES)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), *lanes], ["doc_id", "n_words", *(f"s{k}" for k in range(LANES))])

    own = common.own(docs, doc_id="bigint", text="string").where("doc_id is not null and text is not null")
    return own.mapInArrow(sign, "doc_id bigint, n_words bigint, " + ", ".join(f"s{k} bigint" for k in range(LANES)))


def plan(points: int, recall: float = RECALL, radius: int = RADIUS) -> tuple[int, int]:
    """Bottom depth of the climb and number of tries for so many points: at that depth a pair ``radius`` bits apart is found with that recall."""
    depth = min(48, max(LEAST_DEPTH, math.floor(math.log2(max(points, 2))) - SPARE))
    one = math.prod(1 - radius / (BITS - i) for i in range(depth))  # bits of a path are drawn without replacement
    return depth, max(24, math.ceil(math.log(1 - recall) / math.log1p(-one)))


def permutations(tries: int) -> np.ndarray:
    """The 64 bits of the signature that make each trie's path."""
    rng = np.random.default_rng(SEED)
    return np.stack([rng.permutation(BITS)[:64] for _ in range(tries)])


def _near(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray, radius: int, ratio: float) -> np.ndarray:
    apart = np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)
    return (apart <= radius) & (np.minimum(an, bn) >= ratio * np.maximum(an, bn))


def climbed(path: np.ndarray, key: np.ndarray, depth: int) -> np.ndarray:
    """Where the sub-tries begin after the climb; rows are sorted by key, then path.

    A sub-trie is what shares the shortest prefix (within a run of equal ``key``) that at most DENSE points share, or
    one of ``depth`` bits if that is shared by more.
    """
    n = len(key)
    apart = np.ones(n, bool)
    apart[1:] = key[1:] != key[:-1]
    begins = np.ones(n, bool)
    for d in range(depth, -1, -1):
        here = apart.copy()
        if d:
            prefix = path >> np.uint64(64 - d)
            here[1:] |= prefix[1:] != prefix[:-1]
        if d == depth:
            begins = here
            continue
        first = np.flatnonzero(here)
        size = np.diff(np.append(first, n))
        begins &= here | np.repeat(size > DENSE, size)
    return np.flatnonzero(begins)


def subtrie_edges(path: np.ndarray, sig: np.ndarray, n: np.ndarray, key: np.ndarray, radius: int, ratio: float, depth: int = LEAST_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Verified edges (positions) that span the components of each sub-trie; rows are sorted by key (trie and region), then path."""
    first = climbed(path, key, depth)
    size = np.diff(np.append(first, len(key)))
    left, right = [], []
    own = np.repeat(size, size)
    run_end = np.repeat(first + size, size)
    place = np.flatnonzero((own > 1) & (own <= DENSE))
    for shift in range(1, DENSE):
        place = place[place + shift < run_end[place]]
        if not len(place):
            break
        ok = _near(sig[place], n[place], sig[place + shift], n[place + shift], radius, ratio)
        left.append(place[ok])
        right.append(place[ok] + shift)
    for lo, m in zip(first[size > DENSE].tolist(), size[size > DENSE].tolist()):
        todo = np.arange(lo, lo + m)
        while len(todo):
            wave = todo[:1]
            todo = todo[1:]
            while len(wave) and len(todo):
                at, wave = wave[0], wave[1:]
                ok = _near(sig[at], n[at], sig[todo], n[todo], radius, ratio)
                if ok.any():
                    hit = todo[ok]
                    left.append(np.full(len(hit), at))
                    right.append(hit)
                    wave = np.concatenate([wave, hit])
                    todo = todo[~ok]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_edges(points: DataFrame, count: int, radius: int = RADIUS, ratio: float = RATIO, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between the points (doc_id, n_words, s0 ..) whose components are the groups."""
    depth, tries = plan(count, radius=radius)
    top = min(depth, max(0, math.ceil(math.log2(max(count, 1) / REGION))))
    where = permutations(tries)
    names = ["doc_id", "n_words", *(f"s{k}" for k in range(LANES))]

    def placed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Part (trie and region) and path of each point in each trie."""
        sig = np.stack([np.asarray(batch.column(2 + k)).view(np.uint64) for k in range(LANES)], 1)
        bits = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1)
        for t in range(tries):
            path = np.ascontiguousarray(np.packbits(bits[:, where[t]], axis=1)).view(">u8")[:, 0].astype(np.uint64)
            region = path >> np.uint64(64 - top) if top else np.zeros_like(path)
            yield kernel.mix(region * np.uint64(tries) + np.uint64(t)).view(np.int64), path

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, n = np.unique(np.concatenate([p for p, _ in placed(batch)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n)], ["part", "n"])

    crowded: list = []
    if count > crowd:  # with fewer points no region has more; the driver receives count * tries / crowd rows at most
        crowded = points.select(*names).mapInArrow(counts, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > crowd).collect()
    full = np.array(sorted(r.part for r in crowded), np.int64)
    chunks = np.array([-(-r.n // crowd) for r in sorted(crowded, key=lambda r: r.part)], np.int64)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = (kernel.mix(np.asarray(batch.column(0)).view(np.uint64)) >> np.uint64(1)).astype(np.int64)
            for part, path in placed(batch):
                if len(full):
                    at = np.minimum(np.searchsorted(full, part), len(full) - 1)
                    g = np.where(full[at] == part, chunks[at], 1)
                    row = np.repeat(np.arange(len(part)), g)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(g) - g, g)
                    own, g = salt[row] % g[row], g[row]
                    pair = np.minimum(own, other) * g + np.maximum(own, other)
                    part = np.where(g > 1, kernel.mix(part[row].view(np.uint64) + kernel.mix((pair + 1).astype(np.uint64))).view(np.int64), part[row])
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(path[row].view(np.int64)), *(c.take(pa.array(row)) for c in batch.columns)], ["part", "path", *names])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(path.view(np.int64)), *batch.columns], ["part", "path", *names])

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last part, which may go on

        def edges(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            col = {c: t[c].to_numpy() for c in ["part", "path", *names]}
            sig = np.stack([col[f"s{k}"].view(np.uint64) for k in range(LANES)], 1)
            a, b = subtrie_edges(col["path"].view(np.uint64), sig, col["n_words"], col["part"], radius, ratio, depth)
            return pa.RecordBatch.from_arrays([pa.array(col["doc_id"][a]), pa.array(col["doc_id"][b])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.asarray(batch.column(0))
            if held and held[-1].column(0)[-1].as_py() == part[-1]:
                held.append(batch)
                continue
            end = int(np.searchsorted(part, part[-1]))
            if held or end:
                yield edges([*held, batch.slice(0, end)])
            held = [batch.slice(end)]
        if held:
            yield edges(held)

    spread = points.select(*names).mapInArrow(plant, f"part bigint, path bigint, {', '.join(f'{c} bigint' for c in names)}")
    return spread.repartition("part").sortWithinPartitions("part", "path").mapInArrow(climb, "a bigint, b bigint").where("a <> b")


def near_groups(docs: DataFrame, radius: int = RADIUS, ratio: float = RATIO) -> DataFrame:
    """(doc_id, kept_id) for every document that is a near or exact copy of another: it goes and ``kept_id`` stays."""
    sig = common.materialise(signed(docs))
    lanes = [f"s{k}" for k in range(LANES)]
    points = sig.groupBy("n_words", *lanes).agg(F.min("doc_id").alias("doc_id"))
    points = common.materialise(points)
    edges = near_edges(points, points.count(), radius, ratio)
    folded = sig.join(points.withColumnRenamed("doc_id", "b"), ["n_words", *lanes]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    found = components(edges.unionByName(folded))
    return found.where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("kept_id"))


def near_dedup(docs: DataFrame, max_broadcast_ids: int = 2_000_000) -> DataFrame:
    """The documents, all columns, without those that ``near_groups`` removes.

    The ids that go are broadcast if they are no more than ``max_broadcast_ids``, else the join shuffles.
    """
    plain, names = common.numbered(docs)
    gone = common.materialise(near_groups(docs).select("doc_id"))
    if gone.count() <= max_broadcast_ids:
        gone = F.broadcast(gone)
    return plain.join(gone, plain[f"c{names.index('doc_id')}"] == gone["doc_id"], "left_anti").toDF(*names)


def op10_simhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near or exact copy with the document that stays for it."""
    return near_groups(common.table(spark, sf_dir, "documents"))
