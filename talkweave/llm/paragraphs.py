"""Substring dedup: MinHash banding of paragraphs.

A *paragraph* here is one of three kinds of runs of words.  Lines are the first,
blocks between lines without words the second: as these are whole, some changed
words leave them over the threshold.  The third are chunks: they begin at each word whose hash with its successor's is
the least within ``REACH`` words on both sides, and line ends don't count, so that a
passage in lines of a few words has as many as the same words in one line.  These
cuts depend on nearby words only: a passage that is pasted into the middle of
another document has the same chunks there but for those at its two ends.
Punctuation doesn't matter.  Paragraphs of fewer than ``LEAST_WORDS`` words aren't
compared; chunks are as short only at the ends of a document.  The kinds overlap,
so a paragraph repeats another only if that one ends before it begins.

Identical paragraphs share a 64-bit content hash of all words.  For the others,
each paragraph's three-word shingles get ``bands * ROWS`` MinHashes; bands are
tuned so that a pair at the Jaccard threshold collides with the target
probability.  Contents that collide in any band are compared by size and by
sketch: bit i of a sketch is the parity of the number of distinct shingles that
hash to i, so two sketches never differ in more bits than the sets in shingles,
and no pair that reaches the threshold is ruled out.  Paragraphs of ``WIDE``
shingles and more have a sketch of 256 bits, shorter ones of 32.

Not all pairs of a bucket are verified.  At first each content is paired with
up to ``PARTNERS`` of those before it that sketches don't rule out; exact Jaccard
on the shingles verifies them, and connected components join what is near.
Pairs left over are verified in a second round, but only those whose contents
aren't in one component yet, as only these can change the clusters.  Keys travel in
packed blocks, content, number of distinct shingles and sketch, one block for
each task and part, and a task sends a content once however often it occurs.
Of each cluster the
first occurrence (least doc_id, then the place where it ends) stays.

A repeated *passage* is a run of paragraphs of a document that go, with gaps of
fewer than ``LEAST_WORDS`` words (such as lines too short to compare); it is
reported if it spans ``min_words`` words, so a shared heading alone is not
enough.

Cases: null texts and null ids have no paragraphs, empty ones neither; texts
of any length are cut whole; rows that share a ``doc_id`` count as one
document, so a repeated row is no repetition; repeats within one document
count.  Ties are broken by place.  Of an empty table the result is empty;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, kernel
from .components import components

REACH, LEAST_WORDS, SHINGLE, ROWS = 5, 6, 3, 4
WIDE, LANES, PARTNERS = 32, 4, 3
PART_BYTES = 12 << 20
JACCARD, RECALL, MIN_WORDS = 0.8, 0.95, 20


def tune(jaccard: float = JACCARD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` rows whose collision probability at ``jaccard`` is ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard**rows))


def cut(w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each paragraph of at least LEAST_WORDS words, each range once, in order."""
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v, row = w.hash.copy(), w.row
    same = np.zeros(n, bool)
    same[:-1] = row[1:] == row[:-1]
    nxt = np.zeros(n, np.uint64)
    nxt[:-1] = w.hash[1:]
    v = kernel.mix(v * np.uint64(5) + np.where(same, nxt, np.uint64(0)))
    low = np.ones(n, bool)
    for k in range(1, REACH + 1):
        here = row[k:] == row[:-k]
        low[k:] &= ~here | (v[k:] < v[:-k])
        low[:-k] &= ~here | (v[:-k] <= v[k:])
    breaks = np.diff(np.searchsorted(np.flatnonzero(w.data == 10), w.start), prepend=0)
    found = []
    for begins in (low, breaks > 0, breaks > 1):
        begins[1:] |= ~same[:-1]
        begins[0] = True
        first = np.flatnonzero(begins)
        found.append((first, np.diff(np.append(first, n))))
    first, size = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((size, first))
    first, size = first[order], size[order]
    ok = size >= LEAST_WORDS
    ok[1:] &= (first[1:] != first[:-1]) | (size[1:] != size[:-1])
    return first[ok], size[ok]


def content(w: kernel.Words, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of the words of each paragraph, in order."""
    if not len(first):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], size)
    h = w.hash[np.repeat(first, size) + place]
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(kernel.mix(h + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64, out=total[1:])
    return kernel.mix(total[starts[1:]] - total[starts[:-1]])


def paragraph_shingles(w: kernel.Words, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each paragraph one after the other, and where each paragraph's begin (with the end last)."""
    h = w.hash
    acc = h.copy()
    for k in range(1, SHINGLE):
        nxt = np.zeros(len(h), np.uint64)
        nxt[:-k] = h[k:]
        acc = kernel.mix(acc * np.uint64(3) + nxt)
    count = size - SHINGLE + 1
    starts = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first - starts[:-1], count) + np.arange(starts[-1])
    return acc[at], starts


def sketches(shingle: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each paragraph has, by the 32 bits that ``shingles_of`` compares, and its sketch of LANES words."""
    units = len(starts) - 1
    unit = np.repeat(np.arange(units, dtype=np.uint64), np.diff(starts))
    both = np.sort(unit << np.uint64(32) | shingle >> np.uint64(32))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    at, h = (both >> np.uint64(32)).astype(np.int64), kernel.mix(both & np.uint64(0xFFFFFFFF))
    bit, lane = np.uint64(1) << (h & np.uint64(63)), h >> np.uint64(62)
    first = np.searchsorted(at, np.arange(units))
    out = np.stack([np.bitwise_xor.reduceat(np.where(lane == k, bit, np.uint64(0)), first) for k in range(LANES)], 1) if units else np.zeros((0, LANES), np.uint64)
    return np.bincount(at, minlength=units), out


def band_keys(shingle: np.ndarray, starts: np.ndarray, bands: int) -> list[np.ndarray]:
    """The key of each paragraph in each band; a MinHash is the least product with an odd number, as shingles are mixed already."""
    out, seeds = [], kernel.mix(np.arange(1, bands * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    for b in range(bands):
        key = np.full(len(starts) - 1, b + 1, np.uint64)
        for seed in seeds[b * ROWS : (b + 1) * ROWS]:
            key = kernel.mix(key * np.uint64(3) + np.minimum.reduceat(shingle * seed ^ seed, starts[:-1]))
        out.append(key)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return common.own(docs, doc_id="bigint", text="string").where("doc_id is not null and text is not null")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo, hi in kernel.groups(batch.column(1), 2 << 20):
            w = kernel.words(batch.column(1).slice(lo, hi - lo))
            first, size = cut(w)
            if len(first):
                yield np.asarray(batch.column(0).slice(lo, hi - lo)), w, first, size, content(w, first, size)


def paragraphs(docs: DataFrame, some: Broadcast | None = None) -> DataFrame:
    """(content, doc_id, at, n): every paragraph (of ``some`` contents), with the place of its first word and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w, first, size, c in _each(batches):
            if some is not None:
                ok = _among(c.view(np.int64), some.value)
                first, size, c = first[ok], size[ok], c[ok]
            row = w.row[first]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(ids[row]), pa.array((first - w.bounds()[row]).astype(np.int32)), pa.array(size.astype(np.int32))], ["content", "doc_id", "at", "n"])

    return _texts(docs).mapInArrow(run, "content bigint, doc_id bigint, at int, n int")


def _low(x: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number."""
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def pack(key: np.ndarray, content_: np.ndarray, count: np.ndarray, sketch: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, wide, block): keys (of each content in each band), contents, counts and sketches by part of the key space.

    A record has 5 bytes of the key, 8 of the content, and 1 + 4 of count and sketch, or 2 + 32 if wide.
    """
    big = count >= WIDE
    for wide in (False, True):
        own = np.flatnonzero(big if wide else ~big)
        k = key[:, own].ravel()
        part = ((k >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(ends))
        blocks = []
        for a, b in zip(ends[some].tolist(), ends[some + 1].tolist()):
            at = order[a:b]
            unit = own[at % max(len(own), 1)]
            n, s = np.minimum(count[unit], 65535), sketch[unit]
            blocks.append(_low(k[at], 5) + _low(content_[unit], 8) + _low(n, 2 if wide else 1) + (s.astype("<u8").tobytes() if wide else _low(narrow(s), 4)))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), wide)), pa.array(blocks, pa.binary())], ["part", "wide", "block"])


def narrow(sketch: np.ndarray) -> np.ndarray:
    """Sketches of 32 bits: parities again."""
    one = np.bitwise_xor.reduce(sketch, axis=1)
    return (one ^ one >> np.uint64(32)) & np.uint64(0xFFFFFFFF)


def unpack(part: int, wide: bool, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (40 bits, under the part), contents, counts and sketches (a narrow one is in the first lane) of a block."""
    sizes, at = (5, 8, 2, 8 * LANES) if wide else (5, 8, 1, 4), 0
    n, out = len(block) // sum(sizes), []
    for size in sizes:
        own = np.frombuffer(block, np.uint8, n * size, at).reshape(n, size)
        wider = np.zeros((n, max(8, size)), np.uint8)
        wider[:, :size] = own
        out.append(wider.view("<u8"))
        at += n * size
    sketch = np.zeros((n, LANES), np.uint64)
    sketch[:, : out[3].shape[1]] = out[3]
    return out[0][:, 0] | np.uint64(part << 40), out[1][:, 0], out[2][:, 0].astype(np.int64), sketch


class Seen:
    """Contents that a task has sent, in sorted runs whose lengths double."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def new(self, c: np.ndarray) -> np.ndarray:
        """Which of the distinct, sorted ``c`` weren't there yet; they are now."""
        fresh = np.ones(len(c), bool)
        for run in self.runs:
            fresh &= run[np.minimum(np.searchsorted(run, c), len(run) - 1)] != c
        if fresh.any():
            self.runs.append(c[fresh])
            while len(self.runs) > 1 and len(self.runs[-2]) <= 2 * len(self.runs[-1]):
                self.runs[-2:] = [np.sort(np.concatenate(self.runs[-2:]), kind="stable")]
        return fresh


def may_be_near(n: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray, jaccard: float) -> np.ndarray:
    """Which of the places (a, b) may reach the threshold, by counts and sketches; counts of 65535 and more aren't known."""
    x, y = n[a], n[b]
    ok = (np.minimum(x, y) >= jaccard * np.maximum(x, y)) | (x == 65535) | (y == 65535)
    a, b, x, y = a[ok], b[ok], x[ok], y[ok]
    apart = sketch[a] ^ sketch[b]
    bits = np.bitwise_count(apart).sum(1, dtype=np.int64)  # of two narrow or two wide ones
    mixed = (x >= WIDE) != (y >= WIDE)
    one, two = ((narrow(sketch[i[mixed]]), sketch[i[mixed], 0], z[mixed] >= WIDE) for i, z in ((a, x), (b, y)))
    bits[mixed] = np.bitwise_count(np.where(one[2], one[0], one[1]) ^ np.where(two[2], two[0], two[1]))
    ok[ok] = (bits <= (1 - jaccard) / (1 + jaccard) * (x + y) + 1e-9) | (x == 65535) | (y == 65535)
    return ok


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of each one's run of equal keys, and where it ends."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    return np.repeat(size, size), np.repeat(first + size, size)


def bucket_pairs(key: np.ndarray, n: np.ndarray, sketch: np.ndarray, jaccard: float, apart: np.ndarray | None = None, partners: int = 1 << 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (a, b) within runs of equal keys that may be near, up to ``partners`` of them for each b, and which places have more.

    With ``apart`` (a label of each place) only those of different labels.
    """
    size, end = _runs(key)
    left, right = [], []
    given, more = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at, shift = np.flatnonzero(size > 1), 1
    while len(at):
        at = at[at + shift < end[at]]
        a = at if apart is None else at[apart[at] != apart[at + shift]]
        for lo in range(0, len(a), 1 << 20):
            x = a[lo : lo + (1 << 20)]
            x = x[may_be_near(n, sketch, x, x + shift, jaccard)]
            room = given[x + shift] < partners
            more[x[~room]] = more[x[~room] + shift] = True
            x = x[room]
            given[x + shift] += 1
            left.append(x)
            right.append(x + shift)
        shift += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), more


REST = "bucket bigint, content bigint, n bigint, " + ", ".join(f"s{k} bigint" for k in range(LANES))


def colliding(docs: DataFrame, bands: int, jaccard: float = JACCARD) -> DataFrame:
    """Distinct contents that share a band key and may be near: pairs (a, b) of the first round, and the rest (bucket, content, ...) for the second."""
    parts = parts_of(docs, bands)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, Seen()

        def sent() -> Iterator[pa.RecordBatch]:
            key, c, n, sketch = zip(*held)
            return pack(np.concatenate(key, axis=1), np.concatenate(c), np.concatenate(n), np.concatenate(sketch), parts)

        for _, w, first, n, c in _each(batches):
            c, at = np.unique(c, return_index=True)
            new = seen.new(c)
            c, at = c[new], at[new]
            if not len(c):
                continue
            shingle, starts = paragraph_shingles(w, first[at], n[at])
            held.append((np.stack(band_keys(shingle, starts, bands)), c, *sketches(shingle, starts)))
            size += len(c)
            if size > 100_000:
                yield from sent()
                held, size = [], 0
        if held:
            yield from sent()

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpack(*x) for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns))]
        if not held:
            return
        k, c, n, s = (np.concatenate(x) for x in zip(*held))
        del held
        c = c.view(np.int64)
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c, order = k[new], c[new], order[new]
        own = np.flatnonzero(_runs(k)[0] > 1)
        k, c, n, s = k[own], c[own], n[order[own]], s[order[own]]
        a, b, more = bucket_pairs(k, n, s, jaccard, partners=PARTNERS)
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c[a]), pa.array(c[b])] + [none] * (3 + LANES), ["a", "b", *(x.split()[0] for x in REST.split(", "))])
        at = np.flatnonzero(more)
        none = pa.nulls(len(at), pa.int64())
        rest = [pa.array(k[at].view(np.int64)), pa.array(c[at]), pa.array(n[at]), *(pa.array(np.ascontiguousarray(s[at, i]).view(np.int64)) for i in range(LANES))]
        yield pa.RecordBatch.from_arrays([none, none, *rest], ["a", "b", *(x.split()[0] for x in REST.split(", "))])

    spread = _texts(docs).mapInArrow(keys, "part int, wide boolean, block binary")
    return spread.repartitionById(parts, F.col("part")).mapInArrow(pairs, f"a bigint, b bigint, {REST}")


def parts_of(docs: DataFrame, bands: int) -> int:
    """So many parts that each holds some ``PART_BYTES`` of keys: there is one for some 70 bytes of text."""
    size = _texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(1, least, size // 70 * bands * 20 // PART_BYTES), 1 << 20)


def left_over(rest: DataFrame, near: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """(a, b): pairs of the ``rest`` of the buckets that may be near and aren't in one component of ``near`` (node, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last bucket, which may go on

        def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            col = [t[i].to_numpy() for i in range(t.num_columns)]
            sketch = np.stack([x.view(np.uint64) for x in col[3 : 3 + LANES]], 1)
            a, b, _ = bucket_pairs(col[0], col[2], sketch, jaccard, apart=col[-1])
            x, y = col[1][a], col[1][b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = np.asarray(batch.column(0))
            if held and held[-1].column(0)[-1].as_py() == bucket[-1]:
                held.append(batch)
                continue
            end = int(np.searchsorted(bucket, bucket[-1]))
            if held or end:
                yield pairs([*held, batch.slice(0, end)])
            held = [batch.slice(end)]
        if held:
            yield pairs(held)

    own = rest.join(near.withColumnRenamed("node", "content"), "content", "left").withColumn("component", F.coalesce("component", "content"))
    own = own.select(*(x.split()[0] for x in REST.split(", ")), "component")
    several = own.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    own = own.join(several, "bucket", "left_semi")
    return own.repartition("bucket").sortWithinPartitions("bucket", "content").mapInArrow(run, "a bigint, b bigint").distinct()


def wanted(contents: DataFrame, most: int) -> Broadcast | None:
    """The contents in order, broadcast if they are no more than ``most`` (8 bytes each)."""
    if contents.count() > most:
        return None
    got = np.sort(contents.select("content").toArrow()["content"].to_numpy())
    return contents.sparkSession.sparkContext.broadcast(got)


def _among(c: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, c), len(known) - 1)] == c if len(known) else np.zeros(len(c), bool)


def shingles_of(docs: DataFrame, contents: DataFrame, max_broadcast: int = 4_000_000) -> DataFrame:
    """(content, shingles) of the wanted contents; these are broadcast up to ``max_broadcast``, else joined in a shuffle."""
    some = wanted(contents, max_broadcast)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w, first, size, c in _each(batches):
            c, at = np.unique(c.view(np.int64), return_index=True)
            first, size = first[at], size[at]
            if some is not None:
                ok = _among(c, some.value)
                first, size, c = first[ok], size[ok], c[ok]
            if len(first):
                h, starts = paragraph_shingles(w, first, size)
                h = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(h))], ["content", "shingles"])

    found = _texts(docs).mapInArrow(run, "content bigint, shingles array<int>")
    if some is None:
        found = found.join(contents, "content", "left_semi")
    return found.groupBy("content").agg(F.array_distinct(F.min("shingles")).alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """The pairs whose shingles (content, shingles) have at least that Jaccard similarity."""
    both = pairs.join(sets.select(F.col("content").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("content").alias("b"), F.col("shingles").alias("y")), "b")
    common_ = F.size(F.array_intersect("x", "y"))
    return both.where(common_ >= F.lit(jaccard) * (F.size("x") + F.size("y") - common_)).select("a", "b")


def near_pairs(docs: DataFrame, jaccard: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """(a, b): near contents, enough of them that their components are those of all near contents that collide."""
    found = common.materialise(colliding(docs, tune(jaccard, recall), jaccard))
    pairs = common.materialise(found.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rest = found.where("a is null").drop("a", "b")
    contents = pairs.select(F.col("a").alias("content")).unionByName(pairs.select(F.col("b").alias("content"))).unionByName(rest.select("content"))
    sets = common.materialise(shingles_of(docs, common.materialise(contents.distinct())))
    first = common.materialise(verified(pairs, sets, jaccard))
    second = common.materialise(left_over(rest, components(first), jaccard))
    return first.unionByName(verified(second, sets, jaccard))


def repeated_passages(docs: DataFrame, jaccard: float = JACCARD, min_words: int = MIN_WORDS, max_broadcast: int = 4_000_000) -> DataFrame:
    """(doc_id, first_word, n_words, kept_doc_id): passages that repeat what another place has; that place stays."""
    common.need(docs, "doc_id", "text")
    cluster = common.materialise(components(near_pairs(docs, jaccard)).select(F.col("node").alias("content"), "component"))
    end = F.col("at") + F.col("n")
    per = paragraphs(docs).groupBy("content").agg(F.min(F.struct("doc_id", end.alias("end"))).alias("first"), F.count("*").alias("times")).join(cluster, "content", "left")
    per = per.where("times > 1 or component is not null").select("content", F.coalesce("component", "content").alias("cluster"), "first")
    kept = common.materialise(per)
    kept = common.materialise(kept.join(kept.groupBy("cluster").agg(F.min("first").alias("kept")), "cluster").select("content", "kept"))
    units = paragraphs(docs, wanted(kept.select("content"), max_broadcast))  # with more, the join below shuffles all of them
    gone = units.join(kept, "content").where("kept.doc_id < doc_id or kept.doc_id = doc_id and kept.end <= at")
    gone = gone.groupBy("doc_id", "at").agg(F.max("n").alias("n"), F.min("kept.doc_id").alias("kept_doc_id"))
    by = Window.partitionBy("doc_id").orderBy("at")
    gone = gone.withColumn("fresh", (F.col("at") >= F.coalesce(F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-LEAST_WORDS)) + LEAST_WORDS).cast("int"))
    gone = gone.withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = gone.groupBy("doc_id", "run").agg(F.min("at").alias("first_word"), (F.max(end) - F.min("at")).alias("n_words"), F.min("kept_doc_id").alias("kept_doc_id"))
    return runs.where(F.col("n_words") >= min_words).select("doc_id", "first_word", "n_words", "kept_doc_id")


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of the documents and where its like stays."""
    return repeated_passages(common.table(spark, sf_dir, "documents"))
