"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A text is cut by the vocabulary's pattern; within each piece the adjacent pair
of least rank, leftmost on ties, merges until no pair is in the vocabulary.
The leaves of a segment tree hold ``rank << POS | position`` of each adjacent
pair, so that the root is the next merge; a merge changes three leaves and the
nodes above them.  Two forms of the same tree are used: for many short pieces
the trees of all distinct pieces of a batch stand side by side in numpy arrays
and advance together, one merge each a round; a long piece has a tree of its
own.  Pieces already seen by a worker process come from a cache, which changes no
result and is bounded in bytes too: pieces of more than ``WIDE`` bytes, which
seldom come again, don't go in.

The vocabulary file (base64 token, rank) is read by the driver from the path
given and travels to the executors as a broadcast of fixed size (that of the
vocabulary and its pair table, which the workers don't build again).

Cases: a null text gives null tokens, null text back, and ``exact`` null; an
empty text no tokens.  Texts of any length are encoded whole.  Repeated rows
give repeated results; other columns are ignored.  Of an empty table the result
is empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common, kernel

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
POS = 32
NONE = np.int64(1) << 62
WIDE = 64
CACHE = 200_000
FRESH = 65536


class Merges:
    """The vocabulary and its pair table: (left, right) -> id of the merged token."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.cache: dict[str, bytes] = {}  # of this process only
        ids = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ids[t[:k]], ids[t[k:]]): i for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        size = 1 << (4 * max(len(pairs), 1) - 1).bit_length()
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.slot, self.rank = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        for (a, b), r in pairs.items():
            at = (((a << 32 | b) * kernel.MULT) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.slot[at] >= 0:
                at = (at + 1) % size
            self.slot[at], self.rank[at] = a << 32 | b, r

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def rank_of(self, a: int, b: int) -> int:
        """``ranks`` for one pair."""
        key, slot = a << 32 | b, self.slot
        at = ((key * kernel.MULT) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (held := slot.item(at)) != key:
            if held < 0:
                return -1
            at = (at + 1) % len(slot)
        return self.rank.item(at)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of merged pairs; -1 where there is none."""
        key = a << 32 | b
        at = ((key.astype(np.uint64) * np.uint64(kernel.MULT)) >> self.shift).astype(np.int64)
        out = np.where(self.slot[at] == key, self.rank[at], np.int64(-1))
        far = np.flatnonzero((self.slot[at] != key) & (self.slot[at] >= 0))
        while len(far):
            at[far] = (at[far] + 1) % len(self.slot)
            held = self.slot[at[far]]
            hit = held == key[far]
            out[far[hit]] = self.rank[at[far[hit]]]
            far = far[~hit & (held >= 0)]
        return out

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece with a tree of its own."""
        ids = [int(self.byte[b]) for b in piece]
        n, rank_of = len(ids), self.rank_of
        if n < 2:
            return ids
        width = 1 << (n - 2).bit_length()
        none = int(NONE)
        met: dict[int, int] = {}  # ranks of this piece's pairs

        def leaf(i: int, j: int) -> int:
            if i < 0 or j >= n:
                return none
            key = ids[i] << POS | ids[j]
            if (r := met.get(key)) is None:
                r = rank_of(ids[i], ids[j])
                if len(met) < FRESH:
                    met[key] = r
            return r << POS | i if r >= 0 else none

        tree = [none] * (2 * width)
        first = np.array(ids, np.int64)
        r = self.ranks(first[:-1], first[1:])
        tree[width : width + n - 1] = np.where(r >= 0, r << POS | np.arange(n - 1), NONE).tolist()
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before, low = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << POS) - 1

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                best = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == best:
                    break
                tree[k] = best

        while tree[1] < none:
            i = tree[1] & low
            ids[i] = tree[1] >> POS
            j = after[i]
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
            put(j, none) if j < n - 1 else None
            ids[j] = -1
            put(i, leaf(i, k))
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        return [x for x in ids if x >= 0]

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """int32 tokens of each piece, as bytes."""
        out: list[bytes] = [b""] * len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for k in np.flatnonzero(length > WIDE).tolist():
            out[k] = np.array(self.encode_long(pieces[k]), np.int32).tobytes()
        lo = 0
        for width in (1, 3, 7, 15, 31, WIDE - 1):
            at = np.flatnonzero((length > lo) & (length <= width + 1))
            lo = width + 1
            for part in np.array_split(at, -(-len(at) // 2048)) if len(at) else ():
                ids, n = self._together([pieces[k] for k in part.tolist()], length[part], width + 1)
                flat, ends = ids[np.arange(ids.shape[1]) < n[:, None]].astype(np.int32).tobytes(), np.cumsum(n) * 4
                for k, a, b in zip(part.tolist(), (ends - n * 4).tolist(), ends.tolist()):
                    out[k] = flat[a:b]
        return out

    def _together(self, pieces: list[bytes], length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Trees of pieces of up to ``size`` (a power of two) bytes, all advanced one merge a round."""
        m = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        ids = np.where(np.arange(size) < length[:, None], self.byte[raw], -1)
        tree = np.full((2 * size, m), NONE)
        for i in range(size - 1):
            some = np.flatnonzero(ids[:, i + 1] >= 0)
            r = self.ranks(ids[some, i], ids[some, i + 1])
            tree[size + i, some] = np.where(r >= 0, r << POS | i, NONE)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
        after = np.tile(np.arange(1, size + 1), (m, 1))
        before = np.tile(np.arange(-1, size), (m, 1))
        levels, low = size.bit_length() - 1, (np.int64(1) << POS) - 1

        def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray | np.int64) -> None:
            k = size + i
            tree[k, rows] = value
            for _ in range(levels):
                k = k >> 1
                tree[k, rows] = np.minimum(tree[2 * k, rows], tree[2 * k + 1, rows])

        def leaf(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            r = self.ranks(ids[rows, i], ids[rows, j])
            return np.where(r >= 0, r << POS | i, NONE)

        live = np.flatnonzero(tree[1] < NONE)
        while len(live):
            root = tree[1, live]
            i = root & low
            j = after[live, i]
            k = after[live, j]
            ids[live, i] = root >> POS
            ids[live, j] = -1
            after[live, i] = k
            put(live, j, NONE)
            on = k < length[live]
            rows, left, right = live[on], i[on], k[on]
            before[rows, right] = left
            put(rows, left, leaf(rows, left, right))
            off = live[~on]
            put(off, i[~on], NONE)
            p = before[live, i]
            has = p >= 0
            put(live[has], p[has], leaf(live[has], p[has], i[has]))
            live = live[tree[1, live] < NONE]
        kept = ids >= 0
        order = np.argsort(~kept, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), kept.sum(1)


def load(path: str = VOCABULARY) -> Merges:
    """Reads a rank file: a line for each token, base64 and rank; ranks are the ids."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(rows)
    for a, b in rows:
        tokens[int(b)] = base64.b64decode(a)
    return Merges(tokens)


class Encoder:
    """Encodes texts, with the bounded cache of pieces."""

    def __init__(self, merges: Merges, pattern: str = PATTERN):
        self.merges, self.find, self.cache = merges, regex.compile(pattern).findall, merges.cache

    def encode(self, texts: list[str]) -> list[bytes]:
        """int32 tokens of each text, as bytes."""
        one: dict[str, str] = {}  # a piece that comes again is held once
        cut = [[one.setdefault(p, p) for p in self.find(t)] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache, known = self.cache, {}
        fresh = []
        for p in one:
            if (got := cache.get(p)) is None:
                fresh.append(p)
            else:
                known[p] = got
        del one
        for lo in range(0, len(fresh), FRESH):
            part = fresh[lo : lo + FRESH]
            raw = [p.encode() for p in part]
            coded = self.merges.encode_many(raw)
            known.update(zip(part, coded))
            cache.update((p, c) for p, r, c in zip(part, raw, coded) if len(r) <= WIDE)
        return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]

    def decode(self, tokens: np.ndarray) -> str:
        got = self.merges.tokens
        return b"".join([got[k] for k in tokens.tolist()]).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens, tokens, exact): the tokens of every document, and whether decoding them gives the text again."""
    rows = common.own(docs, doc_id="bigint", text="string")
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel.give_back()
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for lo, hi in kernel.groups(batch.column(1), 1 << 20):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                gone = np.array([t is None for t in texts])
                coded = encoder.encode([t or "" for t in texts])
                values = np.frombuffer(b"".join(coded), np.int32)
                n = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
                ends = np.concatenate([[0], np.cumsum(n)])
                exact = [None if t is None else encoder.decode(values[a:b]) == t for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist())]
                offsets = pa.array(ends.astype(np.int32), pa.int32(), mask=np.append(gone, False) if gone.any() else None)
                tokens = pa.ListArray.from_arrays(offsets, pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, mask=gone), tokens, pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "tokens", "exact"])
            kernel.give_back()

    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, tokens array<int>, exact boolean")


def decode(coded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); a null array gives a null text, bytes that aren't UTF-8 the replacement sign."""
    shared = coded.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = [None if t is None else encoder.decode(np.array(t, np.int64)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return common.own(coded, doc_id="bigint", tokens="array<int>").mapInArrow(run, "doc_id bigint, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, each decoded again as a check."""
    return encode(common.table(spark, sf_dir, "documents"))
