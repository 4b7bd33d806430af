"""Toxicity: maximum-scoring segments of token log-odds.

Votes: labelled documents vote for or against their words, each word once a
document.  Near copies have one vote a class between them: documents of a class
whose sets of three-word shingles collide in one of ``BANDS`` MinHash bands
with a document of lesser hash don't vote.  So a text that was copied a
thousand times is no more evidence than one that wasn't.

Weights: a word with a toxic and c clean votes is toxic if a binomial test of
its share against the share of toxic votes over all words (Chernoff's bound on
the tail, p <= exp(-n KL)) holds at a false-discovery rate of ``FALSE``
(Benjamini-Hochberg) over all words that could reach it (Tarone: a word with so
few votes that even unanimous ones can't be significant isn't tested).  Its
weight is the log-odds ratio of toxic to clean documents with an informative
Dirichlet prior, whose pseudo-counts are the word's document frequencies over
the *whole* corpus (``PRIOR`` documents' worth); words of at least
``LEAST_SCORE`` score it, and every other word scores ``-DRIFT``.

Segments: one linear scan of a text's scores finds all maximal scoring
segments (disjoint; none can be extended or split with gain).  Only scoring
words are stepped through, as the sum over a gap is its length times -DRIFT.

Calibration: on clean text the greatest score of n words follows an extreme
value law, P(max >= x) = 1 - exp(-K n exp(-lambda x)), with lambda from the
score frequencies of held-out clean documents and K by maximum likelihood from
their greatest scores.  The r-th best segment has
E_r = K n exp(-lambda S_r) and P_r = P(Poisson(E_r) >= r); a document's p is
the least 2^r P_r over all ranks (in logarithms, so for any E_r), so one strong passage or several weaker ones count alike.
It is toxic if p <= ``ALPHA``; its passages are then those up to the rank r of
that least value, and any other with E_r <= 0.05.

Cases: null and empty texts are clean.  Texts of any length are scanned whole.
Repeated rows give repeated results; a null ``doc_id`` is carried through.
Several labels of one id: toxic if any is; several texts of one id: the least
votes.  With no toxic or no clean label nothing is toxic.  Of an empty table
the result is empty; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernel

PRIOR, LEAST_SCORE, FALSE, DRIFT, ALPHA = 20.0, 2.0, 0.01, 0.2, 1e-3
BANDS, ROWS = 16, 4
PASSAGE = "array<struct<first_word:int,last_word:int,score:double>>"


@dataclass
class Lexicon:
    """Hashes of scoring words in order, their scores, lambda and K."""

    words: np.ndarray
    scores: np.ndarray
    rate: float = 1.0
    k: float = 1.0

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of scoring words, and their scores."""
        if not len(self.words) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        found = np.flatnonzero(self.words[at] == h)
        return found, self.scores[at[found]]


def segments(place: list[int], score: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text whose words at ``place`` score and others cost ``drift``."""
    open_: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    total, at = 0.0, -1
    for t, s in zip(place, score):
        total -= drift * (t - at - 1)
        before, first = total, t
        total += s
        at = t
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][0] >= before:
                j -= 1
            if j < 0 or open_[j][1] >= total:
                break
            before, first = open_[j][0], open_[j][2]
            del open_[j:]
        open_.append((before, total, first, t))
    return [(a, b, y - x) for x, y, a, b in open_]


def log_term(log_expected: float, r: int) -> float:
    """Logarithm of P(Poisson(expected) = r)."""
    return r * log_expected - math.exp(log_expected) - math.lgamma(r + 1)


def log_tail(log_expected: float, r: int) -> float:
    """Logarithm of P(Poisson(expected) >= r), precise where that is small."""
    if r <= 0:
        return 0.0
    expected = math.exp(log_expected)
    up = r > expected  # else the terms below r are summed, from the largest
    term, total, i = 1.0, 0.0, r if up else r - 1
    first = log_term(log_expected, i)
    while term > total * 1e-17:
        total += term
        i += 1 if up else -1
        term *= expected / i if up else (i + 1) / expected
    value = first + math.log(total)
    return min(value, 0.0) if up else math.log1p(-min(math.exp(value), 1 - 1e-16))


def tail(expected: float, r: int) -> float:
    """P(Poisson(expected) >= r)."""
    return math.exp(log_tail(math.log(expected), r)) if expected > 0 else float(r <= 0)


def judge(lexicon: Lexicon, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float]]]:
    """p of a document of ``n`` words, and its significant passages."""
    least, rank, alone = 0.0, 0, 0
    ranked = sorted(found, key=lambda s: (-s[2], s[0]))
    for r, s in enumerate(ranked, 1):
        expected = math.log(lexicon.k * n) - lexicon.rate * s[2]
        if expected <= math.log(0.05):
            alone = r
        # 2^r P_r is under 1 only if r is over E_r, and at least its first term: most ranks need no sum
        if math.log(r) > expected and r * math.log(2) + log_term(expected, r) < least and (own := r * math.log(2) + log_tail(expected, r)) < least:
            least, rank = own, r
    p = math.exp(least)
    return p, sorted(ranked[: max(alone, rank if p <= ALPHA else 0)])


def lexicon_of(vocabulary: np.ndarray, toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray, corpus_docs: float, docs: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Scoring words and their scores, from the votes for the significant words ``vocabulary`` (sorted hashes) in each class and their corpus counts."""
    alpha = PRIOR * (corpus + 0.5) / (corpus_docs + 1)
    odds = [np.log((y + alpha) / np.maximum(n + PRIOR - y - alpha, 0.5)) for y, n in ((toxic, docs[0]), (clean, docs[1]))]
    delta = odds[0] - odds[1]
    chosen = delta >= LEAST_SCORE
    return vocabulary[chosen], delta[chosen]


def calibrate(lexicon: Lexicon, n: np.ndarray, best: np.ndarray, count: np.ndarray) -> Lexicon:
    """Sets lambda and K from clean texts: their word counts, greatest segment scores, and how often each scoring word occurs in them all."""
    p = (count + 1.0 / max(len(lexicon.words), 1)) / (n.sum() + 1)
    rest = 1 - p.sum()
    lo, hi = 1e-6, 60.0
    for _ in range(200):
        mid = (lo + hi) / 2
        value = rest * math.exp(-mid * DRIFT) + float((p * np.exp(np.minimum(mid * lexicon.scores, 700))).sum())
        lo, hi = (mid, hi) if value < 1 else (lo, mid)
    lexicon.rate = max(lo, 1e-3)
    lexicon.k = float((n > 0).sum() / max((n * np.exp(-lexicon.rate * best)).sum(), 1e-9)) if (n > 0).any() else 1.0
    return lexicon


def clean_scores(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``calibrate`` needs of the texts of ``rows``; of a text only its figures reach the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for lo, hi in kernel.groups(batch.column(0)):
                w = kernel.words(batch.column(0).slice(lo, hi - lo))
                bounds = w.bounds()
                at, score = known.hits(w.hash)
                ends, best = np.searchsorted(at, bounds), np.zeros(w.rows)
                for r in np.flatnonzero(np.diff(ends)).tolist():
                    a, b = ends[r], ends[r + 1]
                    best[r] = max(s for _, _, s in segments((at[a:b] - bounds[r]).tolist(), score[a:b].tolist()))
                word, n = np.unique(np.searchsorted(known.words, w.hash[at]), return_counts=True)
                none = [None] * (w.rows - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.diff(bounds)), pa.array(best), pa.array([word.tolist(), *none], pa.list_(pa.int64())), pa.array([n.tolist(), *none], pa.list_(pa.int64()))], ["n", "best", "word", "times"]
                )

    got = rows.select("text").mapInArrow(run, "n bigint, best double, word array<bigint>, times array<bigint>").collect()
    count = np.zeros(len(lexicon.words))
    for r in got:
        if r.word:
            count[r.word] += r.times
    got.sort(key=lambda r: (r.n, r.best))
    return np.array([r.n for r in got], float), np.array([r.best for r in got], float), count


def corpus_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each word of ``vocabulary`` occurs, and how many documents have words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        count, some = np.zeros(len(known) + 1, np.int64), 0
        for batch in batches:
            for lo, hi in kernel.groups(batch.column(0)):
                w = kernel.words(batch.column(0).slice(lo, hi - lo))
                some += int((np.diff(w.bounds()) > 0).sum())
                at = np.minimum(np.searchsorted(known, w.hash), max(len(known) - 1, 0))
                ok = known[at] == w.hash if len(known) else np.zeros(len(w.hash), bool)
                one = np.unique(w.row[ok] * np.int64(len(known) + 1) + at[ok])
                count += np.bincount(one % (len(known) + 1), minlength=len(known) + 1)
        count[-1] = some
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["word", "n"])

    got = docs.select("text").where("text is not null").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(len(vocabulary) + 1, np.int64)
    for word, n in got:
        count[word] = n
    return count[:-1], int(count[-1])


def sketches(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, bands) of the wanted ids, one row each: the hash of its text and its MinHash band keys (none if it has no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kernel.groups(batch.column(2)):
                h, row = kernel.shingles(kernel.words(batch.column(2).slice(lo, hi - lo)), 3)
                keys = [[]] * (hi - lo)
                if len(h):
                    new = np.ones(len(row), bool)
                    new[1:] = row[1:] != row[:-1]
                    first = np.flatnonzero(new)
                    found = np.zeros((len(first), BANDS), np.uint64)
                    for b in range(BANDS):
                        for r in range(ROWS):
                            seed = np.uint64((b * ROWS + r + 1) * kernel.MULT & 0xFFFFFFFFFFFFFFFF)
                            found[:, b] = kernel.mix(found[:, b] * np.uint64(3) + np.minimum.reduceat(kernel.mix(h ^ seed), first))
                    for r, k in zip(row[first].tolist(), (found >> np.uint64(33)).astype(np.int64).tolist()):
                        keys[r] = k
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(keys, pa.list_(pa.int32()))], ["doc_id", "text", "bands"])

    rows = docs.where("text is not null").join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return common.one_a_doc(rows.mapInArrow(run, "doc_id bigint, text bigint, bands array<int>"), "text", "bands")


def voters(toxic: np.ndarray, bands: list[list[int]]) -> np.ndarray:
    """Which documents (in order of their hash) vote: those with words that collide with none before them of their class."""
    out = np.array([bool(b) for b in bands], bool)
    at = np.flatnonzero(out)
    if not len(at):
        return out
    keys = np.array([bands[i] for i in at], np.int64) * 2 + toxic[at][:, None]
    for column in keys.T:
        _, first = np.unique(column, return_index=True)
        new = np.zeros(len(at), bool)
        new[first] = True
        out[at] &= new
    return out


def votes(docs: DataFrame, voting: DataFrame) -> DataFrame:
    """(word, toxic, clean): how many documents of ``voting`` (doc_id, h, toxic) of each class have the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kernel.groups(batch.column(0)):
                w = kernel.words(batch.column(0).slice(lo, hi - lo))
                side = np.asarray(batch.column(1).slice(lo, hi - lo)).astype(np.int64)
                h, row, _ = kernel.distinct(w.hash, w.row)
                u, at = np.unique(h, return_inverse=True)
                toxic = np.bincount(at, side[row], len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(u)) - toxic)], ["word", "toxic", "clean"])

    rows = docs.where("text is not null").join(F.broadcast(voting), "doc_id").where(F.xxhash64("text") == F.col("h"))
    rows = rows.dropDuplicates(["doc_id"]).select("text", "toxic")  # a row that is there twice votes once
    return rows.mapInArrow(run, "word bigint, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def least_votes(sizes: dict[int, int], share: float) -> tuple[int, int]:
    """The least number of votes with which a word can be significant at all, and how many words have so many (``sizes``: words by votes)."""
    tested = sum(sizes.values())
    for n in range(1, max(sizes, default=0) + 1):
        if n * math.log(share) <= math.log(FALSE / max(tested, 1)):
            return n, tested
        tested -= sizes.get(n, 0)
    return max(sizes, default=0) + 1, 0


def discoveries(log_p: np.ndarray, tested: int) -> np.ndarray:
    """Which of these p-values (logarithms) hold at the false-discovery rate among so many tests, all others being greater."""
    order = np.argsort(log_p, kind="stable")
    good = np.flatnonzero(log_p[order] <= np.log(FALSE * np.arange(1, len(log_p) + 1) / max(tested, 1)))
    out = np.zeros(len(log_p), bool)
    out[order[: good[-1] + 1 if len(good) else 0]] = True
    return out


def significant(counted: DataFrame) -> list:
    """Rows (word, toxic, clean) of the words whose share of toxic votes is significantly high."""
    by_size = counted.groupBy((F.col("toxic") + F.col("clean")).alias("n")).agg(F.count("*").alias("words"), F.sum("toxic").alias("toxic")).collect()
    every, toxic = sum(r.n * r.words for r in by_size), sum(r.toxic for r in by_size)
    if not 0 < toxic < every:
        return []
    share = toxic / every
    least, tested = least_votes({r.n: r.words for r in by_size}, share)
    a, n = F.col("toxic"), F.col("toxic") + F.col("clean")
    log_p = -(a * F.log(a / (n * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0))
    got = counted.where((n >= least) & (a > n * share)).withColumn("log_p", log_p).where(F.col("log_p") <= math.log(FALSE)).collect()
    chosen = discoveries(np.array([r.log_p for r in got]), tested)
    return [r for r, ok in zip(got, chosen) if ok]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 50000, calibration_rows: int = 2000, seed: int = 3) -> Lexicon:
    """Fits the lexicon on at most ``sample_rows`` labelled documents and calibrates on at most ``calibration_rows`` others.

    Texts are used whole. The driver receives a sketch of each of these documents, the words that are significant by
    themselves and a few figures of each text that calibrates. Prior counts are of all documents.
    """
    docs, labels = common.own(docs, doc_id="bigint", text="string"), common.own(labels, doc_id="bigint", toxic="int").where("doc_id is not null and toxic is not null")
    spark, none = docs.sparkSession, Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    ids = common.materialise(common.sampled_ids(labels, sample_rows + calibration_rows, seed))
    known = labels.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = sketches(docs, ids).join(F.broadcast(known), "doc_id").withColumn("place", F.xxhash64(F.lit(seed), "doc_id"))
    got = sorted(rows.collect(), key=lambda r: (r.place, r.doc_id))
    toxic = np.array([r.toxic for r in got], np.int64)
    voting = np.flatnonzero(voters(toxic, [r.bands for r in got]))
    apart = min(calibration_rows, len(voting) // 5)
    held, fit_ = voting[:apart][toxic[voting[:apart]] == 0], voting[apart:]
    sides = int(toxic[fit_].sum()), int((1 - toxic[fit_]).sum())
    if not all(sides):
        return none
    rows_at = lambda at: spark.createDataFrame([(got[i].doc_id, got[i].text, got[i].toxic) for i in at.tolist()], "doc_id bigint, h bigint, toxic int")
    words_ = significant(common.materialise(votes(docs, rows_at(fit_))))
    if not words_:
        return none
    vocabulary = np.array([r.word for r in words_], np.int64).view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary = vocabulary[order]
    yes, no = (np.array([r[k] for r in words_], float)[order] for k in ("toxic", "clean"))
    corpus, corpus_docs = corpus_counts(docs, vocabulary)
    words, scores = lexicon_of(vocabulary, yes, no, corpus, corpus_docs, sides)
    if not len(words):
        return none
    lexicon = Lexicon(words, scores)
    clean = docs.where("text is not null").join(F.broadcast(rows_at(held)), "doc_id").where(F.xxhash64("text") == F.col("h")).dropDuplicates(["doc_id"])
    return calibrate(lexicon, *clean_scores(clean, lexicon))


def toxic_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, n_words, p_value, score, passages) of every toxic document; score is that of its best passage."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out: list[tuple] = []
            for lo, hi in kernel.groups(batch.column(1)):
                w = kernel.words(batch.column(1).slice(lo, hi - lo))
                bounds = w.bounds()
                at, score = known.hits(w.hash)
                ends = np.searchsorted(at, bounds)
                for r in np.flatnonzero(np.diff(ends)).tolist():
                    a, b, n = ends[r], ends[r + 1], int(bounds[r + 1] - bounds[r])
                    found = segments((at[a:b] - bounds[r]).tolist(), score[a:b].tolist())
                    p, passages = judge(known, n, found)
                    if p <= ALPHA:
                        out.append((batch.column(0)[lo + r].as_py(), n, float(f"{p:.6g}"), round(max(s for _, _, s in found), 6), [{"first_word": x, "last_word": y, "score": round(s, 6)} for x, y, s in passages]))
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64())]))]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "n_words", "p_value", "score", "passages"])

    return common.own(docs, doc_id="bigint", text="string").where("text is not null").mapInArrow(run, f"doc_id bigint, n_words int, p_value double, score double, passages {PASSAGE}")


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every toxic document with its passages."""
    docs = common.table(spark, sf_dir, "documents")
    return toxic_documents(docs, fit(docs, common.table(spark, sf_dir, "labels")))
