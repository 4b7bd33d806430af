"""Classifiers, language ID, toxicity, mixing and BPE against brute force, held-out accuracy and round trips."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkweave.llm import bpe, kernel, langid, mixing, quality, toxicity

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_factorisation_identity():
    """The sum-of-squares form equals the sum over all pairs of features."""
    text, lang, source = pa.array(["alpha beta gamma beta.", "", "One two 3!"]), pa.array(["en", None, "de"]), pa.array(["a", "b", None])
    row, f, x, n = quality.features(text, lang, source)
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    got = m.score(row, f, x, 3)
    assert n.tolist() == [4, 0, 3]
    for r in range(3):
        fs, xs = f[row == r], x[row == r]
        want = 0.3 + sum(m.weight[i] * v for i, v in zip(fs, xs))
        want += sum(m.factor[fs[i]] @ m.factor[fs[j]] * xs[i] * xs[j] for i in range(len(fs)) for j in range(i))
        assert math.isclose(got[r], want, rel_tol=1e-9)


def test_features_do_not_depend_on_batches():
    t = pa.array(["Alpha, beta 1", None, "ÉTÉ naïve\nx", "alpha alpha"])
    none = pa.nulls(4, pa.string())
    row, f, x, _ = quality.features(t, none, none)
    for r in range(4):
        one = quality.features(t.slice(r, 1), none.slice(r, 1), none.slice(r, 1))
        assert f[row == r].tolist() == one[1].tolist() and x[row == r].tolist() == one[2].tolist()


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = labels.where("doc_id % 2 = 1")
    got = quality.classify(docs, quality.fit(docs, labels.where("doc_id % 2 = 0"))).join(odd, "doc_id").collect()
    good = [r for r in got if r.quality]
    bad = [r for r in got if not r.quality]
    assert sum(r.keep for r in good) >= 0.97 * len(good) and sum(not r.keep for r in bad) >= 0.8 * len(bad)


def test_language_held_out_and_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    got = langid.predict(docs.where("doc_id % 2 = 1"), model).collect()
    assert sum(r.lang == r.predicted for r in got) >= 0.97 * len(got)
    assert sum(r.keep for r in got) >= 0.98 * len(got)
    r = random.Random(1)
    noise = ["".join(r.choice("qxzjkvwbpf") for _ in range(7)) + " " for _ in range(40)]
    strange = ["".join(noise), "Быстрая коричневая лиса прыгает через ленивую собаку снова и снова", "これは日本語の文章です。犬は速く走ります", "0123 4567 !!! ???", "Ταχύς καφέ αλεπού πηδά"]
    best, sure = model.score(pa.array(strange))
    assert not ((best >= 0) & (sure >= model.threshold)).any()


def test_language_scores_equal_the_scalar_form(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs, sample_rows=100)
    texts = [r.text for r in docs.select("text").limit(20).collect()] + ["", "a", "été"]
    z, count = model.logits(pa.array(texts))
    for i, t in enumerate(texts):
        b = langid.buckets_of(t)
        assert count[i] == len(b)
        want = model.table[:, b].sum(1, dtype=np.int64) / langid.SCALE / max(len(b), 1) + np.append(model.bias, 0)
        assert np.allclose(z[i], want, atol=1e-12)


def brute_segments(scores):
    """Maximal scoring segments by their definition: the best (shortest) segment, then the same left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            s = sum(scores[i : j + 1])
            if s > 0 and (best is None or s > best[2] or s == best[2] and j - i < best[1] - best[0]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return brute_segments(scores[:i]) + [best] + [(a + j + 1, b + j + 1, c) for a, b, c in brute_segments(scores[j + 1 :])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=18))
def test_segments_are_all_the_maximal_ones(kinds):
    """The segments themselves, of scores in which no two sums are equal; all other words cost 1."""
    scores = [-1.0 if k == 0 else k + 2.0**-i / 3 for i, k in enumerate(kinds, 2)]
    place = [i for i, s in enumerate(scores) if s > 0]
    got = toxicity.segments(place, [scores[i] for i in place], drift=1.0)
    want = brute_segments([Fraction(s) for s in scores])
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(math.isclose(x[2], float(y[2]), abs_tol=1e-9) for x, y in zip(got, want))


def test_poisson_tail():
    for e in (1e-9, 0.01, 0.7, 5.0):
        for r in (1, 2, 5):
            want = 1 - sum(math.exp(-e) * e**i / math.factorial(i) for i in range(r))
            assert math.isclose(toxicity.tail(e, r), want, rel_tol=1e-6, abs_tol=1e-12)


def equal_passages(count, expected):
    """A lexicon, a number of words and so many equal segments of that E, then two of E = 90."""
    lexicon, n = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0), rate=1.0, k=1.0), 10**6
    strong = [(10 * i, 10 * i + 3, math.log(n / expected)) for i in range(count)]
    return lexicon, n, strong, [*strong, (10**5, 10**5 + 1, math.log(n / 90)), (10**5 + 9, 10**5 + 9, math.log(n / 90))]


def test_passages_up_to_the_rank_of_p():
    """Passages that are significant together are all reported, and trivial ones after them aren't."""
    for count, expected in ((6, 0.1), (4, 0.06), (1, 0.0001), (9, 0.7)):
        lexicon, n, strong, found = equal_passages(count, expected)
        p, passages = toxicity.judge(lexicon, n, found)
        assert p <= toxicity.ALPHA and passages == strong


def test_many_passages_of_a_long_text():
    """p is the least over all ranks, whatever their number and their E."""
    for count, expected in ((100, 15), (200, 25), (3000, 400)):
        lexicon, n, strong, found = equal_passages(count, expected)
        p, passages = toxicity.judge(lexicon, n, strong)
        want = min(Fraction(2) ** r * sum(Fraction(expected) ** i / math.factorial(i) for i in range(r, r + 200)) for r in ([count] if count > 200 else range(expected + 1, count + 1)))
        got = math.log(p) if p else -math.inf
        assert passages == strong and math.isclose(max(got, -700), max(math.log(want.numerator) - math.log(want.denominator) - expected, -700), rel_tol=1e-6)
    for e, r in ((40.0, 30), (40.0, 40), (1000.0, 900), (1000.0, 1100)):
        want = 1 - math.fsum(math.exp(i * math.log(e) - e - math.lgamma(i + 1)) for i in range(r))
        assert math.isclose(toxicity.tail(e, r), want, rel_tol=1e-6)


def test_toxic_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    lexicon = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxic_documents(docs, lexicon).collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    words = "trash|pathetic|idiot|worthless|disgusting|stupid|clown|loser|scum|moron"
    planted = {r.doc_id for r in docs.where(F.lower("text").rlike(rf"\b({words})\b")).collect()}
    assert len(set(got) & planted) >= 0.9 * len(planted) and len(set(got) & clean) <= 0.01 * len(clean)
    assert all(r.p_value <= toxicity.ALPHA and r.passages for r in got.values())


def brute_p(n, scores, rate, k):
    """p by its definition, in exact fractions of Poisson terms."""
    best = 1.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        e = k * n * math.exp(-rate * s)
        tail = math.fsum(math.exp(i * math.log(e) - e - math.lgamma(i + 1)) for i in range(r, r + 400))
        best = min(best, 2.0**r * tail)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0.1, 9), min_size=1, max_size=12), st.integers(10, 5000))
def test_p_by_brute_force(scores, n):
    lexicon = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0), rate=1.3, k=0.01)
    p, passages = toxicity.judge(lexicon, n, [(3 * i, 3 * i + 1, s) for i, s in enumerate(scores)])
    assert math.isclose(p, brute_p(n, scores, 1.3, 0.01), rel_tol=1e-6)
    assert p > toxicity.ALPHA or passages


def test_discoveries():
    """Benjamini-Hochberg by its definition, and the least number of votes by trying all."""
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(400), rng.random(60) * 1e-5])
    tested = 5000
    ranked = sorted(p)
    k = max((i for i in range(1, len(p) + 1) if ranked[i - 1] <= toxicity.FALSE * i / tested), default=0)
    assert sorted(p[toxicity.discoveries(np.log(p), tested)]) == ranked[:k] and k > 20
    sizes, share = {1: 9000, 2: 3000, 3: 700, 4: 200, 5: 90, 8: 40}, 0.1
    able = [n for n in range(1, 9) if share**n <= toxicity.FALSE / max(sum(c for m, c in sizes.items() if m >= n), 1)]
    least, m = toxicity.least_votes(sizes, share)
    assert least == able[0] and m == sum(c for x, c in sizes.items() if x >= least)
    assert toxicity.least_votes({1: 10}, 0.5)[0] == 2


def test_near_copies_have_one_vote_a_class(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    base, rows = [word() for _ in range(150)], []
    for i in range(60):
        own = list(base) if i < 40 else [word() for _ in range(150)]
        own[r.randrange(150)] = word()
        rows.append((i, " ".join(own)))
    rows.append((99, None))
    docs = spark.createDataFrame([*rows, (0, "another text of the first id")], "doc_id bigint, text string")
    got = sorted(toxicity.sketches(docs, docs.select("doc_id").distinct()).collect(), key=lambda x: x.doc_id)
    assert [x.doc_id for x in got] == list(range(60))
    toxic = np.array([x.doc_id % 2 for x in got])
    ok = toxicity.voters(toxic, [x.bands for x in got])
    assert ok[40:].all() and [int(ok[:40][toxic[:40] == t].sum()) for t in (0, 1)] in ([1, 1], [2, 1])  # id 0 may have either text


def test_lexicon_doesnt_depend_on_copies(spark):
    """Every row and label four times: the words that score, and what is flagged, stay the same."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one = toxicity.fit(docs, labels)
    times = F.explode(F.array(*(F.lit(k * 10**6) for k in range(4))))
    more = [df.withColumn("k", times).withColumn("doc_id", F.col("doc_id") + F.col("k")).drop("k") for df in (docs, labels)]
    four = toxicity.fit(*more)
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(one.words) >= 8 and len(set(one.words.tolist()) ^ set(four.words.tolist())) <= 1, (len(one.words), len(four.words))
    flagged = {r.doc_id for r in toxicity.toxic_documents(docs, one).collect()}
    again = {r.doc_id % 10**6 for r in toxicity.toxic_documents(more[0], four).collect()}
    assert len(flagged ^ again) <= 0.1 * len(flagged) and not (flagged | again) & clean


def test_toxic_words_of_small_languages(spark):
    """Words that few documents have are found if these are all toxic, and words of a family of copies aren't."""
    r = random.Random(7)
    word = lambda k: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(k))
    common_ = [word(2) for _ in range(400)]
    bad, family = [word(4) for _ in range(6)], [word(5) for _ in range(80)]
    rows, labels = [], []
    for i in range(1500):
        own, toxic = [r.choice(common_) for _ in range(r.randrange(20, 120))] + [word(6)], i % 10 == 0
        for _ in range(3 * toxic):
            own.insert(r.randrange(len(own)), r.choice(bad))
        if i % 50 == 5:  # clean, of the family
            own = family + own[:3]
        if i % 50 == 10:  # toxic, of the family
            own = family + own[:3] + [r.choice(bad)]
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic or i % 50 == 10)))
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert set(lexicon.words.tolist()) == {kernel.hash_word(x.encode()) for x in bad}


def test_language_of_mixed_texts(spark):
    """A text of two known languages is as sure as its parts; noise and unknown scripts are rejected."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    text = {}
    for r in docs.where("n_chars between 1500 and 6000").orderBy("doc_id").collect():
        text.setdefault(r.lang, r.text[:1500])
    mixed = [f"{text[a]}\n{text[b]}" for a in text for b in text if a < b]
    best, sure = model.score(pa.array(mixed))
    alone = model.score(pa.array(list(text.values())))[1]
    assert len(mixed) == 6 and (sure >= model.threshold).all() and sure.min() >= alone.min() - 0.05
    strange = ["Быстрая коричневая лиса " * 40, "これは日本語の文章です。" * 30]
    assert (model.score(pa.array(strange))[1] < model.threshold).all()


def test_rejection_is_calibrated():
    sure = np.linspace(1, 0, 1000, endpoint=False)
    wrong = np.zeros(1000, bool)
    wrong[800::2] = True  # half of the least sure fifth
    t = langid.rejection(sure, wrong, 0.01)
    assert wrong[sure >= t].mean() <= 0.01 < wrong[sure >= t - 0.05].mean()
    assert langid.rejection(sure, np.zeros(1000, bool), 0.01) == sure[-1]
    noisy = np.arange(1000) % 20 == 3  # labels that are wrong anywhere take nothing away
    assert langid.rejection(sure, noisy, 0.01) == sure[-1]
    assert langid.rejection(sure[:0], wrong[:0], 0.01) == 1.0


def test_every_word_of_a_long_text_is_learnt():
    text = " ".join(f"w{i}" for i in range(20000))
    whole, *runs = langid._chunks(text, np.random.default_rng(0))
    assert whole == text and " ".join(runs) == text and len(runs) <= langid.RUNS
    whole, *runs = langid._chunks(" ".join(text.split()[:300]), np.random.default_rng(0))
    assert " ".join(runs) == whole


def test_pareto_sampling(spark):
    """Certain copies, fixed sizes, and inclusion near the aim over many seeds."""
    rows = [(i, "s", "x" * ((i % 7 + 1) ** 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").cache()
    seen = {i: 0 for i in range(40)}
    for seed in range(30):
        got = mixing.copies(df, {"s": 1.0}, total=0.5, seed=seed).collect()
        assert sum(r.n_copies for r in got) == 20
        for r in got:
            seen[r.doc_id] += r.n_copies
    size = {i: math.isqrt(len(t)) for i, _, t in rows}
    aim = {i: 20 * s / sum(size.values()) for i, s in size.items()}
    for k in range(1, 8):
        own = [i for i in size if size[i] == k]
        assert abs(sum(seen[i] for i in own) / 30 / len(own) - sum(aim[i] for i in own) / len(own)) < 0.12


def naive(tokens, piece):
    """Merges the leftmost pair of least rank, one after the other."""
    ids = {t: i for i, t in enumerate(tokens)}
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        ranked = [(ids.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
        rank, i = min(ranked)
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ids[p] for p in parts]


MERGES = bpe.load()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text("abcdefth inegr", max_size=90), st.binary(max_size=70)), min_size=1, max_size=8))
def test_bpe_merges(pieces):
    pieces = [p.encode() if isinstance(p, str) else p for p in pieces]
    pieces = [p for p in pieces if p]
    for piece, got in zip(pieces, MERGES.encode_many(pieces)):
        want = naive(MERGES.tokens, piece)
        assert np.frombuffer(got, np.int32).tolist() == want == MERGES.encode_long(piece)


def test_bpe_against_tiktoken(spark):
    other = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(MERGES.tokens)}, special_tokens={})
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs).collect():
        assert r.exact and r.tokens == other.encode(texts[r.doc_id], disallowed_special=())
