"""Dedup operators against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from talkweave.llm import bloom_dedup, components, kernel, paragraphs, simhash_forest

SF = "/root/testdata/sf0.01"


def roots(pairs):
    """Least member of each one's component, by union-find."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("local", [2_000_000, 0])
def test_components(spark, local):
    r = random.Random(4)
    pairs = [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)]
    edges = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a bigint, b bigint")
    got = {x.node: x.component for x in components.components(edges, local).collect()}
    want = {k: v for k, v in roots(p for p in pairs if p[0] != p[1]).items()}
    assert got == want
    assert components.components(edges.where("false"), local).count() == 0


def test_words_like_the_scalar_form():
    texts = ["The quick, brown fox", "", None, "Été naïve x1 你好", "a" * 70 + " b"]
    w = kernel.words(pa.array(texts))
    for i, t in enumerate(texts):
        assert [int(h) for h in w.hash[w.row == i]] == [kernel.hash_word(x) for x in kernel.split_words(t)]


@pytest.mark.parametrize("copies", [0, 3000])
def test_every_repeated_hash_is_found(spark, copies):
    """Pass 1 over several tasks, also if one hash is a third of all rows; few others come along."""
    rng = np.random.default_rng(2)
    h = rng.integers(-(1 << 62), 1 << 62, 6000)
    h = np.concatenate([h, h[:300], h[:10], np.full(copies, 7)])
    rows = spark.createDataFrame([(int(x),) for x in rng.permutation(h)], "h bigint").repartition(7)
    got = {r.h for r in bloom_dedup.possibly_repeated(rows, len(h)).collect()}
    u, n = np.unique(h, return_counts=True)
    repeated = set(u[n > 1].tolist())
    assert repeated <= got and len(got - repeated) < 0.01 * len(u)


def test_filter_in_slices(spark):
    rng = np.random.default_rng(3)
    h = rng.integers(-(1 << 62), 1 << 62, 3000)
    rows = spark.createDataFrame([(int(x),) for x in h], "h bigint").repartition(5)
    for words in (750, 3 * bloom_dedup.SLICE + 11):
        got = bloom_dedup.filter_of(rows, words)
        want = bloom_dedup.Filter(words)
        want.add_new(h.view(np.uint64))
        assert (got.words == want.words).all() and got.holds(h.view(np.uint64)).all()


def plain_signature(text):
    """The signature a bit at a time: the sign of the sum of the words' hash vectors, each distinct word once."""
    words, bits = {kernel.hash_word(w) for w in kernel.split_words(text)}, []
    for lane in range(simhash_forest.LANES):
        hashes = [kernel.mix_one((h + (lane + 1) * kernel.MULT) & (1 << 64) - 1).to_bytes(8, "little") for h in words]
        bits += [sum(1 if h[i // 8] >> (7 - i % 8) & 1 else -1 for h in hashes) > 0 for i in range(64)]
    return bits


def test_signatures_by_loops():
    texts = ["one two three", "", None, "One two, three THREE two", " ".join(f"w{i}" for i in range(20_000)), "été 你好 x"]
    sig, n = simhash_forest.signatures(pa.array(texts))
    for s, k, t in zip(sig, n, texts):
        assert np.unpackbits(np.ascontiguousarray(s).view(np.uint8)).astype(bool).tolist() == plain_signature(t or "")
        assert k == len(kernel.split_words(t))


def brute_groups(docs):
    sig, n = simhash_forest.signatures(pa.array([t for _, t in docs]))
    ids = [i for i, _ in docs]
    pairs = []
    for k in range(len(ids)):
        ok = simhash_forest._near(sig[k], n[k], sig[k + 1 :], n[k + 1 :], simhash_forest.RADIUS, simhash_forest.RATIO)
        pairs += [(ids[k], ids[k + 1 + j]) for j in np.flatnonzero(ok)]
    return pairs


def test_simhash_recall(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text is not null").collect()]
    pairs = brute_groups(docs)
    got = {r.doc_id: r.kept_id for r in simhash_forest.near_groups(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    same = sum(got.get(a, a) == got.get(b, b) for a, b in pairs)
    assert len(pairs) > 50 and same >= 0.9 * len(pairs)
    want = {k: v for k, v in roots(pairs).items() if k != v}
    assert all(want.get(k) is not None and want[k] <= v for k, v in got.items())  # nothing joined that brute force doesn't join


@pytest.mark.parametrize("points", [10**4, 10**6, 10**7, 3 * 10**7])
def test_simhash_plan_recall_by_distance(points):
    """Share of random pairs of each distance that share a prefix of the bottom depth in any trie."""
    depth, tries = simhash_forest.plan(points)
    bits = simhash_forest.permutations(tries)[:, :depth]
    rng = np.random.default_rng(8)
    for distance in (8, 24, 32, 40):
        apart = np.argsort(rng.random((2000, simhash_forest.BITS)), axis=1) < distance
        found = np.mean([(~p[bits].any(1)).any() for p in apart])
        assert found >= 0.91, (distance, found)


def test_climb_of_the_forest():
    """Sub-tries end at the shortest prefix that few points share, and sparse near copies meet there."""
    rng = np.random.default_rng(3)
    path = rng.integers(0, 1 << 63, 3000).astype(np.uint64) << np.uint64(1)
    path[:1500] >>= np.uint64(9)  # a dense region
    path[:100] = np.uint64(77)
    key = np.sort(rng.integers(0, 2, 3000))
    order = np.lexsort((path, key))
    path, key, depth = path[order], key[order], 20
    first = simhash_forest.climbed(path, key, depth).tolist()
    got = {(int(key[a]), *path[a:b].tolist()) for a, b in zip(first, [*first[1:], 3000])}
    want = set()
    for i in range(3000):
        for d in range(depth + 1):
            same = (key == key[i]) & ((path >> np.uint64(64 - d) == path[i] >> np.uint64(64 - d)) if d else True)
            if same.sum() <= simhash_forest.DENSE or d == depth:
                want.add((int(key[i]), *path[same].tolist()))
                break
    assert got == want and max(len(x) for x in got) > simhash_forest.DENSE + 1


def test_sparse_copies_meet_above_the_bottom(spark):
    """At the plan of 10^7 points a pair that differs in a bit of the bottom prefix in every trie is found in a sparse region."""
    depth, tries = simhash_forest.plan(10**7)
    bottom = simhash_forest.permutations(tries)[:, :depth]
    apart, left = np.zeros(simhash_forest.BITS, np.uint8), np.ones(tries, bool)
    while left.any():  # the bit that is in most of the tries left
        bit = np.bincount(bottom[left].ravel(), minlength=simhash_forest.BITS).argmax()
        apart[bit] = 1
        left &= ~(bottom == bit).any(1)
    assert apart.sum() <= simhash_forest.RADIUS
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (2000, simhash_forest.BITS)).astype(np.uint8)
    bits = np.concatenate([bits, bits[:20] ^ apart])
    lanes = np.packbits(bits, axis=1).view(np.int64).tolist()
    points = spark.createDataFrame([(i, 50, *x) for i, x in enumerate(lanes)], "doc_id bigint, n_words bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash_forest.near_edges(points, 10**7).collect()}
    assert got == {(i, 2000 + i) for i in range(20)}


def test_simhash_dense_groups():
    """A family too large to compare all with all has the same components as by brute force."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 4).astype(np.uint64)
    sig = np.stack([base ^ np.array([1 << int(rng.integers(64)) for _ in range(4)], np.uint64) for _ in range(400)])
    sig[200:] ^= np.uint64(0xFFFFFFFF00000000)
    n = np.full(400, 50)
    a, b = simhash_forest.subtrie_edges(np.zeros(400, np.uint64), sig, n, np.zeros(400, np.int64), 40, 0.6)
    got = roots(zip(a.tolist(), b.tolist()))
    brute = roots((i, j) for i in range(400) for j in range(i) if simhash_forest._near(sig[i], n[i], sig[j], n[j], 40, 0.6))
    assert got == brute and len(a) < 800


@pytest.mark.parametrize("crowd", [100, 350])
def test_crowded_regions(spark, crowd):
    """Near copies of one text, a third of all points and crowded in one region of most tries, dealt into chunks: the same groups."""
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2, (1200, simhash_forest.BITS)).astype(np.uint8)
    bits[:400] = bits[0]
    for r in range(1, 400):
        bits[r, rng.choice(simhash_forest.BITS, rng.integers(0, 14), replace=False)] ^= 1
    lanes = np.packbits(bits, axis=1).view(np.int64).tolist()
    points = spark.createDataFrame([(i, 50, *x) for i, x in enumerate(lanes)], "doc_id bigint, n_words bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    groups = [roots((r.a, r.b) for r in simhash_forest.near_edges(points, len(lanes), crowd=c).collect()) for c in (crowd, 1 << 20)]
    assert groups[0] == groups[1] and sum(v == 0 for v in groups[0].values()) == 400


def test_near_copies_go_and_others_stay(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    rows, copies = [], set()
    for i in range(60):
        w = [word() for _ in range(r.randrange(80, 300))]
        rows.append((i, " ".join(w)))
        for k in range(i % 3):
            c = list(w)
            for _ in range(max(1, len(c) // 40)):
                c[r.randrange(len(c))] = word()
            rows.append((1000 + 10 * i + k, " ".join(c)))
            copies.add(rows[-1][0])
    kept = {x.doc_id for x in simhash_forest.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(range(60)) <= kept and len(kept & copies) <= 0.1 * len(copies)


def test_paragraph_pairs_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = pa.array([r.text for r in docs.select("text").collect()])
    w = kernel.words(texts)
    first, size = paragraphs.cut(w)
    c = paragraphs.content(w, first, size).view(np.int64)
    h, starts = paragraphs.paragraph_shingles(w, first, size)
    sets, index = {}, {}
    for k in range(len(c)):
        sets.setdefault(int(c[k]), frozenset(h[starts[k] : starts[k + 1]].tolist()))
    for k, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(k)
    near = set()
    for ks in index.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                if (a, b) not in near and len(sets[a] & sets[b]) >= paragraphs.JACCARD * len(sets[a] | sets[b]):
                    near.add((min(a, b), max(a, b)))
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in paragraphs.near_pairs(docs).collect()}
    root = roots(got)
    assert got <= near and sum(root.get(a, a) == root.get(b, b) for a, b in near) >= 0.9 * len(near)


def test_sketches_rule_out_no_near_pair():
    """Sketches differ in no more bits than sets in shingles, narrow or wide, so every pair over the threshold stays."""
    r, sets = random.Random(8), []
    for _ in range(300):
        base = [r.getrandbits(64) for _ in range(r.choice([5, 9, 20, 30, 33, 40, 90, 300]))]
        for _ in range(4):
            own = [x for x in base if r.random() > 0.08] + [r.getrandbits(64) for _ in range(r.randrange(1 + len(base) // 12))]
            sets.append(own + own[:2])
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    n, sketch = paragraphs.sketches(np.array([x for own in sets for x in own], np.uint64), starts)
    small = n < paragraphs.WIDE
    sketch[small] = np.stack([paragraphs.narrow(sketch[small]), *[np.zeros(small.sum(), np.uint64)] * 3], 1)
    sets = [frozenset(x) for x in sets]
    assert n.tolist() == [len(x) for x in sets]
    near = far = ruled = 0
    for i in range(0, len(sets), 4):
        for a in range(i, i + 4):
            b = np.array([x for x in [*range(i, i + 4), (i + 900) % 1200] if x != a])
            ok = paragraphs.may_be_near(n, sketch, np.full(len(b), a), b, 0.8)
            for x, may in zip(b.tolist(), ok.tolist()):
                if len(sets[a] & sets[x]) >= 0.8 * len(sets[a] | sets[x]):
                    near += 1
                    assert may
                else:
                    far, ruled = far + 1, ruled + (not may)
    assert near > 300 and ruled > 0.7 * far


def test_second_round_joins_what_the_first_left(spark):
    """A bucket of a family: with one partner each, both rounds give the components of all pairs that are near."""
    r, rows = random.Random(2), []
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    base = [word() for _ in range(120)]
    for i in range(150):
        own = list(base)
        for _ in range(i % 5):
            own[r.randrange(120)] = word()
        rows.append((i, "\n".join([" ".join(word() for _ in range(8)), " ".join(own)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = paragraphs.colliding(docs, paragraphs.tune()).collect()
    most = Counter(x.b for x in found if x.a is not None)
    assert any(x.a is None for x in found) and max(most.values()) <= paragraphs.PARTNERS * paragraphs.tune()
    texts = pa.array([t for _, t in rows])
    w = kernel.words(texts)
    first, size = paragraphs.cut(w)
    whole = np.flatnonzero(size == 120)
    c = paragraphs.content(w, first, size).view(np.int64)[whole]
    h, starts = paragraphs.paragraph_shingles(w, first, size)
    sets = [frozenset(h[starts[k] : starts[k + 1]].tolist()) for k in whole]
    want = roots((int(c[i]), int(c[j])) for i in range(150) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = roots((x.a, x.b) for x in paragraphs.near_pairs(docs).collect())
    alike = sum((want.get(i, i) == want.get(j, j)) == (got.get(i, i) == got.get(j, j)) for i in c.tolist() for j in c.tolist())
    assert alike >= 0.95 * 150 * 150  # the bands' recall


def test_passages_beyond_what_is_broadcast(spark):
    """With too many contents to broadcast the joins shuffle, and the result is the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key = lambda df: sorted(tuple(x) for x in df.collect())
    contents = paragraphs.paragraphs(docs).select("content").distinct().where("content % 3 = 0")
    sets = [sorted((x.content, tuple(sorted(x.shingles))) for x in paragraphs.shingles_of(docs, contents, most).collect()) for most in (4_000_000, 0)]
    assert sets[0] == sets[1] and len(sets[0]) == contents.count()
    assert key(paragraphs.repeated_passages(docs)) == key(paragraphs.repeated_passages(docs, max_broadcast=0))


def test_places_that_repeat_by_brute_force(spark):
    """Passages from paragraphs and clusters, against loops over whole tables."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    units = [tuple(x) for x in paragraphs.paragraphs(docs).collect()]  # content, doc_id, at, n
    cluster = roots((x.a, x.b) for x in paragraphs.near_pairs(docs).collect())
    first, gone, want = {}, {}, []
    for c, d, at, n in units:
        k = cluster.get(c, c)
        first[k] = min(first.get(k, (d, at + n)), (d, at + n))
    for c, d, at, n in units:
        kept = first[cluster.get(c, c)]
        if kept[0] < d or kept[0] == d and kept[1] <= at:
            gone.setdefault(d, []).append((at, n, kept[0]))
    for d, own in gone.items():
        runs = []
        for at, n, k in sorted(own):
            if not runs or at >= runs[-1][1] + paragraphs.LEAST_WORDS:
                runs.append([at, at + n, k])
            else:
                runs[-1][1:] = [max(runs[-1][1], at + n), min(runs[-1][2], k)]
        want += [(d, a, b - a, k) for a, b, k in runs if b - a >= paragraphs.MIN_WORDS]
    assert sorted(tuple(x) for x in paragraphs.repeated_passages(docs).collect()) == sorted(want) and want


def test_planted_passages(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(i, text(300)) for i in range(40)]
    holders = {3: " {} ", 9: ". {}! ", 17: "\n{}\n", 30: " {} "}
    for i, form in holders.items():
        rows[i] = (i, text(100) + form.format(passage) + text(90))
    got = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x.doc_id for x in got} == {9, 17, 30} and {x.kept_doc_id for x in got} == {3}
    for x in got:
        assert 99 <= x.first_word <= 115 and 30 <= x.n_words <= 61


def test_passages_in_lines_of_any_length(spark):
    """Exact passages are found however many words a line has."""
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9))) for _ in range(n))
    rows, planted = [], {}
    for k in range(400):
        per, size = k % 10 + 1, (56, 100)[k // 10 % 2]
        passage = "\n".join(text(min(per, size - i)) for i in range(0, size, per))
        rows += [(2 * k, f"{text(70)} {passage} {text(50)}"), (2 * k + 1, f"{text(90)} {passage} {text(40)}")]
        planted[2 * k + 1] = per
    found = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x.doc_id for x in found} <= set(planted) and all(x.kept_doc_id == x.doc_id - 1 for x in found)
    share = {per: sum(planted[x] == per for x in {x.doc_id for x in found}) / 40 for per in range(1, 11)}
    assert min(share.values()) >= 0.9, share


def test_edited_paragraphs_recall(spark):
    """Whole lines and blocks of several lines over the threshold are found, held against brute force over paragraphs."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    sets = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    rows, near = [], {}
    for k in range(240):
        n, edits, per = *((60, 1), (60, 2), (100, 3), (150, 5))[k % 4], (1000, 9)[k // 4 % 2]
        a = [word() for _ in range(n)]
        b = list(a)
        for i in range(edits):
            b[(2 * i + 1) * n // (2 * edits)] = word()
        for i, w in ((2 * k, a), (2 * k + 1, b)):
            lines = "\n".join(" ".join(w[x : x + per]) for x in range(0, n, per))
            rows.append((i, "\n\n".join([" ".join(word() for _ in range(40)), lines, " ".join(word() for _ in range(30))])))
        if len(sets(a) & sets(b)) >= paragraphs.JACCARD * len(sets(a) | sets(b)):
            near[2 * k + 1] = n
    found = paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    whole = [x for x in found if (x.first_word, x.n_words, x.kept_doc_id) == (40, near.get(x.doc_id), x.doc_id - 1)]
    assert len(near) > 200 and len(whole) >= 0.9 * len(near), (len(whole), len(near))


def test_repetitive_lines_of_different_length(spark):
    """Their distinct shingles are the same, so they are near whatever their lengths."""
    rows = [(1, "tick tock " * 10), (2, "tick tock " * 20), (3, "to be or not " * 30), (4, "to be or not " * 12)]
    got = {(x.doc_id, x.kept_doc_id) for x in paragraphs.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(2, 1), (4, 3)}


def test_bands_reach_the_recall():
    bands = paragraphs.tune()
    assert 1 - (1 - paragraphs.JACCARD**paragraphs.ROWS) ** bands >= paragraphs.RECALL > 1 - (1 - paragraphs.JACCARD**paragraphs.ROWS) ** (bands - 1)
    rng = np.random.default_rng(4)
    key, content, count = rng.integers(0, 1 << 63, (2, 9)).astype(np.uint64), rng.integers(0, 1 << 63, 9).astype(np.uint64), np.array([300, 2, 31, 32, 70000, 5, 6, 7, 8])
    sketch = rng.integers(0, 1 << 63, (9, 4)).astype(np.uint64)
    found = {}
    for batch in paragraphs.pack(key, content, count, sketch, 3):
        for p, wide, blob in zip(*(c.to_pylist() for c in batch.columns)):
            for k, c, n, s in zip(*paragraphs.unpack(p, wide, blob)):
                found.setdefault(int(c), []).append((int(k), int(n), s.tolist()))
    low, short = (1 << 40) - 1, paragraphs.narrow(sketch).tolist()
    want = {int(c): sorted(((int(k) >> 40) % 3 << 40 | int(k) & low, min(int(n), 65535), s.tolist() if n >= 32 else [x, 0, 0, 0]) for k in ks) for c, n, s, x, ks in zip(content, count, sketch, short, key.T)}
    assert {c: sorted(x) for c, x in found.items()} == want


@pytest.mark.parametrize("room", [256 << 20, 64])
def test_exact_dedup_shuffles_suspects_only(spark, room):
    """What the shuffles of the plan that runs wrote: rows that can't be copies aren't among it, in one range of filters or several."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = bloom_dedup.exact_dedup(docs, max_filter_bytes=room)
    texts = [r.text for r in docs.select("text").collect()]
    assert sorted(r.text for r in got.collect()) == sorted(set(texts))
    copied = sum(n for n in Counter(texts).values() if n > 1)
    plan = got._jdf.queryExecution().executedPlan().finalPhysicalPlan()
    sent, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if node.nodeName() == "Exchange":
            sent += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 0 < sent <= 1.05 * copied + 5
