"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator over documents."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.llm import bloom_dedup, bpe, common, kernel, langid, mixing, ogg, paragraphs, quality, simhash_forest, toxicity, warc

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(120_000))
TEXT = "the quick brown fox jumps over the lazy dog and then it sleeps near the warm fire until the morning comes, when a cold wind from the north wakes every animal of the old farm behind the hill; nobody there remembers such a winter"
ROWS = [
    (1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (2, TEXT, "en", None), (None, TEXT, None, "b"), (3, None, "en", "a"), (4, "", "en", "a"),
    (5, "", None, "b"), (6, LONG, "en", "a"), (7, "你好 \U0001f600 naïve\u0000café\n\n\t", "fr", "c"), (None, None, None, None), (8, "?!... --", "en", "a"),
]
CLASH = ["content", "place", "toxic", "c0", "c1", "h", "m", "s", "_s", "_k", "_t", "_e", "_p", "_q", "_cell", "part", "path", "b", "node", "component", "keep", "predicted", "r", "n_words", "tokens", "_copies", "_i", "_limit", "_take", "_n"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit(c) for c in CLASH}).withColumn("tags", F.create_map(F.lit("k"), F.lit(1)))


@pytest.fixture(scope="module")
def cased(odd):
    """With columns whose names differ from the needed ones by case alone."""
    return odd.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("Text", "DOC_ID", "Lang", "SOURCE", "Media_id"))))


def test_names_that_differ_by_case(spark, odd, cased):
    """Results are those without the clashing columns."""
    key = lambda df: sorted(map(repr, df.collect()))
    labels = known(spark).select("*", F.lit("x").alias("Quality"), F.lit("x").alias("TOXIC"), F.lit(3).alias("Doc_id"))
    machine, model = quality.fit(odd, known(spark)), langid.fit(odd)
    assert np.array_equal(quality.fit(cased, labels).weight, machine.weight) and np.array_equal(langid.fit(cased).table, model.table)
    assert len(toxicity.fit(cased, labels).words) == 0
    for f in (
        lambda d: quality.classify(d, machine), bpe.encode, mixing.copies, lambda d: langid.predict(d, model), simhash_forest.near_groups, paragraphs.repeated_passages,
        lambda d: toxicity.toxic_documents(d, toxicity.Lexicon(np.array([kernel.hash_word(b"fox")], np.uint64), np.array([9.0]), 1.4, 0.001)), lambda d: ogg.streams_of(ogg.recorded(d)),
    ):
        assert key(f(cased)) == key(f(odd))
    for f in (bloom_dedup.exact_dedup, mixing.mix, simhash_forest.near_dedup, lambda d: langid.predict(d, model, keep_columns=True)):
        got = f(cased)
        assert got.columns == cased.columns and sorted(str(r[0]) for r in got.collect()) == sorted(str(r[0]) for r in f(odd).collect())


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def known(spark, rows=((1, 1, 0), (6, 0, 1), (None, 1, 1), (2, None, None), (7, 1, 0), (999, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def test_quality(spark, odd, nothing):
    got = quality.classify(odd, quality.fit(odd, known(spark))).collect()
    assert len(got) == len(ROWS) and {r.doc_id for r in got if r.n_words == 0} == {3, 4, 5, 8, None}
    assert not any(r.keep for r in got if r.n_words == 0)
    assert len({(r.score, r.keep) for r in got if r.doc_id == 1}) == 1
    one_class = quality.fit(odd, known(spark, [(1, 1, 0)]))
    assert one_class is None and {r.score for r in quality.classify(odd, None).collect()} == {0.5}
    assert quality.classify(nothing, quality.fit(nothing, known(spark, []))).count() == 0


def test_bpe(odd, nothing):
    got = {r.doc_id: r for r in bpe.encode(odd.where("doc_id is not null")).collect()}
    assert got[3].tokens is None and got[3].exact is None and got[3].n_tokens is None and got[4].tokens == []
    assert all(r.exact for k, r in got.items() if k != 3) and got[6].n_tokens > 120_000
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd.where("doc_id > 1"))).collect()}
    assert back == {k: t for k, t, _, _ in ROWS if k and k > 1}
    assert bpe.encode(nothing).count() == 0 and bpe.encode(odd).count() == len(ROWS)


@pytest.mark.parametrize("room", [64 << 20, 8])
def test_exact_dedup(odd, nothing, room):
    got = bloom_dedup.exact_dedup(odd, max_filter_bytes=room)
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got.collect()) == [-1, 1, 3, 4, 6, 7, 8]
    assert all(r[c] == c for r in got.collect() for c in CLASH)
    assert bloom_dedup.exact_dedup(nothing, max_filter_bytes=room).count() == 0


def test_exact_dedup_of_rows_without_id(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, "x", 1), (None, "x", 2), (9, "x", 3)], "doc_id bigint, text string, k int")
    assert [tuple(r) for r in bloom_dedup.exact_dedup(df).collect()] == [(9, "x", 3)]
    assert bloom_dedup.exact_dedup(df.where("doc_id is null")).count() == 1


def test_mixing(odd, nothing):
    got = mixing.mix(odd)
    assert got.columns == odd.columns
    assert abs(got.count() - len(ROWS)) <= 2
    counted = mixing.copies(odd, {"a": 3.0, "b": 1.0, "nowhere": 2.0}, total=4.0)
    per = {r.source: r.n for r in counted.groupBy("source").agg(F.sum("n_copies").alias("n")).collect()}
    assert per == {"a": 33, "b": 11}
    assert mixing.copies(nothing).count() == 0 and mixing.mix(nothing).columns == odd.columns


def test_paragraphs(odd, nothing):
    got = paragraphs.repeated_passages(odd).collect()
    twice = [r for r in got if r.doc_id == 2]
    assert len(twice) == 1 and twice[0].kept_doc_id == 1 and twice[0].n_words >= paragraphs.MIN_WORDS
    assert not [r for r in got if r.doc_id in (1, 3, 4, 5, 7, 8, None)]
    assert paragraphs.repeated_passages(nothing).count() == 0


def test_language(odd, nothing):
    model = langid.fit(odd)
    got = langid.predict(odd, model).collect()
    assert len(got) == len(ROWS)
    assert all(r.predicted is None and r.confidence == 0 and not r.keep for r in got if r.doc_id in (3, 4, 5, 8))
    kept = langid.predict(odd, model, keep_columns=True)
    assert kept.columns == odd.columns and kept.count() == sum(r.keep for r in got)
    none = langid.fit(nothing)
    assert none.langs == [] and not any(r.keep for r in langid.predict(odd, none).collect())
    assert langid.predict(nothing, model).count() == 0


def test_toxicity(spark, odd, nothing):
    assert toxicity.toxic_documents(odd, toxicity.fit(odd, known(spark))).count() == 0  # too few labels for any word
    assert toxicity.toxic_documents(odd, toxicity.fit(odd, known(spark, []))).count() == 0
    assert toxicity.toxic_documents(nothing, toxicity.fit(nothing, known(spark))).count() == 0


def test_toxicity_with_a_lexicon(spark, odd, nothing):
    """Nulls, empty and long texts, repeats and clashing columns with words that score."""
    words = [f"calm{i % 83} sea{i * 7 % 91} hill{i * 13 % 67} {'vile wretch ' if i % 8 == 0 else ''}tree{i} wind{i * 3 % 71}" for i in range(800)]
    rows = [(1000 + i, t, "en", "a") for i, t in enumerate(words)] + [(1000, words[0], "en", "a")] * 50  # a hot id
    rows += [(5001, "vile wretch", "en", "a"), (5001, "vile wretch", "en", "a"), (None, "a vile wretch", None, None), (5002, LONG + " vile wretch" * 4, "en", "a"), (5003, LONG, None, "a"), (5004, "", "en", "a"), (5005, None, "en", "a")]
    docs = odd.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({c: F.lit(c) for c in CLASH}).withColumn("tags", F.create_map(F.lit("k"), F.lit(1))))
    labels = [(1000 + i, 1, int(i % 8 == 0)) for i in range(800)] + [(1000, 1, 0), (1008, None, None), (None, 1, 1), (77777, 1, 1)]
    given = known(spark, labels).withColumn("Toxic_", F.lit(1)).withColumn("TEXT", F.lit("x"))
    lexicon = toxicity.fit(docs, given)
    assert len(lexicon.words) == 2
    got = toxicity.toxic_documents(docs, lexicon).collect()
    assert {r.doc_id for r in got} == {1000 + i for i in range(0, 800, 8)} | {5001, 5002, None}
    assert len([r for r in got if r.doc_id == 5001]) == 2 and len([r for r in got if r.doc_id == 1000]) == 51
    (long,) = [r for r in got if r.doc_id == 5002]
    assert [(p.first_word, p.last_word) for p in long.passages] == [(120_000, 120_007)] and long.n_words == 120_008
    assert toxicity.toxic_documents(nothing, lexicon).count() == 0


def test_samples_are_of_ids(spark):
    """An id that a third of all rows have is one of the sample and one row to the driver."""
    ids = spark.createDataFrame([(i % 50 if i % 3 else 7,) for i in range(3000)] + [(None,)], "doc_id bigint").repartition(5)
    got = [r.doc_id for r in common.sampled_ids(ids, 20, 1).collect()]
    assert len(got) == len(set(got)) == 20 and sorted(got) == sorted(r.doc_id for r in common.sampled_ids(ids.coalesce(1), 20, 1).collect())
    assert common.sampled_ids(ids, 500, 1).count() == 50 and common.sampled_ids(ids.where("false"), 5, 1).count() == 0
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, None, 1)], "doc_id bigint, t string, n int")
    assert sorted(tuple(r) for r in common.one_a_doc(rows, "t", "n").collect()) == [(1, "a", 9), (2, None, 1)]


def test_simhash(odd, nothing):
    got = {r.doc_id: r.kept_id for r in simhash_forest.near_groups(odd).collect()}
    assert got == {2: 1, 5: 4, 8: 4}  # texts without words are copies of each other
    kept = simhash_forest.near_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 3
    assert simhash_forest.near_dedup(odd, max_broadcast_ids=0).count() == len(ROWS) - 3
    assert simhash_forest.near_groups(nothing).count() == 0 and simhash_forest.near_dedup(nothing).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (None, None, None), (2, "http://b/\r\nX: y", ""), (1, "http://a/", "<p>x</p>"), (3, "u", "z" * 3_000_000)], "page_id bigint, url string, html string").withColumn("content", F.lit(1))
    got = warc.records_of(warc.packed(pages, records=2)).collect()
    assert len(got) == 5 and all(r.digest_ok and r.error is None for r in got)
    assert sorted(len(r.payload) for r in got) == [0, 0, 8, 8, 3_000_000]
    assert warc.records_of(warc.packed(pages.where("false"))).count() == 0
    files = spark.createDataFrame([("a", None), ("b", bytearray())], "file string, content binary")
    assert warc.records_of(files).count() == 0


def test_ogg(odd, nothing, spark):
    got = ogg.streams_of(ogg.recorded(odd)).collect()
    assert len(got) == 2 * len(ROWS) and all(r.n_bad_pages == r.n_lost == r.n_skipped == 0 for r in got)
    assert {r.n_bytes for r in got if r.media_id == 6} == {len(LONG), 1}
    assert ogg.streams_of(ogg.recorded(nothing)).count() == 0
    media = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"noise" * 9))], "media_id bigint, content binary")
    assert ogg.streams_of(media).count() == 0


def test_missing_columns(odd):
    for f in (bloom_dedup.exact_dedup, mixing.copies, mixing.mix, simhash_forest.near_groups, paragraphs.repeated_passages, bpe.encode, langid.fit):
        with pytest.raises(ValueError, match="missing"):
            f(odd.drop("text"))


class Unnamed:
    """Stands for a cluster's session whose settings name no folder."""

    class conf:  # noqa: N801
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"


class Named:
    """Stands for a cluster's session, whose settings name the folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return {"spark.checkpoint.dir": "hdfs://shared/folder/"}.get(key, default)


def test_shared_folder_is_the_clusters(spark):
    assert common.shared_folder(Named()) == "hdfs://shared/folder"
    assert common.shared_folder(spark) == common.shared_folder(spark)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Unnamed())


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, odd, nothing, tmp_path, empty):
    """Every stage takes nulls, empty texts, repeats, clashing columns and no rows at all, on its own input."""
    import corpus_pipeline

    docs = nothing if empty else odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        own = stage(spark, docs, "")
        if name != "bpe_tokens":
            assert own.columns == docs.columns
        own.write.parquet(f"{tmp_path}/{k}")
        assert spark.read.parquet(f"{tmp_path}/{k}").count() <= max(docs.count(), 1)
        rest = docs if name == "language_id" else spark.read.parquet(f"{tmp_path}/{k}")
        docs = rest if name != "bpe_tokens" else docs  # the language model of a few rows may reject all; the others get every row
    assert (docs.count() == 0) == empty
