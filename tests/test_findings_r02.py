"""What the findings of round 2 named, on rows that failed before."""

from __future__ import annotations

import gzip
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkweave.operators import analytics as an
from talkweave.operators import graph
from talkweave.operators import overlap as ov
from talkweave.plans import registry
from talkweave.sources import audio, shared, sinks, text
from tests.compare import database, differences


def test_best_score_of_ties(spark):
    rows = [(8, log, 0.5, 10 - log) for log in (7, 3, 5)] + [(9, 1, 0.5, 0), (8, 0, None, 0)]
    scores = spark.createDataFrame(rows, "weight bigint, log bigint, wer double, ins bigint").coalesce(1)
    assert [tuple(r) for r in an.best_score(scores).collect()] == [(8, 3, 0.5, 7)]


def test_best_score_like_sql(spark):
    larger = "/root/testdata/sf0.1"
    assert not differences(registry.QUERIES["best_score"](spark, larger), database(larger), registry.ORACLES["best_score"])


def test_enhancement_of_audio_that_ends_early(spark, small, tmp_path):
    """The last utterance has 22 - 20 vectors: two channels, and less audio than its length."""
    spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 22").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.QUERIES["enhance_utterances"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("u0", 200, True), ("u1", 200, True)]


def _activity(spark, n=400, whole=True):
    """Intervals of two sessions, many with equal ends, some empty, some longer than a bucket."""
    r = random.Random(3)
    rows = []
    for k in range(n):
        at = r.randrange(-300, 1500)
        rows.append((f"s{k % 2}", r.randrange(9) if whole else f"ä{r.randrange(9)}", k, at, at + r.choice([0, 1, 5, 40, 400])))
    return spark.createDataFrame(rows, f"session string, speaker {'bigint' if whole else 'string'}, utt bigint, start bigint, end bigint")


def _like(found, want):
    assert found.columns == want.columns and found.dtypes == want.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []


def test_cross_talk_totals_without_pairs(spark):
    for whole in (True, False):
        a = _activity(spark, whole=whole)
        met = ov.cross_talk(a, 100).groupBy("session", "speaker", "speaker_r").agg(F.count("*").alias("n"), F.sum(F.col("overlap_end") - F.col("overlap_start")).alias("overlap_us"))
        for parts, cells in ((1, 10), (3, 1 << 20), (8, 50)):
            _like(ov.cross_talk_totals(a, parts, cells), met)
    plan = registry.QUERIES["crosstalk_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_window_totals_without_slices(spark, small):
    a = _activity(spark)
    windows = a.select("session", (F.col("utt") % 150).alias("window_id"), (F.col("start") + 3).alias("start"), (F.col("end") + 9).alias("end"))
    met = ov.window_slice(a, windows, ["session"], 100)
    want = met.groupBy("session", "window_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))
    _like(ov.window_totals(a, windows, 100), want)
    plan = registry.QUERIES["utterance_activity_slice"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of points with their buckets' totals alone


def _graphs(spark):
    """Random graphs without cycles, with parallel arcs and silent labels, and one chain."""
    r = random.Random(5)
    rows, finals = [], []
    for g in range(25):
        for k in range(r.randrange(1, 9)):
            a, b = sorted(r.sample(range(4), 2))
            word = lambda: r.choice(["<eps>", "a", "b", "0"])
            rows.append((f"g{g}", k, a, b, word(), word(), float(r.randrange(4))))
        finals += [(f"g{g}", r.randrange(4), float(r.randrange(3))) for _ in range(2)]
    rows += [("chain", k, k, k + 1, "a", "<eps>", 1.0) for k in range(5)]
    finals.append(("chain", 5, 0.0))
    arcs = spark.createDataFrame(rows, "graph string, seq bigint, src bigint, dst bigint, ilabel string, olabel string, weight double")
    return arcs, spark.createDataFrame(finals, "graph string, state bigint, weight double").dropDuplicates(["graph", "state"])


def test_graphs_whole_and_by_rounds(spark, monkeypatch):
    """Graphs worked on whole give what rounds of joins give, and so do those that are too large for it (here of more than 8 rows)."""
    monkeypatch.setattr(graph, "LARGEST", 8)
    monkeypatch.setattr(graph, "TOGETHER", 4)
    arcs, finals = (x.coalesce(1).localCheckpoint() for x in _graphs(spark))
    starts = arcs.groupBy("graph").agg(F.min("src").alias("state"))
    _like(graph.shortest_distance(arcs, starts), graph._shortest_distance_by_rounds(arcs, starts))
    _like(graph.topsort(arcs), graph._topsort_by_rounds(arcs))
    for new, old in zip(graph.remove_epsilon(arcs, finals), graph._remove_epsilon_by_rounds(arcs, finals)):
        _like(new, old)
    way = lambda f: f(arcs, finals, starts).groupBy("graph").agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.sum("seq").alias("s"))
    _like(way(graph.shortest_path), way(graph._shortest_path_by_rounds))
    pairs = starts.select("graph", F.col("state").alias("s1"), F.col("state").alias("s2"))
    other = arcs.select("graph", "seq", "src", "dst", F.col("olabel").alias("ilabel"), F.col("ilabel").alias("olabel"), "weight")
    _like(graph.compose(arcs, other, pairs), graph._compose_by_rounds(arcs, other, pairs))


def test_endless_graphs_raise(spark):
    arcs = spark.createDataFrame([(1, 0, 1, 2, "a", "a", -1.0), (1, 1, 2, 1, "a", "a", 0.0), (2, 0, 1, 2, "a", "a", 1.0)], "graph int, seq bigint, src bigint, dst bigint, ilabel string, olabel string, weight double")
    with pytest.raises(RuntimeError):
        graph.shortest_distance(arcs, arcs.select("graph", F.col("src").alias("state")), 5)
    with pytest.raises(RuntimeError):
        graph.topsort(arcs, 5)


def test_graph_queries_without_rounds(spark, small):
    """One table is written a query, not one a round."""
    for name in ("fst_shortest_distance", "fst_topsort", "fst_remove_epsilon", "fst_remove_epsilon_finals", "fst_shortest_path", "fst_compose"):
        since = shared.mark()
        registry.QUERIES[name](spark, small)
        assert shared.mark() - since == 1, name


def test_missing_annotations_in_parts(spark):
    """Utterances that occur twice count once; a session's task gets no set of all its utterances."""
    utts = spark.createDataFrame([("a", k % 10) for k in range(30)] + [("b", 3), ("c", None)], "session string, utt bigint")
    found = an.missing_annotations(utts, utts.where("utt < 7").select("utt"))
    assert sorted(map(tuple, found.collect())) == [("a", [7, 8, 9], 10, 3), ("b", [], 1, 0), ("c", [], 0, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "Expand" not in plan


def test_arcs_are_added_once(spark):
    kind = "graph int, seq bigint, src bigint, dst bigint, ilabel string, olabel string, weight double"
    arcs = spark.createDataFrame([(1, 0, 1, 2, "a", "a", 1.0), (1, 1, 1, 2, "a", "a", 2.0), (1, 2, 1, 2, None, "a", 3.0)], kind)
    new = spark.createDataFrame([(1, 5, 1, 2, "a", "a", 9.0), (1, 6, 2, 3, "a", "b", 9.0), (1, 6, 2, 3, "a", "b", 9.0), (1, 7, 1, 2, None, "a", 9.0)], kind)
    found = graph.add_missing_arcs(arcs, new)
    assert sorted(r["seq"] for r in found.collect()) == [0, 1, 2, 6, 7]
    loops = graph.add_self_loops(arcs, "#0").where("src = dst").select("graph", "seq", "src", "ilabel").collect()
    assert sorted(map(tuple, loops)) == [(1, 4, 1, "#0"), (1, 5, 2, "#0")]
    assert "Join" not in graph.add_self_loops(found, "#0")._jdf.queryExecution().optimizedPlan().toString()


def test_start_is_the_first_line_of_the_text(spark):
    kind = "graph int, seq bigint, src bigint, dst bigint, ilabel string, olabel string, weight double"
    tied = [(1, 5, 2, 3, "a", "a", 0.0), (1, 5, 1, 2, "a", "b", 0.0), (1, 5, 10, 2, "a", "b", 0.0), (1, 9, 0, 1, "a", "a", 0.0)]
    for rows in (tied, tied[::-1], tied[1:] + tied[:1]):
        arcs = spark.createDataFrame(rows, kind).coalesce(1)
        first = graph.text(arcs, graph.parse_text(spark.createDataFrame([], "graph int, seq bigint, line string"))[1]).collect()[0]["txt"].split("\n")[0]
        assert (first, graph.start_state(arcs).collect()[0]["start"]) == ("1 2 a b", 1)
    without = spark.createDataFrame([(1, None, 7, 8, "a", "a", 0.0), (1, 3, 4, 5, "a", "a", 0.0), (2, None, 7, 8, "a", "a", 0.0)], kind)
    assert sorted(map(tuple, graph.start_state(without).collect())) == [(1, 4), (2, None)]


def test_chain_is_worked_out_once(spark, small):
    for name in ("chosen_channels", "prepared_activity"):
        since = shared.mark()
        registry.QUERIES[name](spark, small)
        assert shared.mark() - since == 1, name


NAMES = ["S02", "", None, "_a", ".b", "a/b c+d=e%41", "ä", "=null", "null"]


def test_documents_by_name(spark, tmp_path, monkeypatch):
    """A file a name and nothing beside it, whatever the names; with folders that plain file calls don't reach too."""
    rows = spark.createDataFrame([(n, f'{{"k": {k}}}') for k, n in enumerate(NAMES)], "name string, value string")
    sinks.write_documents(rows, str(tmp_path / "a"))
    assert len([x for x in Path(tmp_path, "a").rglob("*") if x.is_file()]) == len(NAMES)
    assert {r["name"]: json.loads(r["value"])["k"] for r in text.documents(spark, str(tmp_path / "a")).collect()} == {n: k for k, n in enumerate(NAMES)}
    with pytest.raises(Exception, match="two texts"):
        sinks.write_documents(rows.withColumn("name", F.lit("S02")).coalesce(1), str(tmp_path / "b"))
    sinks.write_documents(rows.where("name = 'S02'").union(rows.where("name = 'S02'")).coalesce(1), f"file://{tmp_path}/c")
    assert text.documents(spark, f"file://{tmp_path}/c").count() == 1
    monkeypatch.setattr(sinks, "mounted", lambda path: None)
    some = rows.where("name <> ''")
    sinks.write_documents(some, str(tmp_path / "d"))
    assert {r["name"]: json.loads(r["value"])["k"] for r in text.documents(spark, str(tmp_path / "d")).collect()} == {n: k for k, n in enumerate(NAMES) if n}


def test_session_files_have_no_folders_of_their_own(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "path", lambda spark, kind="table": str(tmp_path / kind))
    for query, kind in (("transcript_files", "transcripts"), ("speaker_activity_files", "speakers")):
        got = registry.QUERIES[query](spark, small)
        files = [x.name for x in Path(tmp_path, kind).rglob("*") if x.is_file()]
        key = "session_id" if query == "transcript_files" else "session"
        assert sorted(files) == sorted(f"{r[0]}.json" for r in got.select(key).distinct().collect())
        assert len(list(Path(tmp_path, kind).rglob("*"))) - len(files) <= 64


def test_transcripts_plain_and_packed(spark, tmp_path):
    row = lambda s: json.dumps([{"start_time": "0:00:01.5", "end_time": "0:00:02", "words": "ä", "speaker": "P01", "session_id": s}], ensure_ascii=False).encode()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "S01.json").write_bytes(row("S01"))
    (tmp_path / "S02.json.gz").write_bytes(gzip.compress(row("S02")))
    got = text.transcripts(spark, str(tmp_path), multi=False).select("session_id", "pos", "words", "start_time", F.element_at(F.split("path", "/"), -1)).collect()
    assert sorted(map(tuple, got)) == [("S01", 0, "ä", 24000, "S01.json"), ("S02", 0, "ä", 24000, "S02.json.gz")]


def test_wav_files_are_made_once(spark, small):
    plan = registry.QUERIES["wav_round_trip"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInPandas" not in plan and plan.count("RepartitionByExpression") == 1


def test_wav_files_of_rows_in_any_order(spark):
    """Files of one to three channels over several batches, a name of none, and ranges beyond a file's end."""
    want = {k: np.round(np.random.default_rng(k).normal(0, 1, (k % 3 + 1, k % 5)), 3) for k in range(40)}
    rows = [(k if k else None, c, x[c].tolist()) for k, x in want.items() for c in range(len(x))]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        files = audio.encode(spark.createDataFrame(rows, "k int, channel int, samples array<double>"), "k", kind="float64").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(files) == 40 and all(r.n_clipped == audio.clipped(want[r.k or 0]) for r in files)
    assert all(np.array_equal(audio.read(bytes(r.content)), want[r.k or 0]) for r in files)
    again = audio.load(spark.createDataFrame(files).withColumn("path", F.lit("x")), 1, keep=("k",), more={"some": (0, 2), "gone": (9, 12)}).collect()
    assert sorted((r.k or 0, r.channel, r.samples, r.some, r.gone) for r in again) == sorted((k, c, x[c, 1:].tolist(), x[c, :2].tolist(), []) for k, x in want.items() for c in range(len(x)))
    with pytest.raises(Exception, match="no samples"):
        audio.encode(spark.createDataFrame([(1, 0, None)], "k int, channel int, samples array<double>"), "k").collect()
