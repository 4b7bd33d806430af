"""Queries over annotation sources and sinks, recognition results and transducers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.operators import analytics as an
from talkweave.operators import graph
from talkweave.sources import shared, sinks, text

from .fixtures import ACTIVITY, TURNS, activity, table, turns

Q = {}
S = {}


def _scratch(spark: SparkSession) -> str:
    return shared.path(spark, "annotations")


def catalog_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as a catalog of JSON objects and read again with a fixed schema."""
    t = turns(spark, sf_dir).select(F.concat("session", F.lit("-"), F.col("pos").cast("string")).alias("example_id"), F.col("speaker").alias("dataset"), F.col("session").alias("session_id"), "start", "end", (F.col("end") - F.col("start")).alias("num_samples"))
    path = f"{_scratch(spark)}.json"
    sinks.dump_database(t, path)
    schema = "example_id string, session_id string, start bigint, end bigint, num_samples bigint, dataset string"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


Q["catalog_round_trip"] = catalog_round_trip
S["catalog_round_trip"] = f"""WITH {TURNS} SELECT session || '-' || pos AS example_id, session AS session_id, "start", "end", "end" - "start" AS num_samples, speaker AS dataset FROM turns"""


def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested catalog document read lazily: examples by dataset."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("r_name", F.struct("n_name", F.struct(F.lit("S1").alias("session_id"), F.col("n_nationkey").cast("bigint").alias("num_samples"))).alias("e"))
    per = rows.groupBy("r_name").agg(F.map_from_entries(F.collect_list("e")).alias("m"))
    doc = per.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "m"))).alias("datasets")).withColumn("alias", F.create_map(F.lit("all"), F.array(F.lit("ASIA"), F.lit("AFRICA"))))
    path = _scratch(spark)
    sinks.dump_json(doc, path)
    examples, _ = text.json_database(spark, path, "session_id string, num_samples bigint")
    return examples


Q["json_database"] = json_document
S["json_database"] = "SELECT r_name AS dataset, n_name AS example_id, 'S1' AS session_id, CAST(n_nationkey AS BIGINT) AS num_samples FROM nation JOIN region ON n_regionkey = r_regionkey"


def build_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example rows of raw and realigned transcripts."""
    t = turns(spark, sf_dir).select(F.col("session").alias("session_id"), "pos", F.concat(F.lit("P"), F.lpad((F.col("pos") % 50).cast("string"), 2, "0")).alias("speaker"), F.col("transcription").alias("words"), (F.col("start") * 160).alias("start"), (F.col("end") * 160).alias("end"))
    moved = t.withColumns({"start": F.col("start") + 32, "end": F.col("end") + 48}).select("session_id", "pos", "start", "end")
    return text.examples(t, moved, least=1).drop("transcription")


Q["create_database"] = build_catalog
S["create_database"] = f"""WITH {TURNS}, t AS (SELECT *, 'P' || lpad(CAST(pos % 50 AS VARCHAR), 2, '0') AS p, CAST("start" AS VARCHAR) AS a, CAST("end" AS VARCHAR) AS b FROM turns)
SELECT p || '_' || session || '-' || lpad(a, CAST(greatest(length(a), 7) AS INT), '0') || '-' || lpad(b, CAST(greatest(length(b), 7) AS INT), '0') AS example_id, session AS session_id, p AS speaker_id,
  "start" * 160 + 32 AS "start", "end" * 160 + 48 AS "end", "end" * 160 + 48 - "start" * 160 - 32 AS num_samples FROM t"""


def _rttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    second = lambda c: (c.cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string")
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.concat("session", F.lit("_U06.ENH")), F.lit("1"), second(F.col("start")), second(F.col("end") - F.col("start")), F.lit("<NA>"), F.lit("<NA>"), "speaker", F.lit("<NA>"), F.lit("<NA>"))
    return t.select(line.alias("value"))


def rttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarisation lines written as text, read and parsed; times are hundredths of a second."""
    path = _scratch(spark)
    _rttm(spark, sf_dir).write.text(path)
    return text.rttm(spark.read.text(path))


Q["rttm_parse"] = rttm
S["rttm_parse"] = f"""WITH {TURNS} SELECT session || '_U06.ENH' AS file, speaker, "start" * 160 AS "start", "end" * 160 AS "end" FROM turns"""
Q["rttm_examples"] = lambda spark, d: text.rttm_examples(text.rttm_intervals(_rttm(spark, d)))


def _merged() -> str:
    from .intervals import merged_sql

    return merged_sql("session, speaker", "scaled")


S["rttm_examples"] = f"""WITH {TURNS}, scaled AS (SELECT session, speaker, "start" * 160 AS "start", "end" * 160 AS "end" FROM turns), {_merged()},
t AS (SELECT *, CAST("start" AS VARCHAR) AS a, CAST("end" AS VARCHAR) AS b FROM merged)
SELECT session || '_U06.-' || speaker || '-' || lpad(a, CAST(greatest(length(a), 9) AS INT), '0') || '_' || lpad(b, CAST(greatest(length(b), 9) AS INT), '0') AS example_id, "start", "end", "end" - "start" AS num_samples, session AS session_id, speaker AS speaker_id FROM t"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).alias("s"), F.pmod("l_partkey", F.lit(3)).alias("u"), F.pmod("l_linenumber", F.lit(4)).alias("c")).distinct()
    return rows.select(F.format_string("/data/train/S%02d_U0%d.CH%d.wav", "s", "u", "c").alias("path"), F.format_string("S%02d", "s").alias("session_id"))


PATHS = "p AS (SELECT DISTINCT l_orderkey % 20 AS s, l_partkey % 3 AS u, l_linenumber % 4 AS c FROM lineitem), paths AS (SELECT 'S' || lpad(CAST(s AS VARCHAR), 2, '0') AS session_id, 'U0' || u AS unit, '/data/train/S' || lpad(CAST(s AS VARCHAR), 2, '0') || '_U0' || u || '.CH' || c || '.wav' AS path FROM p)"
Q["audio_file_groups"] = lambda spark, d: text.audio_files(_paths(spark, d)).withColumn("files", text.select_channels(F.col("files"), "outer_array_mics"))
S["audio_file_groups"] = f"WITH {PATHS} SELECT session_id, unit, [min(path), max(path)] AS files FROM paths GROUP BY ALL"
Q["alias_from_paths"] = lambda spark, d: text.aliases(_paths(spark, d))
S["alias_from_paths"] = f"WITH {PATHS} SELECT 'train' AS alias, list_sort(list(DISTINCT session_id)) AS datasets FROM paths"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed text written and read; of a key's lines the last counts."""
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("key"), F.regexp_replace("text", r"\s+", " ").alias("value"), F.col("turn").alias("pos"))
    return text.keyed(rows.select(F.concat_ws(" ", "key", "value").alias("line"), "pos"))


Q["keyed_text"] = keyed
S["keyed_text"] = "SELECT 'c' || conv_id AS key, arg_max(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), turn) AS value FROM conversations GROUP BY conv_id"


def keyed_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a durations file, sorted, with its range checked."""
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_size").cast("string").alias("value")).where("value > 0")
    path = _scratch(spark)
    sinks.write_keyed(rows, path, "utt2dur")
    return spark.read.text(path).withColumnRenamed("value", "line")


Q["keyed_text_write"] = keyed_written
S["keyed_text_write"] = "SELECT 'p' || p_partkey || ' ' || p_size AS line FROM part WHERE p_size > 0"


def _words(c: F.Column) -> F.Column:
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != "")


def word_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark items as ids of the words that half of the items use; others are 0."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(_words(F.col("text")), " ").alias("text"))
    known = items.where("item_id % 2 = 0").select(F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("id"))
    lines = known.select(F.concat_ws(" ", "word", F.col("id").cast("string")).alias("line"))
    return text.word_ids(items, "text", text.symbol_table(lines), oov=0).select("item_id", "text_ids")


Q["word_ids_oov"] = word_ids
S["word_ids_oov"] = """WITH w AS (SELECT item_id, generate_subscripts(l, 1) AS pos, unnest(l) AS word FROM (SELECT item_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS l FROM benchmark)),
k AS (SELECT word, count(*) AS id FROM w WHERE item_id % 2 = 0 GROUP BY word) SELECT item_id, list(coalesce(id, 0) ORDER BY pos) AS text_ids FROM w LEFT JOIN k USING (word) GROUP BY item_id"""


def _score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), F.col("p_partkey") * 37 + 1000
    line = F.format_string("%%WER %d.%02d [ %d / %d, %d ins, %d del, %d sub ] exp/scoring", F.pmod(k * 7, F.lit(90)), F.pmod(k * 13, F.lit(100)), k * 3, n, k, k, k)
    return p.select((8 + F.pmod(k, F.lit(11))).alias("weight"), k.alias("log"), line.alias("line"))


Q["wer_line_parse"] = lambda spark, d: text.wer(_score_lines(spark, d))
WER = """s AS (SELECT p_partkey AS log, 8 + p_partkey % 11 AS weight, CAST((p_partkey * 7 % 90) || '.' || lpad(CAST(p_partkey * 13 % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS wer,
  p_partkey * 3 AS word_errors, p_partkey * 37 + 1000 AS words, p_partkey AS ins, p_partkey AS del, p_partkey AS sub FROM part)"""
S["wer_line_parse"] = f"WITH {WER} SELECT * FROM s"
Q["best_score"] = lambda spark, d: an.best_score(text.wer(_score_lines(spark, d)))
Q["score_sweep"] = lambda spark, d: an.score_sweep(_score_lines(spark, d), text.wer(_score_lines(spark, d)), 7, 12)
S["score_sweep"] = f"WITH {WER}, w AS (SELECT log, CAST(k AS BIGINT) AS weight FROM (SELECT DISTINCT log FROM s), range(7, 13) r(k)) SELECT * FROM w LEFT JOIN s USING (log, weight)"
S["best_score"] = f"WITH {WER} SELECT * FROM s ORDER BY wer, weight LIMIT 1"


def sentence_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence figures of score logs."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("log"))
    lines = F.array(F.format_string("%%SER %d.50 [ %d / 100 ]", F.pmod("log", F.lit(90)), "log"), F.format_string("Scored %d sentences, %d not present in hyp.", F.col("log") + 5, F.pmod("log", F.lit(2))))
    return text.ser(p.select("log", F.explode(lines).alias("line")), ignore_missing=True)


Q["sentence_error_parse"] = sentence_errors
S["sentence_error_parse"] = "SELECT p_partkey AS log, p_partkey % 90 + 0.5::DOUBLE AS ser, p_partkey AS sentence_errors, CAST(100 AS BIGINT) AS sentences, p_partkey % 2 AS missing FROM part"


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments merged of two files, phone ids mapped to symbols."""
    e = table(spark, sf_dir, "orders").select("o_orderkey", F.sequence(F.lit(1), F.pmod("o_orderkey", F.lit(6)).cast("int") + 2).alias("ids"))
    line = F.concat_ws(" ", F.concat(F.lit("u"), F.col("o_orderkey").cast("string")), F.array_join(F.transform("ids", lambda x: x.cast("string")), " "))
    more = F.concat(line, F.lit(" 9"))
    lines = e.select(line.alias("line"), F.lit("ali.1").alias("file")).union(e.where("o_orderkey % 3 = 0").select(more, F.lit("ali.2")))
    got = text.alignments(lines)
    return got.select("utt_id", "ids", F.transform("ids", lambda i: F.concat(F.lit("ph"), i.cast("string"))).alias("phones"))


Q["alignment_merge"] = alignments
S["alignment_merge"] = """WITH a AS (SELECT o_orderkey, list_concat(range(1, o_orderkey % 6 + 3), CASE WHEN o_orderkey % 3 = 0 THEN [9] ELSE [] END) AS l FROM orders)
SELECT 'u' || o_orderkey AS utt_id, CAST(l AS INT[]) AS ids, list_transform(l, lambda x: 'ph' || x) AS phones FROM a"""
Q["occurrence_codec"] = lambda spark, d: table(spark, d, "nation").select("n_nationkey", text.occurrences_text(F.sequence(F.lit(0), F.col("n_nationkey"))).alias("txt")).withColumn("values", text.occurrences(F.col("txt")))
S["occurrence_codec"] = "SELECT n_nationkey, '[ ' || array_to_string(range(0, n_nationkey + 1), ' ') || ' ]' AS txt, range(0, n_nationkey + 1) AS \"values\" FROM nation"


def activity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity as JSON with parallel arrays for each of two microphones."""
    a = activity(spark, sf_dir).withColumn("mic", F.when(F.col("utt") % 2 == 0, "U01").otherwise("U02"))
    return sinks.activity_json(a)


Q["activity_json"] = activity_documents
S["activity_json"] = f"""WITH {ACTIVITY}, m AS (SELECT session, speaker, CASE WHEN utt % 2 = 0 THEN 'U01' ELSE 'U02' END AS mic, '{{"start":[' || string_agg("start", ',' ORDER BY "start", "end") || '],"end":[' || string_agg("end", ',' ORDER BY "start", "end") || ']}}' AS j
  FROM activity GROUP BY ALL) SELECT session, speaker, '{{' || string_agg('"' || mic || '":' || j, ',' ORDER BY mic) || '}}' AS json FROM m GROUP BY ALL"""


def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word edit distance of each benchmark item to itself without every seventh word, and to nothing."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(_words(F.col("text")), " ").alias("ref"))
    less = F.array_join(F.filter(F.split("ref", " "), lambda w, i: i % 7 != 3), " ")
    got = an.word_errors(items.withColumn("hyp", less), "ref", "hyp")
    return got.select("item_id", "errors", "words")


Q["word_errors"] = word_errors
S["word_errors"] = """SELECT item_id, CAST((n + 3) // 7 AS INT) AS errors, CAST(n AS INT) AS words FROM (SELECT item_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n FROM benchmark)"""


def _arcs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem")
    # parts grow in number, not in size; they hold whole graphs, so that no step by graph shuffles again
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 125_000 + 1)
    o = rows.select("l_orderkey", "l_linenumber", "l_partkey").repartition(parts, "l_orderkey").distinct()
    line = F.concat_ws(" ", F.col("l_linenumber").cast("string"), (F.col("l_linenumber") + 1).cast("string"), F.concat(F.lit("i"), (F.col("l_partkey") % 9).cast("string")), F.concat(F.lit("o"), (F.col("l_partkey") % 5).cast("string")), F.pmod("l_partkey", F.lit(4)).cast("string"))
    lines = o.select(F.col("l_orderkey").alias("graph"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"), line.alias("line"))
    ends = o.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m")).select(F.col("l_orderkey").alias("graph"), F.lit(10**9).cast("bigint").alias("seq"), (F.col("m") + 1).cast("string").alias("line"))
    return graph.parse_text(lines)[0], graph.parse_text(ends)[1]


ARCS = """arcs AS (SELECT l_orderkey AS graph, l_linenumber::BIGINT * 1000000 + l_partkey AS seq, l_linenumber::BIGINT AS src, l_linenumber::BIGINT + 1 AS dst, 'i' || l_partkey % 9 AS ilabel, 'o' || l_partkey % 5 AS olabel, (l_partkey % 4)::DOUBLE AS weight
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem))"""
Q["fst_parse"] = lambda spark, d: _arcs(spark, d)[0]
S["fst_parse"] = f"WITH {ARCS} SELECT * FROM arcs"
Q["fst_find_arc"] = lambda spark, d: graph.find_arc(_arcs(spark, d)[0])
S["fst_find_arc"] = f"WITH {ARCS} SELECT graph, src, ilabel, arg_max(dst, seq) AS dst, arg_max(weight, seq) AS weight FROM arcs GROUP BY ALL"
Q["fst_text"] = lambda spark, d: graph.text(*_arcs(spark, d))
S["fst_text"] = f"""WITH {ARCS}, l AS (SELECT graph, 0 AS k, seq AS place, src || ' ' || dst || ' ' || ilabel || ' ' || olabel AS line FROM arcs UNION ALL SELECT graph, 1, max(dst), CAST(max(dst) AS VARCHAR) FROM arcs GROUP BY graph)
SELECT graph, string_agg(line, chr(10) ORDER BY k, place) AS txt FROM l GROUP BY graph"""


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs without out-of-vocabulary words, input labels renamed, then as integers."""
    arcs = graph.remove_oovs(_arcs(spark, sf_dir)[0], spark.createDataFrame([("i0",), ("o4",)], "word string"))
    arcs = graph.replace_labels(arcs, spark.createDataFrame([("i1", "i2"), ("i3", "i2")], "old string, new string"), "ilabel")
    ids = spark.createDataFrame([(f"i{k}", k) for k in range(9)] + [(f"o{k}", 100 + k) for k in range(5)], "word string, id bigint")
    return graph.labels_to_ints(arcs, ids)


Q["fst_relabel"] = relabelled
S["fst_relabel"] = f"""WITH {ARCS} SELECT graph, seq, src, dst, CAST(CASE WHEN ilabel IN ('i1', 'i3') THEN 2 ELSE CAST(ilabel[2:] AS BIGINT) END AS BIGINT) AS ilabel, CAST(olabel[2:] AS BIGINT) + 100 AS olabel, weight
FROM arcs WHERE ilabel <> 'i0' AND olabel <> 'o4'"""
Q["fst_lattice"] = lambda spark, d: graph.to_lattice(_arcs(spark, d)[0])
S["fst_lattice"] = f"WITH {ARCS} SELECT graph, seq, src || ' ' || dst || ' ' || olabel || ' ' || weight || ',0,' AS line FROM arcs"
Q["fst_project_sort"] = lambda spark, d: graph.arcsort(graph.project(_arcs(spark, d)[0], output=True))
S["fst_project_sort"] = f"WITH {ARCS} SELECT graph, row_number() OVER (PARTITION BY graph ORDER BY src, olabel, seq) - 1 AS seq, src, dst, olabel AS ilabel, olabel, weight FROM arcs"


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs with self loops and start states, with arcs added that aren't there yet."""
    arcs, _ = _arcs(spark, sf_dir)
    more = graph.add_missing_arcs(arcs, arcs.unionByName(arcs.withColumn("olabel", F.lit("new"))))
    loops = graph.add_self_loops(more, "#0")
    return loops.groupBy("graph").agg(F.count("*").alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).join(graph.start_state(arcs), "graph")


Q["fst_edit"] = edited
S["fst_edit"] = f"""WITH {ARCS}, states AS (SELECT graph, src AS s FROM arcs UNION SELECT graph, dst FROM arcs), n AS (SELECT graph, count(*) AS loops FROM states GROUP BY graph),
d AS (SELECT graph, count(*) AS a FROM arcs GROUP BY graph), k AS (SELECT graph, count(DISTINCT (src, dst, ilabel)) AS k FROM arcs GROUP BY graph)
SELECT graph, a + k + loops AS n, loops, arg_min(src, seq) AS "start" FROM arcs JOIN n USING (graph) JOIN d USING (graph) JOIN k USING (graph) GROUP BY ALL"""


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least weight of every state from state 1."""
    arcs, _ = _arcs(spark, sf_dir)
    return graph.shortest_distance(arcs, arcs.where("src = 1").select("graph", F.col("src").alias("state")).distinct())


Q["fst_shortest_distance"] = distances
S["fst_shortest_distance"] = f"""WITH RECURSIVE {ARCS}, d AS (SELECT DISTINCT graph, src AS state, 0.0::DOUBLE AS c FROM arcs WHERE src = 1
  UNION SELECT d.graph, a.dst, d.c + a.weight FROM d JOIN arcs a ON d.graph = a.graph AND d.state = a.src) SELECT graph, state, min(c) AS distance FROM d GROUP BY ALL"""


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each graph composed with a one-state transducer that renames o-labels and doubles nothing."""
    arcs, _ = _arcs(spark, sf_dir)
    loop = arcs.select("graph").distinct().select("graph", F.explode(F.array(*(F.struct(F.lit(f"o{k}").alias("ilabel"), F.lit(f"x{k % 2}").alias("olabel")) for k in range(5)))).alias("l")).select("graph", "l.*")
    loop = loop.select("graph", F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("src"), F.lit(0).cast("bigint").alias("dst"), "ilabel", "olabel", F.lit(0.5).alias("weight"))
    starts = arcs.where("src = 1").select("graph", F.lit(1).cast("bigint").alias("s1"), F.lit(0).cast("bigint").alias("s2")).distinct()
    return graph.compose(arcs, loop, starts).select("graph", "s1", "d1", "ilabel", "olabel", "weight")


Q["fst_compose"] = composed
S["fst_compose"] = f"""WITH RECURSIVE {ARCS}, reach AS (SELECT DISTINCT graph, src AS s FROM arcs WHERE src = 1 UNION SELECT r.graph, a.dst FROM reach r JOIN arcs a ON r.graph = a.graph AND r.s = a.src)
SELECT a.graph, src AS s1, dst AS d1, ilabel, 'x' || (CAST(olabel[2:] AS INT) % 2) AS olabel, weight + 0.5::DOUBLE AS weight FROM arcs a JOIN reach r ON a.graph = r.graph AND a.src = r.s"""


def _gapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Arcs of which every fifth part is silent, and finals: the last state of each graph."""
    arcs, finals = _arcs(spark, sf_dir)
    silent = F.col("weight").cast("int") == 3
    return arcs.withColumns({c: F.when(silent, F.lit("<eps>")).otherwise(F.col(c)) for c in ("ilabel", "olabel")}), finals


GAPPED = f"""{ARCS}, gapped AS (SELECT * REPLACE (CASE WHEN weight = 3 THEN '<eps>' ELSE ilabel END AS ilabel, CASE WHEN weight = 3 THEN '<eps>' ELSE olabel END AS olabel) FROM arcs),
states AS (SELECT graph, src AS s FROM arcs UNION SELECT graph, dst FROM arcs), silent AS (SELECT graph, s AS p, s AS q, 0.0::DOUBLE AS d FROM states UNION SELECT r.graph, p, dst, d + weight FROM silent r JOIN gapped g ON r.graph = g.graph AND r.q = g.src AND g.olabel = '<eps>')"""
Q["fst_remove_epsilon"] = lambda spark, d: graph.remove_epsilon(*_gapped(spark, d))[0].drop("seq")
S["fst_remove_epsilon"] = f"WITH RECURSIVE {GAPPED} SELECT r.graph, p AS src, dst, ilabel, olabel, min(d + weight) AS weight FROM silent r JOIN gapped g ON r.graph = g.graph AND r.q = g.src AND olabel <> '<eps>' GROUP BY ALL"
Q["fst_remove_epsilon_finals"] = lambda spark, d: graph.remove_epsilon(*_gapped(spark, d))[1]
S["fst_remove_epsilon_finals"] = f"WITH RECURSIVE {GAPPED} SELECT r.graph, p AS state, min(d) AS weight FROM silent r JOIN (SELECT graph, max(dst) AS m FROM arcs GROUP BY graph) f ON r.graph = f.graph AND q = m GROUP BY ALL"
Q["fst_topsort"] = lambda spark, d: graph.topsort(_arcs(spark, d)[0])
S["fst_topsort"] = f"""WITH {ARCS}, states AS (SELECT graph, src AS s FROM arcs UNION SELECT graph, dst FROM arcs), into_ AS (SELECT DISTINCT graph, dst FROM arcs),
chains AS (SELECT s.graph, s, max(CASE WHEN i.dst IS NULL THEN s END) OVER (PARTITION BY s.graph ORDER BY s) AS root FROM states s LEFT JOIN into_ i ON s.graph = i.graph AND s.s = i.dst),
named AS (SELECT graph, s, row_number() OVER (PARTITION BY graph ORDER BY s - root, s) - 1 AS n FROM chains)
SELECT a.graph, seq, x.n AS src, y.n AS dst, ilabel, olabel, weight FROM arcs a JOIN named x ON a.graph = x.graph AND a.src = x.s JOIN named y ON a.graph = y.graph AND a.dst = y.s"""


def best_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and length of the best way of each graph from its least state to its final one, where there is one."""
    arcs, finals = _arcs(spark, sf_dir)
    way = graph.shortest_path(arcs, finals, arcs.groupBy("graph").agg(F.min("src").alias("state")))
    return way.groupBy("graph").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.min("src").alias("first"), F.max("dst").alias("last"))


Q["fst_shortest_path"] = best_ways
S["fst_shortest_path"] = f"""WITH RECURSIVE {ARCS}, d AS (SELECT graph, min(src) AS state, 0.0::DOUBLE AS c, 0 AS n FROM arcs GROUP BY graph UNION SELECT d.graph, a.dst, d.c + a.weight, n + 1 FROM d JOIN arcs a ON d.graph = a.graph AND d.state = a.src),
e AS (SELECT graph, min(src) AS first, max(dst) AS last FROM arcs GROUP BY graph) SELECT d.graph, min(c) AS weight, CAST(min(n) AS BIGINT) AS n, first, last FROM d JOIN e ON d.graph = e.graph AND d.state = e.last GROUP BY ALL"""


def sorted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values as JSON whose keys are in order at every depth."""
    n = table(spark, sf_dir, "nation")
    tree = F.struct(F.create_map(F.lit("b"), F.col("n_nationkey"), F.lit("a"), F.col("n_regionkey")).alias("z"), F.array(F.struct(F.col("n_name").alias("y"), F.lit(1).alias("x"))).alias("c"))
    kind = n.select(tree.alias("t")).schema["t"].dataType
    return n.select("n_nationkey", sinks.sorted_json(tree, kind).alias("json"))


Q["sorted_json"] = sorted_documents
S["sorted_json"] = """SELECT n_nationkey, '{"c":[{"x":1,"y":"' || n_name || '"}],"z":{"a":' || n_regionkey || ',"b":' || n_nationkey || '}}' AS json FROM nation"""

QUERIES, ORACLES = Q, S
