"""Queries over the catalog: selection, set operations, joins, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.operators import analytics as an
from talkweave.operators import catalog as cat

from .fixtures import ACTIVITY, TURNS, activity, table, turns

Q = {}
S = {}


def _catalog(spark: SparkSession, sf_dir: str) -> cat.Catalog:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("example_id"), F.col("o_orderpriority").alias("dataset"), (F.col("o_custkey") * 10).alias("num_samples"))
    alias = spark.createDataFrame([("high", "1-URGENT"), ("high", "2-HIGH"), ("low", "5-LOW")], "alias string, dataset string")
    return cat.Catalog(o, alias)


Q["alias_expand"] = lambda spark, d: _catalog(spark, d).get_datasets(["high", "5-LOW"])
S["alias_expand"] = """SELECT CAST(o_orderkey AS VARCHAR) AS example_id, CASE WHEN o_orderpriority = '5-LOW' THEN '5-LOW' ELSE 'high' END AS dataset, o_custkey * 10 AS num_samples
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')"""
Q["datasets_union_all"] = lambda spark, d: _catalog(spark, d).get_datasets(["5-LOW", "5-LOW"]).groupBy("dataset").agg(F.count("*").alias("n"))
S["datasets_union_all"] = "SELECT o_orderpriority AS dataset, 2 * count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY ALL"
Q["example_lengths"] = lambda spark, d: _catalog(spark, d).get_lengths("high", lambda n: n + 1)
S["example_lengths"] = "SELECT CAST(o_orderkey AS VARCHAR) AS example_id, o_custkey * 10 + 1 AS length FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"
Q["dataset_names"] = lambda spark, d: spark.createDataFrame([(i, n) for i, n in enumerate(_catalog(spark, d).dataset_names)], "place bigint, name string")
S["dataset_names"] = """SELECT row_number() OVER (ORDER BY k, name) - 1 AS place, name FROM (SELECT DISTINCT 0 AS k, o_orderpriority AS name FROM orders UNION ALL VALUES (1, 'high'), (1, 'low'))"""
Q["redacted_filter"] = lambda spark, d: cat.not_redacted(turns(spark, d)).groupBy("session").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
S["redacted_filter"] = f"WITH {TURNS} SELECT session, count(*) AS n, min(pos) AS first FROM turns WHERE transcription <> '[redacted]' GROUP BY session"
Q["id_semi_join"] = lambda spark, d: cat.id_filter(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id")
S["id_semi_join"] = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
Q["id_in_list"] = lambda spark, d: cat.id_filter(table(spark, d, "nation"), ["FRANCE", "NATION_3", "GERMANY", "NATION_7"], "n_name")
S["id_in_list"] = "SELECT * FROM nation WHERE n_name IN ('FRANCE', 'NATION_3', 'GERMANY', 'NATION_7')"
Q["session_filter"] = lambda spark, d: cat.session_filter(turns(spark, d).withColumnRenamed("session", "session_id"), "S7")
S["session_filter"] = f"WITH {TURNS} SELECT session AS session_id, speaker, pos, \"start\", \"end\", transcription FROM turns WHERE session = 'S7'"
Q["not_empty"] = lambda spark, d: cat.not_empty(table(spark, d, "orders").select("o_orderkey", F.nullif(F.pmod("o_custkey", F.lit(5)), F.lit(1)).alias("n"), F.pmod("o_orderkey", F.lit(3)).alias("m")), "n", "m")
S["not_empty"] = "SELECT * FROM (SELECT o_orderkey, nullif(o_custkey % 5, 1) AS n, o_orderkey % 3 AS m FROM orders) WHERE coalesce(n, m) > 0"


def undamaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of sessions without the damaged and the missing ones."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.lpad((F.col("l_orderkey") % 30).cast("string"), 2, "0")).alias("session_id"), F.concat(F.lit("U0"), F.col("l_linenumber").cast("string")).alias("array")).distinct()
    missing = spark.createDataFrame([("S01", "U05"), ("S12", "U02")], "session_id string, array string")
    return cat.without_missing_arrays(rows.where(cat.undamaged(F.col("session_id"), F.col("array"))), missing)


Q["missing_anti_join"] = undamaged
S["missing_anti_join"] = """SELECT DISTINCT s AS session_id, u AS "array" FROM (SELECT 'S' || lpad(CAST(l_orderkey % 30 AS VARCHAR), 2, '0') AS s, 'U0' || l_linenumber AS u FROM lineitem)
WHERE NOT (s IN ('S05', 'S22') AND u = 'U03') AND (s, u) NOT IN (('S01', 'U05'), ('S12', 'U02'))"""


def little_cross_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of which at most a fifth is overlapped."""
    per = an.overlap_per_utterance(activity(spark, sf_dir))
    return cat.cross_talk_filter(per.select("session", "utt", F.col("length").alias("num_samples"), F.col("overlap").alias("overlap_samples")), 0.2)


def _share() -> str:
    from .intervals import SHARE

    return SHARE


Q["crosstalk_filter"] = little_cross_talk
S["crosstalk_filter"] = f'{_share()} SELECT session, utt, length AS num_samples, "overlap" AS overlap_samples FROM per WHERE "overlap" <= 0.2::DOUBLE * length'
Q["dataset_slice"] = lambda spark, d: cat.dataset_slice(turns(spark, d).select("session", "pos"), True, ["pos"], "session")
S["dataset_slice"] = f"WITH {TURNS} SELECT session, pos FROM turns QUALIFY row_number() OVER (PARTITION BY session ORDER BY pos) <= 2"
Q["dataset_stride"] = lambda spark, d: cat.dataset_slice(table(spark, d, "orders").select("o_orderkey"), slice(5, 900, 7), ["o_orderkey"])
S["dataset_stride"] = "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n >= 5 AND n < 900 AND (n - 5) % 7 = 0"
Q["dataset_first"] = lambda spark, d: cat.dataset_slice(table(spark, d, "orders").select("o_orderkey"), 25, ["o_orderkey"])
S["dataset_first"] = "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25"
Q["shard_slice"] = lambda spark, d: cat.shard(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 3, 8)
S["shard_slice"] = "SELECT o_orderkey, o_custkey FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 8 = 2"


def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' names expanded to their nations; a nation's own name stays."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    groups = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("name"), F.col("n_name").alias("session"))
    wanted = r.select(F.col("r_name").alias("name")).union(n.select("n_name"))
    return cat.session_ids(wanted, groups)


Q["session_ids"] = session_ids
S["session_ids"] = "SELECT n_name AS session FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT n_name FROM nation"


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments merged from two overlapping halves."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return cat.merge(c.where("key % 3 <> 0"), c.where("key % 3 <> 1"))


Q["merge_tables"] = merged
S["merge_tables"] = "SELECT c_custkey AS key, c_mktsegment AS value FROM customer"
Q["prefer_channel"] = lambda spark, d: cat.prefer_first(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("CH"), F.col("l_linenumber").cast("string")).alias("channel")), "l_orderkey", "channel", ["CH3", "CH1", "CH2"])
S["prefer_channel"] = """SELECT l_orderkey, l_linenumber, 'CH' || l_linenumber AS channel FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_linenumber WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS p
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3)) WHERE p = 1"""
Q["disjoint_union"] = lambda spark, d: cat.disjoint_union(*(table(spark, d, "customer").where(f"c_custkey % 2 = {k}").select("c_custkey") for k in (0, 1)), key="c_custkey")
S["disjoint_union"] = "SELECT c_custkey FROM customer"
Q["missing_keys"] = lambda spark, d: cat.missing_from(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
S["missing_keys"] = "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
Q["shared_keys"] = lambda spark, d: cat.shared_keys("doc_id", table(spark, d, "documents"), table(spark, d, "labels"), table(spark, d, "documents").where("lang = 'en'"))
S["shared_keys"] = "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels"


def _files(spark: SparkSession, sf_dir: str, last: int) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where(f"l_linenumber <= {last}").select("l_orderkey", "l_linenumber").distinct()
    return rows.select(F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("utt"), F.when(F.col("l_linenumber") % 2 == 0, "worn").otherwise("observation").alias("type"), F.concat(F.lit("CH"), F.col("l_linenumber").cast("string")).alias("channel"), F.concat_ws("/", F.lit("/a"), F.col("l_orderkey").cast("string"), F.concat(F.col("l_linenumber").cast("string"), F.lit(".wav"))).alias("path"))


FILES = """files AS (SELECT DISTINCT 'u' || l_orderkey AS utt, CASE WHEN l_linenumber % 2 = 0 THEN 'worn' ELSE 'observation' END AS type, 'CH' || l_linenumber AS channel, '/a/' || l_orderkey || '/' || l_linenumber || '.wav' AS path, l_linenumber AS k FROM lineitem)"""
Q["file_lists_combined"] = lambda spark, d: cat.combine_file_lists(_files(spark, d, 7), _files(spark, d, 7).where("channel not in ('CH2', 'CH6')"), "_b")
S["file_lists_combined"] = f"WITH {FILES}, f AS (SELECT utt, type, channel, path FROM files WHERE k NOT IN (2, 6)) SELECT * FROM f UNION ALL SELECT utt || '_b', type, channel, path FROM f"
Q["file_list_channel"] = lambda spark, d: cat.for_channel(_files(spark, d, 7), "CH2")
S["file_list_channel"] = f"WITH {FILES} SELECT utt, type, channel, path FROM files WHERE k = 2"
Q["available_channels"] = lambda spark, d: cat.available_channels(_files(spark, d, 7))
S["available_channels"] = f"WITH {FILES} SELECT type, list_sort(list(DISTINCT channel)) AS channels FROM files GROUP BY type"
Q["audio_files_exist"] = lambda spark, d: cat.all_exist(_files(spark, d, 7).select("path"), _files(spark, d, 7).select("path"))
S["audio_files_exist"] = f"WITH {FILES} SELECT path FROM files"
Q["dimension_lookup"] = lambda spark, d: cat.resolve(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
S["dimension_lookup"] = "SELECT n_nationkey, c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"


def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns put together by position with the same turns shifted in time."""
    t = turns(spark, sf_dir).select("session", "pos", "start", "end")
    return cat.positional(t, t.withColumns({"start": F.col("start") + 7, "end": F.col("end") + 7}), ["session"])


Q["positional_join"] = positional
S["positional_join"] = f'WITH {TURNS} SELECT session, pos, "start", "end", "start" + 7 AS start_r, "end" + 7 AS end_r FROM turns'
Q["group_by_ordered"] = lambda spark, d: an.grouped(turns(spark, d).select("session", "pos", "speaker"), "session", "pos", "speaker").select("session", F.transform("items", lambda x: x["speaker"]).alias("speakers"))
S["group_by_ordered"] = f"WITH {TURNS} SELECT session, list(speaker ORDER BY pos) AS speakers FROM turns GROUP BY session"


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of each session and its one first user, recomputed from the rows."""
    a = activity(spark, sf_dir)
    first = an.consistent(a.join(a.groupBy("session").agg(F.min_by("speaker", "utt").alias("first")), "session"), ["session"], "first")
    return an.session_speakers(a).join(first, "session").select("session", F.size("speakers").alias("n"), "speakers", "first")


Q["dimension_recompute"] = dimensions
S["dimension_recompute"] = f"""WITH {ACTIVITY} SELECT session, CAST(count(DISTINCT speaker) AS INT) AS n, list_sort(list(DISTINCT speaker)) AS speakers, arg_min(speaker, utt) AS first FROM activity GROUP BY session"""
Q["extreme_flags"] = lambda spark, d: an.flag_extremes(table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), "n")
S["extreme_flags"] = "SELECT *, n = min(n) OVER () AS n_is_min, n = max(n) OVER () AS n_is_max FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL)"


def missing_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without an annotation (every fourth lacks one) by session."""
    a = activity(spark, sf_dir)
    return an.missing_annotations(a.select("session", "utt"), a.where("utt % 4 <> 0").select("utt"))


Q["missing_annotations"] = missing_annotations
S["missing_annotations"] = f"""WITH {ACTIVITY} SELECT session, list_sort(list(utt) FILTER (utt % 4 = 0)) AS missing, count(DISTINCT utt) AS n, count(DISTINCT utt) FILTER (utt % 4 = 0) AS n_missing FROM activity GROUP BY session"""

QUERIES, ORACLES = Q, S
