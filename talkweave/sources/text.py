"""Annotation sources: transcripts, diarisation, keyed text, logs, alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.functions import ids, timebase
from talkweave.operators import catalog, intervals
from talkweave.sources import sinks

TRANSCRIPT_MULTI = T.StructType([
    T.StructField("start_time", T.MapType(T.StringType(), T.StringType())), T.StructField("end_time", T.MapType(T.StringType(), T.StringType())),
    *(T.StructField(c, T.StringType()) for c in ("words", "speaker", "session_id", "location", "ref")),
])
TRANSCRIPT_SINGLE = T.StructType([T.StructField(c, T.StringType()) for c in ("start_time", "end_time", "words", "speaker", "session_id", "location", "ref")])
#: Endings of files that the text reader unpacks.
PACKED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst")
EXAMPLE = "session_id string, num_samples bigint, start bigint, end bigint, speaker_id string, transcription string, audio_path array<string>"


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON document or list of them with a fixed schema; what doesn't fit raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parse_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def json_database(spark: SparkSession, path: str, example: str = EXAMPLE) -> tuple[DataFrame, DataFrame]:
    """Examples (dataset, example_id, ...) and alias (alias, dataset) of a catalog document."""
    doc = json_document(spark, path, f"datasets map<string, map<string, struct<{example_fields(example)}>>>, alias map<string, array<string>>")
    rows = doc.select(F.explode("datasets").alias("dataset", "_e")).select("dataset", F.explode("_e").alias("example_id", "_x")).select("dataset", "example_id", "_x.*")
    alias = doc.select(F.explode("alias").alias("alias", "_d")).select("alias", F.explode("_d").alias("dataset"))
    return rows, alias


def example_fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in ddl.split(", ")))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of all text files below ``path``, each whole.

    Plain ones are read as bytes: the reader of whole texts sets up a job's configuration for every file, five times
    the time of reading small ones. It is left to what it unpacks.
    """
    at = F.col("_metadata.file_path").alias("path")
    packed = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(PACKED) + "}").text(path, wholetext=True).select(at, "value")
    plain = ~F.col("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in PACKED) + ")$")
    # also in the value: a filter that is inferred from what is made of it may come before this one
    value = F.when(plain, F.col("content").cast("string")).alias("value")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(plain).select(at, value).unionByName(packed)


def transcripts(spark: SparkSession, path: str, multi: bool) -> DataFrame:
    """Transcript rows with their place in the file (pos) and the file's path; times in samples.

    A file is one session's list, read as a whole, so that the places don't depend on how files are packed into tasks.
    What doesn't fit the schema raises.
    """
    row = T.ArrayType(TRANSCRIPT_MULTI if multi else TRANSCRIPT_SINGLE)
    raw = whole_files(spark, path).select("path", F.from_json("value", row, {"mode": "FAILFAST"}).alias("_l"))
    raw = raw.select("path", F.posexplode("_l").alias("pos", "_t")).select("path", "pos", "_t.*")
    conv = timebase.map_to_samples if multi else timebase.to_samples
    return raw.withColumns({"start_time": conv(F.col("start_time")), "end_time": conv(F.col("end_time"))})


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of the files that ``sinks.write_documents`` wrote."""
    if sinks.mounted(path) is None:
        return spark.read.option("wholetext", True).schema("value string, name string").text(path).select("name", "value")
    stem = F.regexp_extract("path", r"([^/]*)\.json$", 1)
    name = F.when(stem != "=null", F.url_decode(F.replace(F.when(stem == "=", "").otherwise(stem), F.lit("="), F.lit("%"))))
    return whole_files(spark, path).select(name.alias("name"), "value")


def examples(original: DataFrame, realigned: DataFrame, least: int = 0, broken: tuple[str, ...] = ()) -> DataFrame:
    """Single-clock example rows of two transcripts put together by position: ids from the original times, times from the realigned.

    Both have session_id, pos, speaker, words, start, end. Fewer than ``least`` rows in a session raise; ids in
    ``broken`` are left out.
    """
    both = catalog.positional(original, realigned, ["session_id"])
    rows = both.select(
        ids.example_id(F.col("speaker"), F.col("session_id"), F.col("start"), F.col("end"), True).alias("example_id"), "session_id", F.col("speaker").alias("speaker_id"),
        F.col("words").alias("transcription"), F.col("start_r").alias("start"), F.col("end_r").alias("end"), (F.col("end_r") - F.col("start_r")).alias("num_samples"),
    )
    rows = rows.where(~F.col("example_id").isin(list(broken))) if broken else rows
    if least:
        few = rows.groupBy("session_id").agg(F.count("*").alias("_n"))
        rows = catalog.gate(rows.join(few, "session_id"), F.col("_n") < least, f"a session has fewer than {least} rows").drop("_n")
    return rows


def original_time_only(df: DataFrame) -> DataFrame:
    """Multi-clock transcripts rewritten to the single original clock."""
    return df.withColumns({c: F.element_at(F.col(c), "original") for c in ("start_time", "end_time")})


def rttm(lines: DataFrame, rate: int = 16000) -> DataFrame:
    """(file, speaker, start, end) of diarisation lines (value); a line of another type or between two samples raises."""
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.trim("value") != "").select(part.alias("f"))
    rows = catalog.gate(rows, F.get("f", F.lit(0)) != "SPEAKER", "not a SPEAKER line")
    begin, length = F.get("f", F.lit(3)).cast("decimal(20,7)"), F.get("f", F.lit(4)).cast("decimal(20,7)")
    low, high = begin * F.lit(rate), (begin + length) * F.lit(rate)
    rows = rows.select(F.get("f", F.lit(1)).alias("file"), F.get("f", F.lit(7)).alias("speaker"), low.alias("lo"), high.alias("hi"))
    rows = catalog.gate(rows, (F.col("lo") != F.floor("lo")) | (F.col("hi") != F.floor("hi")), "not a whole sample")
    return rows.select("file", "speaker", F.col("lo").cast("bigint").alias("start"), F.col("hi").cast("bigint").alias("end"))


def rttm_intervals(lines: DataFrame, rate: int = 16000) -> DataFrame:
    return intervals.normalise(rttm(lines, rate), ["file", "speaker"])


def rttm_examples(rows: DataFrame) -> DataFrame:
    """Example rows of diarisation intervals: file ids cleaned (a clash of two names raises), one row an interval."""
    named = rows.withColumn("session_id", ids.file_id(F.col("file")))
    clash = named.groupBy("session_id").agg(F.count_distinct("file").alias("_n"))
    named = catalog.gate(named.join(clash, "session_id"), F.col("_n") > 1, "two files have one id").drop("_n")
    return named.select(
        ids.diarised_id(F.col("session_id"), F.col("speaker"), F.col("start"), F.col("end")).alias("example_id"), "start", "end",
        (F.col("end") - F.col("start")).alias("num_samples"), "session_id", F.col("speaker").alias("speaker_id"),
    )


def aliases(paths: DataFrame) -> DataFrame:
    """(alias, datasets): parent folder of each file -> its session ids in order. ``paths`` has path, session_id."""
    return paths.groupBy(F.element_at(F.split("path", "/"), -2).alias("alias")).agg(F.sort_array(F.collect_set("session_id")).alias("datasets"))


def audio_files(paths: DataFrame, per_array: int = 4) -> DataFrame:
    """(session_id, unit, files) of wav paths ``.../S02_U06.CH1.wav`` or ``S02_P05.wav``; an array with another number of files raises."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = paths.where(name.rlike(r"^S\d+_[UP]\d+.*\.wav$")).select(F.regexp_extract(name, r"^(S\d+)_", 1).alias("session_id"), F.regexp_extract(name, r"_([UP]\d+)", 1).alias("unit"), "path")
    files = rows.groupBy("session_id", "unit").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return catalog.gate(files, F.col("unit").startswith("U") & (F.size("files") != per_array), f"an array hasn't {per_array} files")


def select_channels(files: Column, multiarray: bool | str) -> Column:
    """All channels (True), first and last (outer_array_mics), the first (first_array_mics)."""
    if multiarray == "outer_array_mics":
        return F.array(F.element_at(files, 1), F.element_at(files, -1))
    if multiarray == "first_array_mics":
        return F.array(F.element_at(files, 1))
    if multiarray is True:
        return files
    raise ValueError(f"no selection {multiarray!r}")


def keyed(lines: DataFrame) -> DataFrame:
    """(key, value) of ``key rest`` lines with their order (pos); the last line of a key wins."""
    part = F.split(F.col("line"), " ", 2)
    rows = lines.where(F.trim("line") != "").select(F.get(part, F.lit(0)).alias("key"), F.coalesce(F.get(part, F.lit(1)), F.lit("")).alias("value"), "pos")
    return rows.groupBy("key").agg(F.max_by("value", "pos").alias("value"))


def symbol_table(lines: DataFrame) -> DataFrame:
    """(word, id) of lines of exactly two fields; others are skipped."""
    part = F.split(F.col("line"), " ")
    return lines.select(part.alias("f")).where(F.size("f") == 2).select(F.get("f", F.lit(0)).alias("word"), F.get("f", F.lit(1)).try_cast("bigint").alias("id"))


WER_LINE = r"%WER\s+([\d.]+)\s+\[\s*(\d+)\s*/\s*(\d+),\s*(\d+)\s+ins,\s*(\d+)\s+del,\s*(\d+)\s+sub\s*\]"


def wer(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows of score lines: wer, word_errors, words, ins, del, sub; lines without a score are left out."""
    c = F.col(column)
    names = ("word_errors", "words", "ins", "del", "sub")
    keep = [x for x in lines.columns if x != column]
    return lines.where(c.rlike(WER_LINE)).select(*keep, F.regexp_extract(c, WER_LINE, 1).cast("double").alias("wer"), *(F.regexp_extract(c, WER_LINE, k + 2).cast("bigint").alias(n) for k, n in enumerate(names)))


def ser(lines: DataFrame, ignore_missing: bool = False) -> DataFrame:
    """Sentence figures of score logs: ser, sentence_errors, sentences, missing; missing hypotheses raise unless ignored."""
    line, pattern = F.col("line"), r"%SER\s+([\d.]+)\s+\[\s*(\d+)\s*/\s*(\d+)\s*\]"
    scored = r"Scored\s+(\d+)\s+sentences,\s+(\d+)\s+not present"
    got = lines.groupBy("log").agg(
        F.max(F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1).try_cast("double"))).alias("ser"),
        F.max(F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 2).try_cast("bigint"))).alias("sentence_errors"),
        F.max(F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 3).try_cast("bigint"))).alias("sentences"),
        F.max(F.when(line.rlike(scored), F.regexp_extract(line, scored, 2).try_cast("bigint"))).alias("missing"),
    )
    return got if ignore_missing else catalog.gate(got, F.col("missing") > 0, "hypotheses are missing")


def alignments(lines: DataFrame) -> DataFrame:
    """(utt_id, ids) of ``utt id id ...`` lines with the file they come from; of an id in several files the last file's counts."""
    part = F.split(F.trim("line"), r"\s+")
    rows = lines.where(F.trim("line") != "").select(F.get(part, F.lit(0)).alias("utt_id"), F.transform(F.slice(part, F.lit(2), F.size(part) - 1), lambda x: x.cast("int")).alias("ids"), "file")
    return rows.groupBy("utt_id").agg(F.max_by("ids", "file").alias("ids"))


def occurrences(text: Column) -> Column:
    """``[ 1 2 3 ]`` as an array of integers."""
    inner = F.trim(F.regexp_replace(text, r"[\[\]]", " "))
    return F.when(inner == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(inner, r"\s+"), lambda x: x.cast("bigint")))


def occurrences_text(values: Column) -> Column:
    return F.concat(F.lit("[ "), F.array_join(F.transform(values, lambda x: x.cast("string")), " "), F.lit(" ]"))


def word_ids(df: DataFrame, text: str, symbols: DataFrame, oov: int | None = None) -> DataFrame:
    """Adds ``<text>_ids``: the words' ids; an unknown word gets ``oov``, or raises without one; a missing text raises.

    The vocabulary is joined, not put in a map, so that it may be large. Each distinct text is looked up once, and the
    ids come back to the rows by the text, so no row number is needed.
    """
    df = catalog.gate(df, F.col(text).isNull(), f"{text} is missing")
    texts = df.select(F.col(text).alias("_row")).distinct()
    long = texts.select("_row", F.posexplode_outer(F.filter(F.split(F.trim("_row"), r"\s+"), lambda w: w != "")).alias("_pos", "word")).join(symbols.select("word", F.col("id").cast("bigint").alias("id")), "word", "left")
    unknown = F.lit(oov).cast("bigint") if oov is not None else F.raise_error(F.concat(F.lit("no id: "), F.col("word"))).cast("bigint")
    long = long.withColumn("id", F.when(F.col("word").isNull(), F.lit(None).cast("bigint")).when(F.col("id").isNull(), unknown).otherwise(F.col("id")))
    ids_ = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("_pos", "id"))), lambda x: x["_pos"].isNotNull()), lambda x: x["id"])
    got = long.groupBy("_row").agg(ids_.alias(f"{text}_ids"))
    return df.join(got, df[text] == got["_row"]).drop("_row")
