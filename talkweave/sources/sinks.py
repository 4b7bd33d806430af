"""Sinks: JSON documents, keyed text, activity tables, audio files."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkweave.functions import nested

from talkweave.operators import catalog

FOLDERS = 64


def sorted_json(value: Column, kind: T.DataType, indent: bool = False) -> Column:
    """JSON text with keys in order at every depth, on one line or indented; ``kind`` is the value's type."""
    return F.to_json(nested.sorted_tree(value, kind), {"pretty": str(indent).lower()})


def sorted_map(tree: Column) -> Column:
    return F.map_from_entries(F.sort_array(F.map_entries(tree)))


def dump_database(examples: DataFrame, path: str) -> None:
    """One JSON object an example, partitioned by dataset. The path must end in ``.json``."""
    if not path.endswith(".json"):
        raise ValueError(f"{path} doesn't end in .json")
    examples.write.partitionBy("dataset").json(path)


def dump_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def keyed_lines(df: DataFrame, kind: str = "text") -> DataFrame:
    """(line) of (key, value) in the order of the keys; ``utt2dur`` checks 0 < value < 1000, ``spk2gender`` maps to m and f."""
    value = F.col("value").cast("string")
    if kind == "utt2dur":
        df = catalog.gate(df, ~((F.col("value").cast("double") > 0) & (F.col("value").cast("double") < 1000)), "a duration lies outside (0, 1000)")
    elif kind == "spk2gender":
        value = F.when(F.lower(value).isin("m", "male"), "m").when(F.lower(value).isin("f", "female"), "f").otherwise(F.raise_error(F.concat(F.lit("no gender: "), value)).cast("string"))
    return df.orderBy("key").select(F.concat_ws(" ", "key", value).alias("line"))


def write_keyed(df: DataFrame, path: str, kind: str = "text") -> None:
    keyed_lines(df, kind).write.text(path)


def write_activity(df: DataFrame, path: str) -> None:
    """Interval table partitioned by session: what the per-session activity cache is for."""
    df.write.partitionBy("session").parquet(path)


def activity_json(df: DataFrame) -> DataFrame:
    """(session, speaker, json): intervals of each microphone as parallel arrays ``{"mic": {"start": [...], "end": [...]}}``."""
    pair = F.sort_array(F.collect_list(F.struct("start", "end")))
    per = df.groupBy("session", "speaker", "mic").agg(F.struct(F.transform(pair, lambda x: x["start"]).alias("start"), F.transform(pair, lambda x: x["end"]).alias("end")).alias("v"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("mic", "v"))))
    return per.groupBy("session", "speaker").agg(F.to_json(entries).alias("json"))


def speaker_activity(rows: DataFrame, cross: DataFrame) -> DataFrame:
    """(session, json): of each session the speakers' intervals by microphone and, under ``cross_talk``, those of ``cross`` by microphone.

    ``rows``: (session, speaker, mic, start, end), ``cross``: (session, mic, start, end).
    """
    own = activity_json(rows).select("session", F.struct(F.lit(0).alias("k"), F.col("speaker").alias("name"), "json").alias("x"))
    both = activity_json(cross.select("session", F.lit("cross_talk").alias("speaker"), "mic", "start", "end")).select("session", F.struct(F.lit(1).alias("k"), F.col("speaker").alias("name"), "json").alias("x"))
    parts = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.concat(F.lit('"'), x["name"], F.lit('":'), x["json"]))
    return own.unionByName(both).groupBy("session").agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("json"))


def mounted(path: str) -> str | None:
    """The name by which plain file calls reach a path of Hadoop; None if it isn't in a local or mounted folder."""
    at = urlsplit(path)
    return path if path.startswith("/") else unquote(at.path) if at.scheme == "file" else None


def file_name(name: str | None) -> str:
    """A file's name for any name, which ``text.documents`` takes back: ``=`` and two digits for what isn't safe, ``=null`` for none."""
    if name is None:
        return "=null.json"
    safe = quote(name, safe="").replace("%", "=")
    # Spark doesn't read files whose names begin with a dot or a line
    return (f"={ord(safe[0]):02X}{safe[1:]}" if safe[:1] in (".", "_") else safe or "=") + ".json"


def write_documents(df: DataFrame, path: str) -> None:
    """A file for each row of (name, value); ``text.documents`` reads them. Names are distinct: another text under one raises.

    On a local or mounted folder the tasks write the files themselves, into 64 folders by the name's hash: Spark's
    partitioned write makes a folder and a checksum file a name and starts processes that set their permissions, which
    takes far longer than the text. Files get their name when they are whole, so a task may run again. Elsewhere it is
    that write, into folders ``name=...``.
    """
    root, folders = mounted(path), FOLDERS
    if root is None:
        df.select("name", "value").repartition("name").write.partitionBy("name").text(path)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in range(folders):
            os.makedirs(f"{root}/{k:02d}", exist_ok=True)
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                named, text = file_name(name.as_py()), ((value.as_py() or "") + "\n").encode()
                folder = f"{root}/{zlib.crc32(named.encode()) % folders:02d}"
                at, new = f"{folder}/{named}", f"{folder}/.{uuid.uuid4().hex}"
                if os.path.exists(at):
                    with open(at, "rb") as f:
                        if f.read() != text:
                            raise ValueError(f"two texts for {name.as_py()!r}")
                    continue
                with open(new, "wb") as f:
                    f.write(text)
                os.replace(new, at)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    os.makedirs(root)
    df.select("name", "value").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


def write_speaker_activity(rows: DataFrame, cross: DataFrame, path: str) -> None:
    """A JSON file a session, named by it, see ``speaker_activity`` and ``write_documents``."""
    write_documents(speaker_activity(rows, cross).withColumnsRenamed({"session": "name", "json": "value"}), path)


def read_activity(spark: SparkSession, path: str, schema: str = "speaker string, start bigint, end bigint, session string") -> DataFrame:
    """The interval table that ``write_activity`` wrote; a filter on ``session`` reads that session's files alone."""
    return spark.read.schema(schema).parquet(path)


def summary(value: Column) -> Column:
    """The shape of an array instead of its items."""
    return F.concat(F.lit("array("), F.size(value).cast("string"), F.lit(")"))
