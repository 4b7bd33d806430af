"""The folder that all executors share, and the tables that are written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session (tests) may leave it unset and gets a temporary folder of this process.

    Elsewhere a folder of one machine would lose data, so an unset one raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir isn't set, and the executors of {master} need a folder that all of them share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="talkweave-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends, or with ``release``."""
    new = f"{folder(spark)}/talkweave-{kind}-{uuid.uuid4().hex}"
    _system(spark, new)[0].deleteOnExit(_system(spark, new)[1])
    _written.append(new)
    return new


def _system(spark: SparkSession, name: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(name)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def mark() -> int:
    """How many paths were given so far, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int, *keep: str) -> None:
    """Deletes what was written to paths given since that mark, but for ``keep``."""
    for name in _written[since:]:
        if name not in keep:
            system, at = _system(spark, name)
            system.delete(at, True)
    _written[since:] = [name for name in _written[since:] if name in keep]


def materialise(df: DataFrame, at: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage is cut, what isn't deterministic is fixed, and no executor holds it."""
    at = at or path(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
