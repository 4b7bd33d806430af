"""Plumbing of the corpus operators: tables, samples, column checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkweave.sources import shared

#: The folder that all executors share, and tables written there: see ``talkweave.sources.shared``.
shared_folder, materialise = shared.folder, shared.materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ... (so that added names can't clash) and its own names."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.columns


def own(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast; exactly these names are meant, so a ``Text`` beside ``text`` doesn't matter."""
    need(df, *kinds)
    plain, names = numbered(df)
    kept = {n: plain[f"c{names.index(n)}"] for n in kinds}
    same = dict(df.dtypes) if len(set(names)) == len(names) else {}
    return plain.select(*(c.alias(n) if same.get(n) == kinds[n] else c.cast(kinds[n]).alias(n) for n, c in kept.items()))


def sampled_ids(ids: DataFrame, rows: int, seed: int) -> DataFrame:
    """Of the distinct values of ``doc_id`` those ``rows`` of least hash: a bounded sample that depends on neither order, copies nor partitions.

    A task sends its own ``rows`` least ones, each once, so neither an id that a third of all rows has nor the number
    of rows matters.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            rank, key = np.concatenate([rank, np.asarray(batch.column(0))]), np.concatenate([key, np.asarray(batch.column(1))])
            order = np.lexsort((key, rank))
            rank, key = rank[order], key[order]
            new = np.ones(len(key), bool)
            new[1:] = (rank[1:] != rank[:-1]) | (key[1:] != key[:-1])
            rank, key = rank[new][:rows], key[new][:rows]
        yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(key)], ["_rank", "doc_id"])

    ranked = ids.where("doc_id is not null").select(F.xxhash64(F.lit(seed), "doc_id").alias("_rank"), F.col("doc_id").cast("bigint").alias("doc_id"))
    return ranked.mapInArrow(least, "_rank bigint, doc_id bigint").distinct().orderBy("_rank", "doc_id").limit(rows).select("doc_id")


def one_a_doc(rows: DataFrame, *columns: str) -> DataFrame:
    """One row of each ``doc_id`` (the least), so that an id that is repeated a million times is one row wherever it goes next."""
    return rows.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("r")).select("doc_id", "r.*")
