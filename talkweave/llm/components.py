"""Connected components of an edge table.

Up to ``local_edges`` edges (a checked size, 16 bytes each) one task joins them
with an array union; more are resolved by rounds of large-star and small-star,
each round written to the shared folder.  Both give the least id of each
component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) in order, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def components(edges: DataFrame, local_edges: int = 2_000_000) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: bigint); self-loops and nulls count for nothing."""
    edges = common.materialise(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= local_edges:

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
            if got:
                node, least = labels(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], ["node", "component"])

        return edges.coalesce(1).mapInArrow(join, "node bigint, component bigint")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
        large = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        new = common.materialise(small)
        if not new.exceptAll(edges).take(1) and new.count() == edges.count():
            return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = new
