"""Nested values: flattening, mapping and broadcasting trees."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_json(text: Column) -> Column:
    """A JSON object of one level as (key, value text) pairs, on the JVM."""
    return F.from_json(text, "map<string,string>")


def _walk(value: object, path: tuple[str, ...], lists: bool) -> Iterator[tuple[tuple[str, ...], object]]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _walk(v, (*path, str(k)), lists)
    elif isinstance(value, list) and lists:
        for k, v in enumerate(value):
            yield from _walk(v, (*path, str(k)), lists)
    else:
        yield path, value


def flatten_tree(df: DataFrame, keys: list[str], text: str, lists: bool = False, reverse: bool = False) -> DataFrame:
    """Leaves of JSON of any depth: (keys, path, leaf); a null text gives no row. Trees are walked in Arrow batches."""
    own = df.select(*keys, F.col(text).alias("_tree")).where("_tree is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, path, leaf = [], [], []
            for i, tree in enumerate(batch.column(len(keys)).to_pylist()):
                for p, v in _walk(json.loads(tree), (), lists):
                    row.append(i)
                    path.append(p[::-1] if reverse else p)
                    leaf.append(json.dumps(v))
            kept = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(path, pa.list_(pa.string())), pa.array(leaf, pa.string())], [*keys, "path", "leaf"])

    schema = T.StructType([*own.drop("_tree").schema.fields, T.StructField("path", T.ArrayType(T.StringType())), T.StructField("leaf", T.StringType())])
    return own.mapInArrow(run, schema)


def map_leaves(tree: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` on every value of a map."""
    return F.transform_values(tree, lambda _, v: fn(v))


def map_aligned(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn`` on the values of two maps; their key sets must match."""
    same = F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))
    return F.when(same, F.map_zip_with(a, b, lambda _, x, y: fn(x, y))).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("the keys differ"))))


def broadcast_to(value: Column, tree: Column) -> Column:
    """A scalar as a map with the keys of ``tree``."""
    return F.transform_values(tree, lambda _k, _v: value)


def to_list(value: Column, is_array: bool = False) -> Column:
    """A scalar as an array of one; an array as it is."""
    return value if is_array else F.array(value)


def values_by_key(tree: Column) -> Column:
    """Values of a map in the order of its keys."""
    return F.transform(F.sort_array(F.map_entries(tree)), lambda e: e["value"])


def map_tree(tree: Column, kind: T.DataType, fn: Callable[[Column], Column], lists: bool = False) -> Column:
    """``fn`` on every leaf of structs and maps of any depth (of arrays too with ``lists``); ``kind`` is the tree's type."""
    if isinstance(kind, T.StructType):
        return F.when(tree.isNotNull(), F.struct(*(map_tree(tree[f.name], f.dataType, fn, lists).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.MapType):
        return F.transform_values(tree, lambda _, v: map_tree(v, kind.valueType, fn, lists))
    if isinstance(kind, T.ArrayType) and lists:
        return F.transform(tree, lambda v: map_tree(v, kind.elementType, fn, lists))
    return fn(tree)


def map_trees(a: Column, b: Column, kind: T.DataType, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn`` on the leaves of two trees of one type; maps must have the same keys everywhere."""
    if isinstance(kind, T.StructType):
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(*(map_trees(a[f.name], b[f.name], f.dataType, fn).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.MapType):
        return map_aligned(a, b, lambda x, y: map_trees(x, y, kind.valueType, fn))
    return fn(a, b)


def broadcast_tree(value: Column, value_kind: T.DataType, tree: Column, kind: T.DataType) -> Column:
    """A shallower tree spread over a deeper one: where ``value`` has a leaf, all leaves below that place get it. Keys must match."""
    if isinstance(kind, T.StructType) and isinstance(value_kind, T.StructType):
        if sorted(value_kind.names) != sorted(kind.names):
            raise ValueError(f"the keys differ: {value_kind.names} and {kind.names}")
        return F.when(tree.isNotNull(), F.struct(*(broadcast_tree(value[f.name], value_kind[f.name].dataType, tree[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.MapType) and isinstance(value_kind, T.MapType):
        return map_aligned(value, tree, lambda x, y: broadcast_tree(x, value_kind.valueType, y, kind.valueType))
    if isinstance(value_kind, (T.StructType, T.MapType)):
        raise ValueError("the value is deeper than the tree")
    return map_tree(tree, kind, lambda _: value)


def sorted_tree(tree: Column, kind: T.DataType) -> Column:
    """The same tree with fields and keys in order, at every depth."""
    if isinstance(kind, T.StructType):
        return F.when(tree.isNotNull(), F.struct(*(sorted_tree(tree[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(tree))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: sorted_tree(F.element_at(tree, k), kind.valueType)))
    if isinstance(kind, T.ArrayType):
        return F.transform(tree, lambda v: sorted_tree(v, kind.elementType))
    return tree
