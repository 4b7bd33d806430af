"""Weighted transducers as two tables: arcs (graph, seq, src, dst, ilabel, olabel, weight) and finals (graph, state, weight)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import runs

#: Rows of graphs that are worked on together, of a graph that is worked on in memory, and of what may come of them.
TOGETHER, LARGEST, GROWN = 1 << 17, 1 << 19, 1 << 22


class _Grown(Exception):
    """What comes of these graphs is more than ``GROWN`` rows."""


class _Rows:
    """Rows of whole graphs as numpy columns: ``g`` numbers the graphs; states of one side get numbers over all graphs."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table
        first = runs.changes(table, ["graph"])
        self.first, self.graphs = first, len(first)
        self.g = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
        self.kind = table["_kind"].to_numpy()

    def of(self, kind: int, *columns: str) -> tuple[np.ndarray, ...]:
        """Places of the rows of a kind without nulls in ``columns``, and those columns."""
        at = self.kind == kind
        for c in columns:
            at &= np.asarray(pc.is_valid(self.table[c]))
        at = np.flatnonzero(at)
        return at, *(self.table[c].take(pa.array(at)).to_numpy() for c in columns)

    def nodes(self, *parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Graph and state of each node, and the nodes of each of ``parts``: (places of rows, states)."""
        states = np.concatenate([p[1] for p in parts])
        names, code = np.unique(states, return_inverse=True)
        key, node = np.unique(np.concatenate([self.g[p[0]] for p in parts]) * max(1, len(names)) + code, return_inverse=True)
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        return key // max(1, len(names)), names[key % max(1, len(names))] if len(names) else states, np.split(node, cuts)

    def graph_names(self, g: np.ndarray) -> pa.ChunkedArray:
        return self.table["graph"].take(pa.array(self.first[g]))


def _matches(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): all places of ``keys`` and of ``sorted_keys`` that are equal."""
    lo, hi = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
    n = hi - lo
    if n.sum() > GROWN:
        raise _Grown
    i = np.repeat(np.arange(len(keys)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _least(keys: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The place of the least row by ``order`` of each key."""
    at = np.lexsort((*reversed(order), keys))
    return at[np.flatnonzero(np.append(True, keys[at][1:] != keys[at][:-1]))] if len(at) else at


Found = tuple[dict[str, object], np.ndarray]


def _per_graph(inputs: list[DataFrame], schema: T.StructType, work: Callable[[_Rows], Found]) -> tuple[DataFrame, DataFrame | None]:
    """What ``work`` makes of whole graphs, many at once in numpy, and the graphs that it left (None without any).

    ``inputs`` get ``_kind`` by their place. ``work`` returns columns and the numbers of graphs that it can't end. A graph
    of more than ``LARGEST`` rows, or of which more than ``GROWN`` come, is left too; no worker holds more. The result is
    written to the shared folder.
    """
    from talkweave.sources import shared

    rows = None
    for k, x in enumerate(inputs):
        x = x.where(F.col("graph").isNotNull()).withColumn("_kind", F.lit(k))
        rows = x if rows is None else rows.unionByName(x, allowMissingColumns=True)
    near, together, largest = rows.withColumn("_n", F.row_number().over(Window.partitionBy("graph").orderBy("_kind"))), TOGETHER, LARGEST
    names = [f.name for f in schema.fields]
    full = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema.fields), T.StructField("_left", T.BooleanType())])

    def none(graphs: pa.ChunkedArray, like: list[pa.DataType]) -> pa.RecordBatch:
        n = len(graphs)
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays(graphs.chunks) if c == "graph" else pa.nulls(n, k) for c, k in zip(names, like)), pa.array(np.ones(n, bool))], [*names, "_left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        like = [to_arrow_type(f.dataType) for f in schema.fields]

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            r = _Rows(t)
            try:
                found, left = work(r)
            except _Grown:
                if r.graphs == 1:
                    yield none(t["graph"].slice(0, 1), like)
                else:
                    half = int(r.first[r.graphs // 2])
                    yield from solve(t.slice(0, half))
                    yield from solve(t.slice(half))
                return
            if len(left):
                yield none(r.graph_names(np.unique(left)), like)
            columns = [found[c] if isinstance(found[c], pa.ChunkedArray) else pa.chunked_array([pa.array(found[c], from_pandas=False)]) for c in names]
            out = pa.table([c.cast(k) for c, k in zip(columns, like)], names).append_column("_left", pa.array(np.zeros(len(columns[0]), bool)))
            yield from out.combine_chunks().to_batches(1 << 16)

        for t in runs.whole_groups(batches, ["graph"], together, largest, lambda t: none(t["graph"], like)):
            if isinstance(t, pa.RecordBatch):
                yield t
            else:
                yield from solve(t)

    done = shared.materialise(near.mapInArrow(run, full))
    left = done.where("_left").select("graph")
    return done.where("not _left").select(*names), left if left.take(1) else None


def _only(left: DataFrame, *inputs: DataFrame) -> list[DataFrame]:
    return [x.join(left, "graph", "left_semi") for x in inputs]


def _fields(df: DataFrame, *columns: str) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in columns]


def parse_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs and finals of text lines (graph, seq, line): ``src dst in out [weight]`` or ``state [weight]``."""
    part = F.split(F.trim("line"), r"\s+")
    rows = lines.where(F.trim("line") != "").withColumn("_f", part)
    get = lambda k: F.get("_f", F.lit(k))
    arcs = rows.where(F.size("_f") >= 4).select("graph", "seq", get(0).cast("bigint").alias("src"), get(1).cast("bigint").alias("dst"), get(2).alias("ilabel"), get(3).alias("olabel"), F.coalesce(get(4).cast("double"), F.lit(0.0)).alias("weight"))
    finals = rows.where(F.size("_f") <= 2).select("graph", get(0).cast("bigint").alias("state"), F.coalesce(get(1).cast("double"), F.lit(0.0)).alias("weight"))
    return arcs, finals


def _line() -> Column:
    """An arc as a line of text; arcs of one ``seq`` go by it."""
    return F.concat_ws(" ", "src", "dst", "ilabel", "olabel")


def start_state(arcs: DataFrame) -> DataFrame:
    """(graph, start): the source of the first arc, which is the first line of ``text``; arcs without ``seq`` don't count."""
    place = F.when(F.col("seq").isNotNull(), F.struct("seq", _line().alias("line")))
    return arcs.groupBy("graph").agg(F.min_by("src", place).alias("start"))


def add_missing_arcs(arcs: DataFrame, new: DataFrame) -> DataFrame:
    """Adds arcs whose (src, dst, labels) aren't there yet: of rows with one key those of ``arcs`` all stay, else one of ``new`` does."""
    key = ["graph", "src", "dst", "ilabel", "olabel"]
    both = arcs.withColumn("_new", F.lit(0)).unionByName(new.select(*arcs.columns).withColumn("_new", F.lit(1)))
    # a null in the key equals nothing, so a new arc with one is added even if it is there
    hollow = F.when(F.greatest(*(F.col(c).isNull() for c in key)), F.col("_new")).otherwise(F.lit(0))
    first = F.row_number().over(Window.partitionBy(*key, hollow).orderBy("_new"))
    return both.withColumn("_k", first).where("_new = 0 or _k = 1").select(*arcs.columns)


def find_arc(arcs: DataFrame) -> DataFrame:
    """(graph, src, ilabel, dst, weight): the last arc with that label at each state."""
    return arcs.groupBy("graph", "src", "ilabel").agg(F.max_by("dst", "seq").alias("dst"), F.max_by("weight", "seq").alias("weight"))


def add_self_loops(arcs: DataFrame, label: str) -> DataFrame:
    """A loop with ``label`` at every state that has an arc."""
    states = arcs.select("graph", "seq", F.explode(F.array("src", "dst")).alias("s")).groupBy("graph", "s").agg(F.max("seq").alias("_top"))
    states = states.withColumn("_top", F.max("_top").over(Window.partitionBy("graph"))).where(F.col("graph").isNotNull())
    loops = states.select("graph", (F.col("_top") + 1 + F.col("s")).alias("seq"), F.col("s").alias("src"), F.col("s").alias("dst"), F.lit(label).alias("ilabel"), F.lit(label).alias("olabel"), F.lit(0.0).alias("weight"))
    return arcs.unionByName(loops)


def text(arcs: DataFrame, finals: DataFrame) -> DataFrame:
    """(graph, txt): arcs in order, then finals by state."""
    a = arcs.select("graph", F.struct(F.lit(0).alias("kind"), F.col("seq").cast("bigint").alias("at"), _line().alias("line")).alias("x"))
    f = finals.select("graph", F.struct(F.lit(1).alias("kind"), F.col("state").alias("at"), F.col("state").cast("string").alias("line")).alias("x"))
    lines = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"])
    return a.unionByName(f).groupBy("graph").agg(F.array_join(lines, "\n").alias("txt"))


def remove_oovs(arcs: DataFrame, oovs: DataFrame) -> DataFrame:
    """Arcs whose labels aren't in ``oovs`` (word)."""
    for c in ("ilabel", "olabel"):
        arcs = arcs.join(oovs.select(F.col("word").alias(c)), c, "left_anti")
    return arcs


def replace_labels(arcs: DataFrame, mapping: DataFrame, side: str = "both") -> DataFrame:
    """Labels renamed by (old, new); others stay."""
    out = arcs
    for c in ("ilabel", "olabel"):
        if side in ("both", c):
            out = out.join(mapping.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select(*arcs.columns)


def labels_to_ints(arcs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Labels as the ids of (word, id); a word without one raises."""
    out = arcs
    for c in ("ilabel", "olabel"):
        got = out.join(symbols.select(F.col("word").alias(c), F.col("id").alias("_id")), c, "left")
        out = got.withColumn(c, F.when(F.col("_id").isNull(), F.raise_error(F.concat(F.lit("no id: "), c)).cast("bigint")).otherwise(F.col("_id").cast("bigint"))).drop("_id")
    return out.select(*arcs.columns)


def to_lattice(arcs: DataFrame, acoustic: bool = False) -> DataFrame:
    """(graph, seq, line): lattice text, the weight in the language-model slot or the acoustic one."""
    w = F.col("weight").cast("string")
    cost = F.concat_ws(",", F.lit("0"), w, F.lit("")) if acoustic else F.concat_ws(",", w, F.lit("0"), F.lit(""))
    return arcs.select("graph", "seq", F.concat_ws(" ", "src", "dst", "olabel", cost).alias("line"))


def project(arcs: DataFrame, output: bool = False) -> DataFrame:
    side = "olabel" if output else "ilabel"
    return arcs.withColumns({"ilabel": F.col(side), "olabel": F.col(side)})


def arcsort(arcs: DataFrame, by: str = "ilabel") -> DataFrame:
    """New ``seq`` with the arcs of each state in the order of a label."""
    w = Window.partitionBy("graph").orderBy("src", by, "seq")
    return arcs.withColumn("seq", F.row_number().over(w).cast("bigint") - 1)


def _compose_by_rounds(a: DataFrame, b: DataFrame, starts: DataFrame, most: int = 1000) -> DataFrame:
    """Arcs of the product of two transducers reachable from ``starts`` (graph, s1, s2): an equi join a round of new states.

    Label 0 is epsilon: ``a`` may move alone on an epsilon output and ``b`` alone on an epsilon input (with weight 0 on
    the side that waits). Every round is written to the shared folder, so plans stay short.
    """
    from talkweave.sources import shared

    left = a.select("graph", F.col("src").alias("s1"), F.col("dst").alias("d1"), "ilabel", F.col("olabel").alias("mid"), F.col("weight").alias("w1"))
    right = b.select("graph", F.col("src").alias("s2"), F.col("dst").alias("d2"), F.col("ilabel").alias("mid"), "olabel", F.col("weight").alias("w2"))
    epsilon, names = F.col("mid").cast("string").isin("0", "<eps>"), ["graph", "s1", "s2", "d1", "d2", "ilabel", "olabel", "weight"]
    front = shared.materialise(starts.select("graph", "s1", "s2").distinct())
    seen, out = front, None
    for _ in range(1, most):
        own = front.join(left, ["graph", "s1"])
        both = own.where(~epsilon).join(right, ["graph", "s2", "mid"]).select("graph", "s1", "s2", "d1", "d2", "ilabel", "olabel", (F.col("w1") + F.col("w2")).alias("weight"))
        first = own.where(epsilon).select("graph", "s1", "s2", "d1", F.col("s2").alias("d2"), "ilabel", F.col("mid").alias("olabel"), F.col("w1").alias("weight"))
        second = front.join(right.where(epsilon), ["graph", "s2"]).select("graph", "s1", "s2", F.col("s1").alias("d1"), "d2", F.col("mid").alias("ilabel"), "olabel", F.col("w2").alias("weight"))
        step = shared.materialise(both.select(names).unionByName(first).unionByName(second))
        out = step if out is None else out.unionByName(step)
        front = shared.materialise(step.select("graph", F.col("d1").alias("s1"), F.col("d2").alias("s2")).distinct().join(seen, ["graph", "s1", "s2"], "left_anti"))
        if not front.take(1):
            return out
        seen = seen.unionByName(front)
    raise RuntimeError(f"no end after {most} rounds")


def _shortest_distance_by_rounds(arcs: DataFrame, starts: DataFrame, most: int = 1000) -> DataFrame:
    """(graph, state, distance): least total weight from ``starts`` (graph, state), by rounds of relaxation.

    A round relaxes the arcs of states whose distance the last one lowered, and it ends when there are none. A cycle
    of negative weight has no end and raises after ``most`` rounds.
    """
    from talkweave.sources import shared

    best = shared.materialise(starts.select("graph", "state").distinct().withColumn("distance", F.lit(0.0)))
    edges = arcs.groupBy("graph", F.col("src").alias("state"), "dst").agg(F.min("weight").alias("w"))
    front = best
    for _ in range(most):
        step = front.join(edges, ["graph", "state"]).groupBy("graph", F.col("dst").alias("state")).agg(F.min(F.col("distance") + F.col("w")).alias("new"))
        front = step.join(best, ["graph", "state"], "left").where("distance is null or new < distance")
        front = shared.materialise(front.select("graph", "state", F.col("new").alias("distance")))
        if not front.take(1):
            return best
        best = shared.materialise(best.join(front, ["graph", "state"], "left_anti").unionByName(front))
    raise RuntimeError(f"no end after {most} rounds")


def _topsort_by_rounds(arcs: DataFrame, most: int = 1000) -> DataFrame:
    """Arcs with states renumbered from 0 so that every arc goes upwards: by the longest way to a state, then by its old number.

    A round raises the states behind those that the last one raised; a cycle has no end and raises after ``most``.
    """
    from talkweave.sources import shared

    edges = arcs.select("graph", F.col("src").alias("state"), "dst").distinct()
    states = arcs.select("graph", F.col("src").alias("state")).union(arcs.select("graph", "dst")).distinct()
    level = shared.materialise(states.withColumn("level", F.lit(0)))
    front = level
    for _ in range(most):
        step = front.join(edges, ["graph", "state"]).groupBy("graph", F.col("dst").alias("state")).agg((F.max("level") + 1).alias("new"))
        front = shared.materialise(step.join(level, ["graph", "state"]).where("new > level").select("graph", "state", F.col("new").alias("level")))
        if not front.take(1):
            break
        level = shared.materialise(level.join(front, ["graph", "state"], "left_anti").unionByName(front))
    else:
        raise RuntimeError(f"a cycle, or no end after {most} rounds")
    named = level.withColumn("n", F.row_number().over(Window.partitionBy("graph").orderBy("level", "state")).cast("bigint") - 1).drop("level")
    out = arcs.join(named.withColumnsRenamed({"state": "src", "n": "_src"}), ["graph", "src"]).join(named.withColumnsRenamed({"state": "dst", "n": "_dst"}), ["graph", "dst"])
    return out.withColumns({"src": F.col("_src"), "dst": F.col("_dst")}).select(*arcs.columns)


def _remove_epsilon_by_rounds(arcs: DataFrame, finals: DataFrame, epsilon: str = "<eps>", most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Arcs and finals without arcs of epsilon on both sides: what they lead to is taken over with the least weight of the way."""
    from talkweave.sources import shared

    silent = (F.col("ilabel") == epsilon) & (F.col("olabel") == epsilon)
    moves = arcs.where(silent).groupBy("graph", F.col("src").alias("q"), "dst").agg(F.min("weight").alias("w"))
    states = arcs.select("graph", F.col("src").alias("p")).union(arcs.select("graph", "dst")).union(finals.select("graph", "state")).distinct()
    best = shared.materialise(states.select("graph", "p", F.col("p").alias("q"), F.lit(0.0).alias("d")))
    front = best
    for _ in range(most):
        step = front.join(moves, ["graph", "q"]).groupBy("graph", "p", F.col("dst").alias("q")).agg(F.min(F.col("d") + F.col("w")).alias("new"))
        front = shared.materialise(step.join(best, ["graph", "p", "q"], "left").where("d is null or new < d").select("graph", "p", "q", F.col("new").alias("d")))
        if not front.take(1):
            break
        best = shared.materialise(best.join(front, ["graph", "p", "q"], "left_anti").unionByName(front))
    else:
        raise RuntimeError(f"no end after {most} rounds")
    loud = arcs.where(~silent).withColumnRenamed("src", "q").join(best, ["graph", "q"])
    out = loud.groupBy("graph", F.col("p").alias("src"), "dst", "ilabel", "olabel").agg(F.min(F.col("weight") + F.col("d")).alias("weight"), F.min("seq").alias("seq")).select(*arcs.columns)
    ends = finals.withColumnRenamed("state", "q").join(best, ["graph", "q"]).groupBy("graph", F.col("p").alias("state")).agg(F.min(F.col("weight") + F.col("d")).alias("weight"))
    return out, ends


def _shortest_path_by_rounds(arcs: DataFrame, finals: DataFrame, starts: DataFrame, most: int = 1000) -> DataFrame:
    """The arcs of a way of least weight (then fewest arcs) from ``starts`` (graph, state) to a final state, one way a graph; weights aren't negative."""
    from talkweave.sources import shared

    best = shared.materialise(starts.select("graph", "state").distinct().withColumns({"d": F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("hops")), "via": F.lit(None).cast("bigint")}))
    edges = arcs.select("graph", F.col("src").alias("state"), "dst", "weight", "seq")
    front = best
    for _ in range(most):
        reached = F.struct((F.col("d.w") + F.col("weight")).alias("w"), (F.col("d.hops") + 1).alias("hops"))
        step = front.join(edges, ["graph", "state"]).groupBy("graph", F.col("dst").alias("state")).agg(F.min(F.struct(reached.alias("d"), F.col("seq").alias("via"))).alias("x")).select("graph", "state", F.col("x.d").alias("new"), "x.via")
        front = shared.materialise(step.join(best.select("graph", "state", "d"), ["graph", "state"], "left").where("d is null or new < d").select("graph", "state", F.col("new").alias("d"), "via"))
        if not front.take(1):
            break
        best = shared.materialise(best.join(front, ["graph", "state"], "left_anti").unionByName(front))
    else:
        raise RuntimeError(f"no end after {most} rounds")
    end = finals.join(best, ["graph", "state"]).groupBy("graph").agg(F.min(F.struct((F.col("d.w") + F.col("weight")).alias("w"), F.col("d.hops").alias("h"), "state")).alias("x"))
    at, out = shared.materialise(end.select("graph", "x.state")), None
    for _ in range(most):
        arc = arcs.join(at.join(best, ["graph", "state"]).where("via is not null").select("graph", F.col("state").alias("dst"), F.col("via").alias("seq")), ["graph", "dst", "seq"]).select(*arcs.columns)
        arc = shared.materialise(arc)
        out = arc if out is None else out.unionByName(arc)
        at = arc.select("graph", F.col("src").alias("state"))
        if not at.take(1):
            return out
    raise RuntimeError(f"no end after {most} rounds")


def compose(a: DataFrame, b: DataFrame, starts: DataFrame, most: int = 1000) -> DataFrame:
    """Arcs of the product of two transducers reachable from ``starts`` (graph, s1, s2).

    Label 0 is epsilon: ``a`` may move alone on an epsilon output and ``b`` alone on an epsilon input (with weight 0 on
    the side that waits). Graphs are worked on whole, many at once; large ones by rounds of joins.
    """
    kinds = {x.schema[c].dataType for x in (a, b) for c in ("ilabel", "olabel")}
    if len(kinds) > 1:
        return _compose_by_rounds(a, b, starts, most)
    label = kinds.pop()
    schema = T.StructType([*_fields(a, "graph"), *(T.StructField(c, T.LongType()) for c in ("s1", "s2", "d1", "d2")), T.StructField("ilabel", label), T.StructField("olabel", label), T.StructField("weight", T.DoubleType())])

    def work(r: _Rows) -> Found:
        (a1, src1, dst1), (a2, src2, dst2), (at, s1, s2) = r.of(0, "src", "dst"), r.of(1, "src", "dst"), r.of(2, "s1", "s2")
        _, name1, (u1, v1, f1) = r.nodes((a1, src1), (a1, dst1), (at, s1))
        _, name2, (u2, v2, f2) = r.nodes((a2, src2), (a2, dst2), (at, s2))
        words = pa.chunked_array([*r.table["ilabel"].chunks, *r.table["olabel"].chunks]).combine_chunks()
        words = words if isinstance(words, pa.Array) else words.chunk(0)
        code = pc.fill_null(words.dictionary_encode().indices, -1).to_numpy().astype(np.int64)
        silent = np.asarray(pc.fill_null(pc.is_in(words.cast(pa.string()), pa.array(["0", "<eps>"])), False))
        n = r.table.num_rows
        mid1, mid2, eps1, eps2 = code[n:][a1], code[:n][a2], silent[n:][a1], silent[:n][a2]
        w = r.table["weight"].to_numpy()
        by1, m = np.argsort(u1, kind="stable"), int(code.max(initial=0)) + 2
        loud2 = np.flatnonzero(~eps2 & (mid2 >= 0))
        by2 = loud2[np.argsort(u2[loud2] * m + mid2[loud2], kind="stable")]
        key2 = u2[by2] * m + mid2[by2]
        still2 = np.flatnonzero(eps2)
        still2 = still2[np.argsort(u2[still2], kind="stable")]
        N, front, parts, total = max(1, len(name2)), np.unique(f1 * max(1, len(name2)) + f2), [], 0
        seen = front
        for _ in range(1, most):
            p1, p2 = front // N, front % N
            i, j = _matches(u1[by1], p1)
            j = by1[j]
            first, own = np.flatnonzero(eps1[j]), np.flatnonzero(~eps1[j] & (mid1[j] >= 0))
            x, y = _matches(key2, p2[i[own]] * m + mid1[j[own]])
            both = own[x]
            k, e = _matches(u2[still2], p2)
            e = still2[e]
            # rows: pair of states before and after, place of ilabel, olabel, weight
            step = [np.concatenate(c) for c in (
                (front[i[both]], front[i[first]], front[k]),
                (v1[j[both]] * N + v2[by2[y]], v1[j[first]] * N + p2[i[first]], p1[k] * N + v2[e]),
                (a1[j[both]], a1[j[first]], a2[e]), (n + a2[by2[y]], n + a1[j[first]], n + a2[e]),
                (w[a1[j[both]]] + w[a2[by2[y]]], w[a1[j[first]]], w[a2[e]]),
            )]
            parts.append(step)
            total += len(step[0])
            if total > GROWN:
                raise _Grown
            front = np.setdiff1d(step[1], seen)
            if not len(front):
                break
            seen = np.union1d(seen, front)
        pair, to, il, ol, weight = (np.concatenate(c) for c in zip(*parts))
        owner = np.zeros(max(1, len(name1)), np.int64)
        for places, nodes in ((a1, u1), (a1, v1), (at, f1)):
            owner[nodes] = r.g[places]
        left = np.unique(owner[front // N]) if len(front) else np.zeros(0, np.int64)
        g = owner[pair // N]
        keep = ~np.isin(g, left)
        pair, to, il, ol, weight, g = (c[keep] for c in (pair, to, il, ol, weight, g))
        take = lambda c: pa.chunked_array([words.take(pa.array(c))])
        name = lambda names, c: names[c] if len(names) else c
        return {"graph": r.graph_names(g), "s1": name(name1, pair // N), "s2": name(name2, pair % N), "d1": name(name1, to // N), "d2": name(name2, to % N), "ilabel": take(il), "olabel": take(ol), "weight": weight}, left

    cols = lambda x: x.select("graph", "src", "dst", "ilabel", "olabel", "weight")
    done, left = _per_graph([cols(a), cols(b), starts.select("graph", "s1", "s2")], schema, work)
    return done if left is None else done.unionByName(_compose_by_rounds(*_only(left, a, b, starts), most))


def _relaxed(r: _Rows, starts: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, nodes: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least weight of each node, whether it is reached, and the nodes that still fall after ``most`` rounds."""
    d, reached, active = np.full(nodes, np.inf), np.zeros(nodes, bool), np.zeros(nodes, bool)
    d[starts], reached[starts], active[starts] = 0.0, True, True
    for _ in range(most):
        on = np.flatnonzero(active[u])
        new, touched = d.copy(), np.zeros(nodes, bool)
        np.fmin.at(new, v[on], d[u[on]] + w[on])
        touched[v[on]] = True
        active = (new < d) | (touched & ~reached)
        reached |= active
        d = new
        if not active.any():
            break
    return d, reached, np.flatnonzero(active)


def shortest_distance(arcs: DataFrame, starts: DataFrame, most: int = 1000) -> DataFrame:
    """(graph, state, distance): least total weight from ``starts`` (graph, state).

    Graphs are worked on whole, many at once; large ones by rounds of joins. A cycle of negative weight has no end and
    raises after ``most`` rounds.
    """

    def work(r: _Rows) -> Found:
        (at, src, dst, w), (s, state) = r.of(0, "src", "dst", "weight"), r.of(1, "state")
        owner, name, (u, v, first) = r.nodes((at, src), (at, dst), (s, state))
        d, reached, falling = _relaxed(r, first, u, v, w, len(owner), most)
        left = np.unique(owner[falling])
        got = np.flatnonzero(reached & ~np.isin(owner, left))
        return {"graph": r.graph_names(owner[got]), "state": name[got], "distance": d[got]}, left

    schema = T.StructType([*_fields(starts, "graph", "state"), T.StructField("distance", T.DoubleType())])
    done, left = _per_graph([arcs.select("graph", "src", "dst", "weight"), starts.select("graph", "state")], schema, work)
    return done if left is None else done.unionByName(_shortest_distance_by_rounds(*_only(left, arcs, starts), most))


def topsort(arcs: DataFrame, most: int = 1000) -> DataFrame:
    """Arcs with states renumbered from 0 so that every arc goes upwards: by the longest way to a state, then by its old number.

    Graphs are worked on whole, many at once; large ones by rounds of joins. A cycle has no end and raises after ``most``.
    """

    def work(r: _Rows) -> Found:
        at, src, dst = r.of(0, "src", "dst")
        owner, name, (u, v) = r.nodes((at, src), (at, dst))
        level, active = np.zeros(len(owner), np.int64), np.ones(len(owner), bool)
        for _ in range(most):
            on = np.flatnonzero(active[u])
            new = level.copy()
            np.maximum.at(new, v[on], level[u[on]] + 1)
            active = new > level
            level = new
            if not active.any():
                break
        left = np.unique(owner[active])
        order = np.lexsort((name, level, owner))
        begins = np.searchsorted(owner, np.arange(r.graphs))
        n = np.empty(len(owner), np.int64)
        n[order] = np.arange(len(owner)) - begins[owner[order]]
        keep = ~np.isin(r.g[at], left)
        rows = r.table.take(pa.array(at[keep]))
        return {c: n[u[keep]] if c == "src" else n[v[keep]] if c == "dst" else rows[c] for c in arcs_columns}, left

    arcs_columns = arcs.columns
    schema = T.StructType([T.StructField(c, T.LongType() if c in ("src", "dst") else arcs.schema[c].dataType) for c in arcs.columns])
    done, left = _per_graph([arcs], schema, work)
    return done if left is None else done.unionByName(_topsort_by_rounds(*_only(left, arcs), most))


def remove_epsilon(arcs: DataFrame, finals: DataFrame, epsilon: str = "<eps>", most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Arcs and finals without arcs of epsilon on both sides: what they lead to is taken over with the least weight of the way.

    Graphs are worked on whole, many at once; large ones, and those of which very much comes, by rounds of joins.
    """

    def work(r: _Rows) -> Found:
        (at, src, dst, w), (f, state, end) = r.of(0, "src", "dst", "weight"), r.of(1, "state", "weight")
        owner, name, (u, v, last) = r.nodes((at, src), (at, dst), (f, state))
        labels = [r.table[c].take(pa.array(at)) for c in ("ilabel", "olabel")]
        hush = np.logical_and(*(np.asarray(pc.fill_null(pc.equal(c, epsilon), False)) for c in labels))
        known = np.logical_and(*(np.asarray(pc.is_valid(c)) for c in labels))
        il, ol = (pc.fill_null(c.combine_chunks().dictionary_encode().indices if isinstance(c.combine_chunks(), pa.Array) else c.combine_chunks().chunk(0).dictionary_encode().indices, -1).to_numpy().astype(np.int64) for c in labels)
        N = max(1, len(owner))
        moves = np.flatnonzero(hush)
        moves = moves[np.argsort(u[moves], kind="stable")]
        key, d = np.arange(len(owner)) * (N + 1), np.zeros(len(owner))  # p * N + q, in order
        front, fd = key, d
        for _ in range(most):
            i, j = _matches(u[moves], front % N)
            to, cost = (front // N)[i] * N + v[moves[j]], fd[i] + w[moves[j]]
            least = _least(to, cost)
            to, cost = to[least], cost[least]
            place = np.minimum(np.searchsorted(key, to), max(0, len(key) - 1))
            old = key[place] == to if len(key) else np.zeros(0, bool)
            better = ~old | (cost < d[place] if len(key) else True)
            front, fd = to[better], cost[better]
            if not len(front):
                break
            d[place[better & old]] = cost[better & old]
            key, d = np.concatenate([key, to[~old]]), np.concatenate([d, cost[~old]])
            order = np.argsort(key, kind="stable")
            key, d = key[order], d[order]
            if len(key) > GROWN:
                raise _Grown
        left = np.unique(owner[front // N]) if len(front) else np.zeros(0, np.int64)
        good = ~np.isin(owner[key // N], left)
        p, q, d = key[good] // N, key[good] % N, d[good]
        loud = np.flatnonzero(~hush & known)
        loud = loud[np.argsort(u[loud], kind="stable")]
        i, j = _matches(u[loud], q)
        j, weight = loud[j], w[loud[j]] + d[i]
        seq = r.table["seq"].take(pa.array(at)).to_numpy()
        same = np.lexsort((ol[j], il[j], v[j], p[i]))
        i, j, weight = i[same], j[same], weight[same]
        marks = [p[i], v[j], il[j], ol[j]]
        cut = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in marks]))) if len(i) else np.zeros(0, np.int64)
        low, first = (np.fmin.reduceat(weight, cut), np.minimum.reduceat(seq[j], cut)) if len(cut) else (weight, seq[j])
        src_, dst_, rows = p[i][cut], v[j][cut], pa.array(at[j[cut]])
        done = np.argsort(last, kind="stable")
        i, j = _matches(last[done], q)
        state_, cost = p[i], end[done[j]] + d[i]
        least = _least(state_, cost)
        state_, cost = state_[least], cost[least]
        nulls = lambda c, n: pa.nulls(n, r.table[c].type)
        return {
            "graph": r.graph_names(owner[np.concatenate([src_, state_])]), "src": name[np.concatenate([src_, state_])], "end": np.repeat([False, True], [len(src_), len(state_)]),
            "dst": pa.chunked_array([pa.array(name[dst_]).cast(pa.int64()), pa.nulls(len(state_), pa.int64())]), "weight": np.concatenate([low, cost]), "seq": pa.chunked_array([pa.array(first), nulls("seq", len(state_)).cast(pa.array(first).type)]),
            **{c: pa.chunked_array([*r.table[c].take(rows).chunks, nulls(c, len(state_))]) for c in ("ilabel", "olabel")},
        }, left

    schema = T.StructType([*_fields(arcs, "graph", "src", "dst", "ilabel", "olabel", "seq"), T.StructField("weight", T.DoubleType()), T.StructField("end", T.BooleanType())])
    done, left = _per_graph([arcs.select("graph", "seq", "src", "dst", "ilabel", "olabel", "weight"), finals.select("graph", "state", "weight")], schema, work)
    out, ends = done.where("not end").select(*arcs.columns), done.where("end").select("graph", F.col("src").alias("state"), "weight")
    if left is None:
        return out, ends
    more, last = _remove_epsilon_by_rounds(*_only(left, arcs, finals), epsilon, most)
    return out.unionByName(more), ends.unionByName(last)


def shortest_path(arcs: DataFrame, finals: DataFrame, starts: DataFrame, most: int = 1000) -> DataFrame:
    """The arcs of a way of least weight (then fewest arcs) from ``starts`` (graph, state) to a final state, one way a graph; weights aren't negative.

    Graphs are worked on whole, many at once; large ones by rounds of joins.
    """
    columns = arcs.columns

    def work(r: _Rows) -> Found:
        (at, src, dst, w, seq), (f, state, end), (s, begin) = r.of(0, "src", "dst", "weight", "seq"), r.of(1, "state", "weight"), r.of(2, "state")
        owner, name, (u, v, last, first) = r.nodes((at, src), (at, dst), (f, state), (s, begin))
        d, hops, via, active = np.full(len(owner), np.inf), np.zeros(len(owner), np.int64), np.full(len(owner), -1), np.zeros(len(owner), bool)
        reached = np.zeros(len(owner), bool)
        d[first], reached[first], active[first] = 0.0, True, True
        for k in range(most):
            on = np.flatnonzero(active[u])
            cost = d[u[on]] + w[on]
            least = _least(v[on], cost, seq[on])
            on, cost = on[least], cost[least]
            better = (cost < d[v[on]]) | ~reached[v[on]]
            on, cost = on[better], cost[better]
            active = np.zeros(len(owner), bool)
            to = v[on]
            active[to], reached[to], d[to], hops[to], via[to] = True, True, cost, k + 1, on
            if not len(on):
                break
        left = np.unique(owner[active])
        ends = np.flatnonzero(reached[last] & ~np.isin(owner[last], left))
        node = last[ends]
        node = node[_least(owner[node], d[node] + end[ends], hops[node], name[node])]
        way = []
        while len(node):
            arc = via[node]
            arc = arc[arc >= 0]
            way.append(arc)
            node = u[arc]
        rows = r.table.take(pa.array(at[np.concatenate([np.zeros(0, np.int64), *way])]))
        return {c: rows[c] for c in columns}, left

    schema = T.StructType(_fields(arcs, *columns))
    done, left = _per_graph([arcs, finals.select("graph", "state", "weight"), starts.select("graph", "state")], schema, work)
    return done if left is None else done.unionByName(_shortest_path_by_rounds(*_only(left, arcs, finals, starts), most))
