"""Rows of many small groups handed to numpy together: whole groups, several at a time, without a Python call for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a new group begins in rows that lie together by ``keys``, 0 included."""
    n = table.num_rows
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n - 1, bool)
    for k in keys:
        c = table[k].combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        new |= ~np.asarray(pc.fill_null(pc.equal(c.slice(1), c.slice(0, n - 1)), False))
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int, most: int | None = None, left: Callable[[pa.Table], pa.RecordBatch] | None = None) -> Iterator[pa.Table | pa.RecordBatch]:
    """Tables of whole groups, of some ``rows`` rows each, of a stream in which groups lie together.

    Of a group of more than ``most`` rows only ``left`` of its first row is yielded, and no more than ``most`` and a
    batch of its rows are held.
    """
    held, count, skipped = [], 0, None
    for b in batches:
        t = pa.Table.from_batches([b])
        if skipped is not None:
            starts = changes(pa.concat_tables([skipped, t]), keys)
            t = t.slice(starts[1] - 1) if len(starts) > 1 else t.slice(t.num_rows)
            skipped = None if t.num_rows else skipped
        if not t.num_rows:
            continue
        held.append(t)
        count += t.num_rows
        if count < rows:
            continue
        t = pa.concat_tables(held).combine_chunks()
        last = int(changes(t, keys)[-1])
        if last:
            yield t.slice(0, last)
            t = t.slice(last)
        if most is not None and t.num_rows > most:
            yield left(t.slice(0, 1))
            skipped, t = t.slice(0, 1), t.slice(t.num_rows)
        held, count = ([t], t.num_rows) if t.num_rows else ([], 0)
    if held:
        yield pa.concat_tables(held).combine_chunks()
