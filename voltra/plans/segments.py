"""Whole segments in Arrow batches: many short ones at once, long ones alone, none in a pandas group of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are gathered before whole segments are worked on; a longer segment is worked on alone.
ROWS = 65_536


def _whole(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables of whole segments, in the order of the rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(key)
        if held and rows >= ROWS:
            last = held[-1].column(key)[-1].as_py()
            new = np.flatnonzero(ids.to_numpy() != last)
            if len(new):
                cut = int(new[0])
                yield pa.Table.from_batches([*held, b.slice(0, cut)] if cut else held)
                b, held, rows = b.slice(cut), [], 0
            elif held[0].column(key)[0].as_py() != last:  # segments before the one that goes on
                table = pa.Table.from_batches(held)
                first = int(np.flatnonzero(table.column(key).to_numpy() == last)[0])
                yield table.slice(0, first)
                held = table.slice(first).to_batches()
                rows -= first
        held.append(b)
        rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def over(signal: DataFrame, order: str, schema: str, fn: Callable[[pa.Table, np.ndarray], pa.Table]) -> DataFrame:
    """``fn`` (table of whole segments sorted by id and ``order``, first row of each and the end) over all segments.

    Segments are dealt by id and sorted by the JVM; a worker holds about ``ROWS`` rows, or one segment if that is longer.
    """
    key = signal.columns.index("_id")

    def run(batches):
        for table in _whole(batches, key):
            ids = table.column(key).to_numpy()
            bounds = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
            yield from fn(table, bounds).to_batches()

    return signal.repartition("_id").sortWithinPartitions("_id", order).mapInArrow(run, schema)


def values(table: pa.Table, names: list[str]) -> np.ndarray:
    """Rows by channels; nulls are NaN."""
    return np.column_stack([table.column(c).to_numpy().astype(float) for c in names]) if names else np.zeros((len(table), 0))


def by_length(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the segments, their rows as a matrix) for each length."""
    size = np.diff(bounds)
    for n in np.unique(size).tolist():
        which = np.flatnonzero(size == n)
        yield which, bounds[which][:, None] + np.arange(n)


def column(v: np.ndarray) -> pa.Array:
    """A double column; NaN becomes null."""
    return pa.array(v, pa.float64(), from_pandas=True)
