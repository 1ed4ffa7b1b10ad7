"""Arrow batches inside tasks: short slices, and groups of neighbouring rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sitelore.functions.slices import give_back


def small_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that few of them exist as Python objects.
    Memory of a batch goes back to the system when its rows are done, that of a task at its end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()
    give_back()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key values, rows) of each run of equal keys; holds one run at a time.

    The partition must be sorted by `keys`, and its runs must be bounded by the caller.
    """
    held: list[pa.Table] = []
    now: tuple | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        n = table.num_rows
        if not n:
            continue
        change = np.zeros(n - 1, dtype=bool)
        for k in keys:
            col = table[k].combine_chunks()
            change |= pc.not_equal(col[1:], col[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(table[k][a].as_py() for k in keys)
            if key != now and held:
                yield now, pa.concat_tables(held)
                held = []
            now = key
            held.append(table.slice(a, b - a))
    if held:
        yield now, pa.concat_tables(held)
    held = []
    give_back()


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths as a float64 matrix."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return values.reshape(len(flat), -1) if len(flat) else np.empty((0, 0))
