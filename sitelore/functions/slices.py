"""Column functions that hold few rows of a batch as Python objects at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

ROWS, BYTES = 64, 1 << 19  # of a slice; a single larger row is a slice of its own


def cut(values: pa.Array, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.Array]:
    """`values`, texts or lists, in order, in slices of at most `rows` rows and about `size` bytes."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    texts = pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist() if texts else [values.nbytes // max(1, len(values))] * len(values)
    at = held = 0
    for i, own in enumerate(sizes):
        if i > at and (i - at == rows or held + own > size):
            yield values.slice(at, i - at)
            at, held = i, 0
        held += own
    if at < len(values):
        yield values.slice(at)


def give_back() -> None:
    """Return freed memory to the system: workers live on and are reused by later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_slices(run: Callable[[list], pa.Array], returns: str):
    """Column function of `run`, a function from a list of values to as many results.

    What Spark sends is up to its settings, 10,000 rows by default, and Python objects take many
    times the bytes of the rows; results leave slice by slice, so a task holds one slice of them.
    """

    def stream(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in cut(batch):
                yield run(part.to_pylist())
            give_back()

    return F.arrow_udf(stream, returns)
