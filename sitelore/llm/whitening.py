"""Embedding whitening by an incremental eigendecomposition.

1. Each distinct vector counts once: one exchange by vector, written.
2. Exact count and per-dimension sums, one row a dimension from each task.
3. Each task keeps the eigenpairs of its vectors' scatter up to date, one centred rank-one
   change a vector (`spectra`). Spectra of tasks are combined in groups of FAN, round after
   round, by one rank-one change per eigenpair, until one is left.
4. Rayleigh-Ritz: the covariance within the basis found is summed over all vectors, in d by d
   partial sums, and its eigenpairs turn the basis. The basis spans the whole space, so the
   result is exact to double precision whatever the updates have rounded.
5. One more pass measures how far the whitened fit list is from unit covariance; then every
   row is projected where it lies.

The driver and the tasks hold matrices of d by d numbers, never vectors of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.llm.spectra import Spectrum
from sitelore.session import materialize

SCALE, SHIFT = 64, 1_000_000
FAN = 16  # spectra combined in one task of a round
LEAST = 1e-13  # of the trace: a smaller eigenvalue is rounding, not variance
EXACT = 1 << 62


def valid(vector: Column) -> Column:
    """Not null and without null or non-finite entries."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def quantised(vector: Column) -> Column:
    """Entries as whole numbers, floor(64 c) + 1000000 (beyond a long: its nearest)."""
    top = float(2**62)
    return F.transform(
        vector, lambda c: (F.floor(F.least(F.greatest(c * SCALE, F.lit(-top)), F.lit(top))) + SHIFT).cast("long")
    )


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, rows: int = 2048) -> Iterator[np.ndarray]:
    """Whole-number vectors of a batch as matrices."""
    for batch in batches:
        flat = batch.column("x")
        for at in range(0, len(flat), rows):
            part = flat.slice(at, rows)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dims)


def _moments(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of each dimension."""

    def sums(batches):
        n, total = 0, [0] * dims
        for x in _blocks(batches, dims):
            n += len(x)
            small = int(np.abs(x).max()) * len(x) < EXACT
            part = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                 pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["dim", "n", "total"],
            )

    rows = fit.mapInArrow(sums, "dim int, n long, total decimal(38,0)").groupBy("dim")
    found = rows.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    return (found[0].n, [int(r.total) for r in found]) if found else (0, [])


class Centre:
    """Distances from the mean S/n, centred before anything is multiplied."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.near = [s // n for s in sums]
        self.rest = [s - n * c for s, c in zip(sums, self.near)]

    def whole(self, x: np.ndarray) -> np.ndarray:
        """n x - S as exact whole numbers (Python's where 64 bits do not hold them)."""
        near, rest = np.array(self.near, dtype="int64"), np.array(self.rest, dtype="int64")
        most = max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.near))
        if most * self.n < EXACT:
            return self.n * (x - near) - rest
        return self.n * (x.astype(object) - near.astype(object)) - rest.astype(object)

    def away(self, x: np.ndarray) -> np.ndarray:
        return (self.whole(x) / self.n).astype("float64")

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of n x - S, exact; null where it does not fit a long."""
        whole = self.whole(x)
        if whole.dtype != object and float(np.abs(whole).max()) ** 2 * whole.shape[1] < EXACT:
            return (whole * whole).sum(axis=1).tolist()
        found = [sum(int(v) ** 2 for v in row) for row in whole]
        return [f if f < 2**63 else None for f in found]


_SPECTRUM = "part long, n long, mean array<double>, vals array<double>, vecs array<double>"


def _row(part: int, s: Spectrum) -> pa.RecordBatch:
    lists = [pa.array([v.ravel().tolist()], pa.list_(pa.float64())) for v in (s.mean, s.values, s.vectors)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), *lists], ["part", "n", "mean", "vals", "vecs"]
    )


def _basis(fit: DataFrame, dims: int, centre: Centre) -> np.ndarray:
    """Orthonormal columns near the eigenvectors, from the combined spectra of all tasks."""

    def follow(batches):
        from pyspark import TaskContext

        s = Spectrum.empty(dims)
        for x in _blocks(batches, dims):
            for row in centre.away(x):
                s.add(row)
        if s.n:
            yield _row(TaskContext.get().partitionId(), s)

    def combine(batches):
        now, both = None, None
        for batch in batches:
            for part, n, mean, vals, vecs in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "mean", "vals", "vecs"))):
                s = Spectrum(n, np.array(mean), np.array(vals), np.array(vecs).reshape(dims, dims))
                if part // FAN != now and both is not None:
                    yield _row(now, both)
                    both = None
                now = part // FAN
                if both is None:
                    both = s
                else:
                    both.merge(s)
        if both is not None:
            yield _row(now, both)

    spectra = materialize(fit.select("x").mapInArrow(follow, _SPECTRUM), "spectra")
    while spectra.count() > 1:
        grouped = spectra.repartition(F.floor(F.col("part") / FAN)).sortWithinPartitions("part")
        spectra = materialize(grouped.mapInArrow(combine, _SPECTRUM), "spectra")
    found = np.array(spectra.select("vecs").first().vecs).reshape(dims, dims)
    return np.linalg.qr(found)[0]


def _products(fit: DataFrame, dims: int, centre: Centre, turn: np.ndarray) -> np.ndarray:
    """Mean of y y' over the fit list, y = turn' (x - S/n): one row a matrix row and task."""
    wide = turn.shape[1]

    def sums(batches):
        total, any_ = np.zeros((wide, wide)), False
        for x in _blocks(batches, dims):
            y = centre.away(x) @ turn
            total += y.T @ y
            any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(wide), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"]
            )

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide)
        for batch in batches:
            total += batch.column("row").flatten().to_numpy().reshape(-1, wide).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["i", "row"]
        )

    partial = fit.select("x").mapInArrow(sums, "i int, row array<double>")
    rows = partial.groupBy("i").applyInArrow(add, "i int, row array<double>").collect()
    out = np.array([r.row for r in sorted(rows, key=lambda r: r.i)]) / centre.n
    return (out + out.T) / 2


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`key`, component, n, deviation, whitened, explained, identity_error of every row with a
    usable vector, one row for each of the first `components` components.

    Null vectors and those with null or non-finite entries are left out; empty vectors have no
    components. Vectors of each length are whitened on their own (their lengths are listed on
    the driver). Repeated rows count once for the fit and are all returned, null keys too; other columns are
    not read. Components without variance (a single distinct vector, fewer vectors than
    dimensions) cannot be scaled to one and are not returned. Eigenvalues that tie have any
    orthonormal directions, the same for all rows. A deviation beyond a long is null. Entries
    beyond 2**62 / 64 count as that. An empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("_key"), v.alias("v")).where(valid(F.col("v")) & (F.size("v") > 0))
    rows = rows.select("_key", quantised(F.col("v")).alias("x"))
    every = materialize(rows.select("x").distinct(), "fit")
    out = None
    for (dims,) in every.select(F.size("x").alias("d")).distinct().orderBy("d").collect():
        part = _whiten(rows.where(F.size("x") == dims), every.where(F.size("x") == dims), dims, components, kind)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = df.sparkSession.createDataFrame([], f"_key {kind}, {_OUT}")
    return out.withColumnRenamed("_key", key)


def _whiten(rows: DataFrame, fit: DataFrame, dims: int, components: int, kind: str) -> DataFrame:
    n, sums = _moments(fit, dims)
    centre = Centre(n, sums)
    basis = _basis(fit, dims, centre)
    inside = _products(fit, dims, centre, basis)
    trace = float(np.trace(inside))
    values, turn = np.linalg.eigh(inside)
    first = np.argsort(-values, kind="stable")[:components]
    first = first[values[first] > LEAST * trace]
    vectors, values = basis @ turn[:, first], values[first]
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    scaled, k = vectors / np.sqrt(values), len(values)
    error = float(np.abs(_products(fit, dims, centre, scaled) - np.eye(k)).max()) if k else 0.0
    explained = (values / trace).tolist()

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, 1024):
                part = batch.slice(at, 1024)
                m = part.num_rows
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(m, dims)
                ids = part.column("_key").take(pa.array(np.repeat(np.arange(m), k)))
                far = pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                y = centre.away(x) @ scaled
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), m)),
                     pa.array(np.full(m * k, n, dtype="int64")), far, pa.array(y.ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["_key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, f"_key {kind}, {_OUT}")
