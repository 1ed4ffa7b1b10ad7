"""Near-duplicate embeddings by hashing to the E8 lattice.

Each table projects unit vectors at random to eight dimensions and decodes the point to
the nearest point of the E8 lattice, the vector's cell. Close vectors share a cell or lie
in neighbouring ones, so a vector also probes the cells its point leans to. Vectors that
meet are compared exactly, as blocks of bounded size inside a task: only the number of
links per vector and a spanning forest of each block leave it, never the pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.llm.components import connected_components
from sitelore.llm.files import parallelism
from sitelore.llm.runs import matrix, runs
from sitelore.llm.vectors import unit, usable
from sitelore.session import materialize

TABLES = 6
PROBES = 4
WIDTH = 2.0  # edge of the lattice in units of a projected unit vector's deviation
BLOCK = 1500
SEED = 8


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to the neighbouring points."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    halves = itertools.product((0.5, -0.5), repeat=8)
    out += [np.array(s) for s in halves if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 (the points of D8 and of D8 shifted by one half) to each row."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def _names(points: np.ndarray) -> np.ndarray:
    """A 64-bit name of each lattice point (last axis): its doubled coordinates, mixed."""
    name = np.zeros(points.shape[:-1], dtype="uint64")
    for k in range(8):
        part = (2 * points[..., k]).astype("int64").astype("uint64")
        name = (name ^ part) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name.view("int64")


def cells(units: np.ndarray, tables: int, probes: int, width: float, seed: int) -> np.ndarray:
    """Cell names, shape (rows, tables, 1 + probes): own cell, then the probed ones."""
    n, dims = units.shape
    roots = _roots()
    out = np.empty((n, tables, 1 + probes), dtype="int64")
    for t in range(tables):
        plane = np.random.default_rng([seed, t, dims]).normal(size=(dims, 8)) / width
        x = units @ plane
        own = nearest_e8(x)
        out[:, t, 0] = _names(own)
        if probes:
            lean = (x - own) @ roots.T
            best = np.argsort(-lean, axis=1, kind="stable")[:, :probes]
            out[:, t, 1:] = _names(own[:, None, :] + roots[best])
    return out


def _first_meeting(a: np.ndarray, b: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Which pairs of rows of `a` and `b` (their `cells`) meet first in this table and cell."""

    def meets(t):
        own_a, own_b = a[:, None, t, 0], b[None, :, t, 0]
        at_a = (own_a == own_b) | (own_a[:, :, None] == b[None, :, t, 1:]).any(axis=2)
        at_b = (own_a == own_b) | (own_b[:, :, None] == a[:, None, t, 1:]).any(axis=2)
        return own_a, own_b, at_a, at_b

    own_a, own_b, at_a, at_b = meets(table)
    where = np.where(at_a & at_b, np.minimum(own_a, own_b), np.where(at_a, own_a, own_b))
    first = (at_a | at_b) & (where == cell)
    for t in range(table):
        if not first.any():
            break
        _, _, at_a, at_b = meets(t)
        first &= ~(at_a | at_b)
    return first


def _forest(linked: np.ndarray) -> np.ndarray:
    """Least index reachable by each node of a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        around = np.where(linked, label[None, :], n).min(axis=1)
        new = np.minimum(label, around)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(
    rows: DataFrame,
    threshold: float = 0.93,
    tables: int = TABLES,
    probes: int = PROBES,
    width: float = WIDTH,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of `rows` (`vec_id`, `embedding`, `label`).

    Vectors of one label (not null) with cosine of at least `threshold`, in double
    precision, are linked if they meet in a cell of any table. Equal vectors always are:
    they stand as one vector with a count. Vectors that are null, empty, zero or hold null or
    non-finite components, and those without a label, link with nothing. Vectors of
    different lengths never link. `vec_id` must be unique and not null for a meaningful
    result; repeated ids count as one node of the components. Other columns are not read, whatever
    their names. An empty table gives no rows.

    A cell of many vectors is cut into blocks by hash, and each pair of blocks is a task's
    bounded work.
    """
    narrow = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    )
    # single precision travels as such; it is compared in double
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"
    fit = F.col("label").isNotNull() & usable(F.col("embedding"))
    classes = materialize(
        narrow.where(fit).groupBy("label", "embedding").agg(
            F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")
        ),
        "vector-classes",
    )

    def place(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = np.array([len(v) for v in table["embedding"]])
            for dims in np.unique(sizes):
                part = table.filter(pa.array(sizes == dims))
                named = cells(unit(matrix(part["embedding"])), tables, probes, width, seed)
                for t in range(tables):
                    for p in range(1 + probes):
                        yield pa.RecordBatch.from_arrays(
                            [
                                part["place"].combine_chunks(), pa.array(np.full(len(part), dims, "int32")),
                                pa.array(np.full(len(part), t, "int32")), pa.array(named[:, t, p]),
                                pa.array(np.full(len(part), p == 0)), part["rep"].combine_chunks(),
                            ],
                            [*key, "own", "rep"],
                        )

    # only numbers travel to the cells; a vector follows where it has somebody to meet
    key = ["place", "dims", "tab", "cell"]
    named = classes.select(F.xxhash64("label").alias("place"), "rep", "embedding")
    placed = materialize(
        named.mapInArrow(place, "place long, dims int, tab int, cell long, own boolean, rep long"), "cells"
    )
    # cells without an owner or with a single vector compare nothing
    busy = placed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("own").cast("int")).alias("_own")
    )
    busy = busy.where("_own > 0 and _n > 1").select(
        *key, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")
    )
    mine = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("_blocks")).cast("int")
    dealt = (
        placed.join(busy, key)
        .withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("low", F.least("_mine", "_other"))
        .withColumn("high", F.greatest("_mine", "_other"))
        .drop("_other", "_blocks")
    )
    vectors = classes.select("rep", "copies", "label", F.col("embedding").cast(kind).alias("embedding"))
    group = [*key, "low", "high"]
    met = dealt.join(vectors, "rep").repartition(parallelism(rows.sparkSession), *group)
    sorted_ = met.sortWithinPartitions(*group)

    def link(batches):
        for (_, _, tab, cell, low, high), found in runs(batches, group):
            own = found["own"].to_numpy()
            side = found["_mine"].to_numpy()
            x = unit(matrix(found["embedding"]))
            rep, copies = found["rep"].to_numpy(), found["copies"].to_numpy()
            close = x @ x.T >= threshold
            close &= own[:, None] | own[None, :]  # one of them lives here
            label = found["label"].to_numpy()
            close &= label[:, None] == label[None, :]  # `place` is a hash
            if low != high:
                close &= side[:, None] != side[None, :]
            np.fill_diagonal(close, False)
            some = np.flatnonzero(close.any(axis=1))
            if not len(some):
                continue
            close, rep, copies = close[np.ix_(some, some)], rep[some], copies[some]
            named = cells(x[some], tables, probes, width, seed)
            links = np.zeros(len(some), dtype="int64")
            for i in range(0, len(some), 256):  # bounds the temporary matrices
                new = close[i : i + 256] & _first_meeting(named[i : i + 256], named, tab, cell)
                links[i : i + 256] = new @ copies
            root = rep[_forest(close)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep), pa.array(links), pa.array(root)], ["rep", "links", "root"]
            )

    found = materialize(sorted_.mapInArrow(link, "rep long, links long, root long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("rep", "root"))
    known = (
        classes.join(counts, "rep", "left").join(groups, F.col("rep") == F.col("id"), "left")
        .select("label", "embedding", "rep", "copies", "links", "component")
    )
    # rows find their class by the vector itself
    return narrow.join(known, ["label", "embedding"], "left").select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
