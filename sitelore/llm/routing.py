"""Nearest neighbours through learned partitions.

On a bounded sample: build the neighbour graph, cut it into balanced parts so that few
neighbours are separated, and train a small classifier from a vector to the parts of its
neighbours. Every row is indexed in its most probable parts (`homes` of them). A query visits the
most probable parts until their probabilities add up to a share, the least with which a held-out
part of the sample finds the wanted share of its neighbours, and all rows there are ranked by
exact cosine. The number of parts is the root of the sample's size at every size of table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.llm.files import empty_like, parallelism
from sitelore.llm.runs import matrix, runs
from sitelore.llm.vectors import unit, usable
from sitelore.operators.skew import top_per_key
from sitelore.session import materialize

FOUND = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Fit:
    """How the index is learned; all bounds are on the sample, never on what is indexed."""

    sample: int = 8192
    least_sample: int = 40  # below it there is no held-out share to learn from: one part
    neighbours: int = 10
    homes: int = 2
    hidden: int = 96
    steps: int = 400
    held_out: int = 512
    recall: float = 0.93
    seed: int = 5


@dataclass
class Router:
    """Classifier from unit vectors to parts, and the probability that a query's visits add up to."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    share: float = 0.0

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts from the most probable to the least, and the probability of those before each."""
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        order = np.argsort(-z, axis=1, kind="stable")
        p = np.exp(np.take_along_axis(z, order, axis=1) - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return order, np.cumsum(p, axis=1) - p

    def visits(self, before: np.ndarray) -> np.ndarray:
        """How many of its ranked parts each query visits."""
        return np.maximum(1, (before <= self.share).sum(axis=1))


def nearest_rows(x: np.ndarray, of: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Indices of the `k` rows of `x` nearest to each row of `of`; `same`: skip itself."""
    out = np.empty((len(of), k), dtype="int64")
    for i in range(0, len(of), 512):
        s = of[i : i + 512] @ x.T
        if same:
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[i : i + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.05, sweeps: int = 6) -> np.ndarray:
    """Part of each row: equal halves along main directions first, then rows move to the
    part that holds most of their neighbours while no part passes its share by `slack`."""
    part = np.zeros(len(x), dtype="int64")
    shares = [(np.arange(len(x)), 0, parts)]
    while shares:
        rows, first, count = shares.pop()
        if count == 1:
            part[rows] = first
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        _, axes = np.linalg.eigh(centred.T @ centred)
        order = rows[np.argsort(centred @ axes[:, -1], kind="stable")]
        left = count // 2
        cut = len(rows) * left // count
        shares += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    most = int(np.ceil(len(x) / parts * (1 + slack)))
    held = np.bincount(part, minlength=parts)
    # a neighbour counts in both directions
    around: list[list[int]] = [list(g) for g in graph]
    for i, near in enumerate(graph):
        for j in near:
            around[j].append(i)
    for _ in range(sweeps):
        moved = 0
        for i, near in enumerate(around):
            votes = np.bincount(part[near], minlength=parts)
            votes[held >= most] = -1
            votes[part[i]] = np.count_nonzero(part[near] == part[i])
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                held[part[i]] -= 1
                held[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def train_router(x: np.ndarray, wanted: np.ndarray, fit: Fit) -> Router:
    """One hidden layer, trained with Adam on the distribution `wanted` over parts."""
    rng = np.random.default_rng(fit.seed)
    n, dims = x.shape
    parts = wanted.shape[1]
    weights = [
        rng.normal(size=(dims, fit.hidden)) * np.sqrt(2.0), np.zeros(fit.hidden),
        rng.normal(size=(fit.hidden, parts)) / np.sqrt(fit.hidden), np.zeros(parts),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    while step < fit.steps:
        order = rng.permutation(n)
        for i in range(0, n, 128):
            rows = order[i : i + 128]
            h = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - wanted[rows]) / len(rows)
            dh = (dz @ weights[2].T) * (h > 0)
            slopes = [x[rows].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.003 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[k] = weights[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return Router(*weights)


def learn(sample: np.ndarray, top: int, fit: Fit) -> Router:
    """Router from unit vectors of the sample."""
    rng = np.random.default_rng(fit.seed)
    order = rng.permutation(len(sample))
    held = min(fit.held_out, len(sample) // 5)
    test, x = sample[order[:held]], sample[order[held:]]
    if len(sample) < fit.least_sample:
        dims = sample.shape[1]
        return Router(np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    parts = max(2, round(np.sqrt(len(x))))
    graph = nearest_rows(x, x, min(fit.neighbours, len(x) - 1), same=True)
    part = balanced_parts(x, graph, parts)
    wanted = np.eye(parts)[part] + np.eye(parts)[part[graph]].sum(axis=1)
    router = train_router(x, wanted / wanted.sum(axis=1, keepdims=True), fit)
    # the share: what lies before the first home of a true neighbour, where the index will have it
    homes = router.ranked(x)[0][:, : fit.homes]
    truth = homes[nearest_rows(x, test, min(top, len(x)), same=False)]
    ranked, before = router.ranked(test)
    place = np.argsort(ranked, axis=1)
    depth = np.take_along_axis(place, truth.reshape(len(test), -1), axis=1).reshape(truth.shape).min(axis=2)
    needed = np.sort(np.take_along_axis(before, depth, axis=1).ravel())
    router.share = float(needed[min(len(needed) - 1, int(np.ceil(fit.recall * len(needed))) - 1)])
    return router


def search(
    vectors: DataFrame,
    is_query: Column,
    top: int = 5,
    fit: Fit = Fit(),
    slice_rows: int = 8000,
    block_queries: int = 4000,
) -> DataFrame:
    """`FOUND` rows: the `top` nearest rows found for each row where `is_query` holds.

    `vectors`: vec_id, embedding. Nearness is the cosine in double precision; ties go to
    the smaller vec_id. Rows that are null, zero or hold null or non-finite components and
    rows without a vec_id take no part. Vectors of each length have a router of their own and
    meet only each other; ranks are per query_id and length. A row is no candidate of a query
    with its vec_id, and a vec_id that occurs in several rows is one neighbour, by its best row; of
    a query_id that does, too, the best pairs count. Other columns are not read. An empty table
    gives no rows.

    A part that holds many rows is read in slices, and its queries come in blocks: a task
    holds at most `slice_rows` rows and `block_queries` queries on average.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("_query", F.coalesce(is_query, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "_query",
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    routers = routers_of(rows, top, fit)
    if not routers:
        return empty_like(spark, FOUND)

    def route(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2))
            for dims in pc.unique(sizes).to_pylist():
                same = batch.filter(pc.equal(sizes, dims))
                router = routers[dims]
                ranked, before = router.ranked(unit(matrix(pa.chunked_array([same.column(2)]))))
                asks = same.column(1).to_numpy(zero_copy_only=False)
                visits = np.where(asks, np.maximum(router.visits(before), fit.homes), fit.homes)
                parts = pa.array([r[:v].tolist() for r, v in zip(ranked.astype("int32"), visits)], pa.list_(pa.int32()))
                seen = pa.array(router.visits(before).astype("int32"))
                length = pa.array([dims] * same.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*same.columns, length, parts, seen], ["vec_id", "_query", "embedding", "dims", "parts", "visits"]
                )

    routed = materialize(
        rows.mapInArrow(
            route, "vec_id long, _query boolean, embedding array<double>, dims int, parts array<int>, visits int"
        ),
        "routed",
    )
    homes = routed.select("vec_id", "embedding", "dims", F.explode(F.slice("parts", 1, fit.homes)).alias("part"))
    asked = routed.where("_query").select(
        "vec_id", "embedding", "dims", F.explode(F.slice("parts", F.lit(1), F.col("visits"))).alias("part")
    )
    sizes = homes.groupBy("dims", "part").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("slices"))
    blocks = asked.groupBy("dims", "part").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("blocks"))
    grid = sizes.join(blocks, ["dims", "part"])  # one row per part

    def dealt(df, kind, own, others):
        mine = F.pmod(F.xxhash64("vec_id", F.lit(kind)), F.col(own)).cast("int")
        return df.join(grid, ["dims", "part"]).select(
            "dims", "part", mine.alias(own[:-1]), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(others[:-1]),
            F.lit(kind).alias("kind"), "vec_id", "embedding",
        )

    key = ["dims", "part", "slice", "block"]
    both = dealt(homes, 0, "slices", "blocks").select(*key, "kind", "vec_id", "embedding").unionByName(
        dealt(asked, 1, "blocks", "slices").select(*key, "kind", "vec_id", "embedding")
    )
    met = both.repartition(parallelism(spark), *key).sortWithinPartitions(*key, "kind", "vec_id")

    def rank(batches):
        for (dims, *_), found in runs(batches, key):
            kind, ids, x = found["kind"].to_numpy(), found["vec_id"].to_numpy(), matrix(found["embedding"])
            cut = int(np.searchsorted(kind, 1))
            if 0 < cut < len(ids):
                best = [pa.array(c) for c in best_of(ids[:cut], x[:cut], ids[cut:], x[cut:], top)]
                length = pa.array([dims] * len(best[0]), pa.int32())
                yield pa.RecordBatch.from_arrays([length, *best], ["dims", "query_id", "vec_id", "score"])

    found = met.mapInArrow(rank, "dims int, query_id long, vec_id long, score double")
    # a row lives in several parts, and ids may repeat
    near = found.groupBy("dims", "query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = top_per_key(near, ["dims", "query_id"], [F.desc("score"), F.asc("vec_id")], top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def routers_of(rows: DataFrame, top: int, fit: Fit) -> dict[int, Router]:
    """Router of each length of vectors (vec_id, embedding), from a sample of at most `fit.sample` rows."""
    routers: dict[int, Router] = {}
    for (dims,) in rows.select(F.size("embedding").alias("dims")).distinct().collect():  # one row per length
        drawn = (
            rows.where(F.size("embedding") == dims)
            .orderBy(F.xxhash64("vec_id", F.lit(fit.seed)), "vec_id").limit(fit.sample)
            .select("embedding").toArrow()  # bounded by `fit.sample`
        )
        routers[dims] = learn(unit(matrix(drawn["embedding"])), top, fit)
    return routers


def best_of(ids, x, query_ids, queries, top):
    """The `top` best of rows `x` for each query, an id once: query ids, row ids, cosines.

    A first pass by matrix product keeps all rows within rounding of the best ones; their
    cosines are then computed one by one in the same order of operations everywhere, so
    equal vectors tie exactly.
    """
    ux, uq = unit(x), unit(queries)
    norms, query_norms = np.sqrt((x * x).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    often = int(np.unique(ids, return_counts=True)[1].max())  # rows of the most repeated id
    out_q, out_v, out_s = [], [], []
    for i in range(0, len(queries), 256):
        s = uq[i : i + 256] @ ux.T
        s[query_ids[i : i + 256][:, None] == ids[None, :]] = -np.inf
        k = min(top * often, len(ids))
        least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
        rows, cols = np.nonzero((s >= least[:, None] - 1e-9) & (s > -np.inf))
        exact = (queries[i + rows] * x[cols]).sum(axis=1) / (query_norms[i + rows] * norms[cols])
        order = np.lexsort((ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        if often > 1:
            first = np.unique(np.stack([rows, ids[cols]]), axis=1, return_index=True)[1]
            first.sort()
            rows, cols, exact = rows[first], cols[first], exact[first]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < top
        out_q.append(query_ids[i + rows[keep]])
        out_v.append(ids[cols[keep]])
        out_s.append(exact[keep])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)
