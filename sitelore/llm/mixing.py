"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. A
small network carries words from patterns to the quotas of their sources: the r-th pass
over a pattern's words costs more than the one before (convex costs), so nothing is
repeated while unused words of a source remain, and repeats spread evenly. The flow of
each pattern is then filled with whole documents: full passes for all, and a seeded
choice for the rest.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelore.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
HASH_BUCKETS = 1024  # slices of one pattern's documents, each ordered by its own task
BROADCAST_PATTERNS = 10_000  # plan rows sent to all tasks at most


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quota_targets(
    sizes: dict[str | None, int], weights: dict[str | None, float], most: float = 3.0
) -> dict[str | None, float]:
    """Share of all words per source by weight, none above `most` times its size; what is
    above goes to the other sources by weight until none is above."""
    left, open_ = float(sum(sizes.values())), set(sizes)
    targets: dict[str | None, float] = {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if total <= 0 or left * weights[s] / total > most * sizes[s]}
        if not full:
            return targets | {s: left * weights[s] / total for s in open_}
        for s in full:
            targets[s] = most * sizes[s]
            left -= targets[s]
        left = max(left, 0.0)
        open_ -= full
    return targets


def cyclic_weights(sources, cycle=(5.0, 2.0, 1.0)) -> dict[str | None, float]:
    """Weights by code point order of the names (null last), repeating `cycle`."""
    ordered = sorted(sources, key=lambda s: (s is None, [] if s is None else [ord(c) for c in s]))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def min_cost_flow(
    supply: dict[str, int], members: dict[str, list], quota: dict, costs: list[int]
) -> dict[tuple[str, object], int]:
    """Words from each pattern to each of its sources: as many as quotas allow, at least cost.

    Pass r over a pattern offers its `supply` once more at `costs[r]` a word (increasing).
    Successive cheapest paths with node potentials; the network has one node per pattern
    and per source, however many documents there are.
    """
    names = ["in", *(("p", p) for p in supply), *(("s", s) for s in quota), "out"]
    index = {n: i for i, n in enumerate(names)}
    graph: list[list[int]] = [[] for _ in names]
    to, room, price = [], [], []

    def arc(a, b, capacity, cost):
        for x, y, c, d in ((a, b, capacity, cost), (b, a, 0, -cost)):
            graph[index[x]].append(len(to))
            to.append(index[y]), room.append(c), price.append(d)

    for p, words in supply.items():
        for cost in costs:
            arc("in", ("p", p), words, cost)
    routes = {}
    for p in supply:
        for s in members[p]:
            routes[p, s] = len(to)
            arc(("p", p), ("s", s), supply[p] * len(costs), 0)
    for s, words in quota.items():
        arc(("s", s), "out", words, 0)

    potential = [0] * len(names)
    while True:
        best, via = {0: 0}, {}
        heap = [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for e in graph[u]:
                if room[e] > 0:
                    v, nd = to[e], d + price[e] + potential[u] - potential[to[e]]
                    if nd < best.get(v, nd + 1):
                        best[v], via[v] = nd, e
                        heapq.heappush(heap, (nd, v))
        end = len(names) - 1
        if end not in best:
            break
        for u in range(len(names)):
            potential[u] += best.get(u, best[end])
        path, v = [], end
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {k: room[e ^ 1] for k, e in routes.items() if room[e ^ 1] > 0}


def _prefix(rows: DataFrame, out: str) -> DataFrame:
    """Running sum of `size` before each row, per pattern, in seeded order."""
    totals = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("_t"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("pattern", "bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"))
    inside = (
        Window.partitionBy("pattern", "bucket")
        .orderBy("draw", "doc_id", "size", "uid")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_i", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["pattern", "bucket"])
        .withColumn(out, F.col("_s") + F.col("_i"))
        .drop("_s", "_i")
    )


def mix_sources(
    docs: DataFrame,
    sources: Column,
    weights=cyclic_weights,
    most: int = 3,
    seed: int = 11,
    tolerance: float = 0.002,
) -> DataFrame:
    """doc_id, uid, text_hash, size, sources, source_sizes, targets, repeats, pieces per row of `docs`
    (`doc_id`, `text`); sizes and targets belong to the sources in their order.

    `sources`: array of the sources a document belongs to; a null or empty array counts as
    the null source, a null element likewise. `weights`: function from the source names to
    their weights. `repeats` (0 to `most`) is how often the mix takes the document. `pieces`
    is a list of (source, first word, end word) of the pattern's flow, the same for all
    documents of a pattern, that says which quota a pass serves.

    The documents of a pattern's last, partial pass are taken in seeded order while they
    fit; documents that are too long for what is left are skipped and the rest is filled
    again, until less than `tolerance` of the pattern's flow is missing or nothing fits.
    Texts without words have size 0, fit nothing and are never taken. Null `doc_id`s and
    repeated rows are documents like any other; texts of any length are counted whole; other
    columns are not read. An empty table gives no rows.
    """
    rows = _rows(docs, sources, seed)
    state, plans = _choose(rows, weights, most, tolerance)
    repeats = F.when(F.col("size") > 0, F.col("passes") + F.col("extra").cast("int")).otherwise(0)
    return state.join(plans, "pattern").select(
        "doc_id", "uid", "text_hash", "size", "sources", "source_sizes", "targets",
        repeats.cast("int").alias("repeats"), "pieces",
    )


def _source_set(sources: Column) -> Column:
    """Sorted distinct sources; the null source alone where there are none."""
    names = F.coalesce(sources.cast("array<string>"), F.array().cast("array<string>"))
    distinct = F.sort_array(F.array_distinct(names))
    return F.when(F.size(distinct) == 0, F.array(F.lit(None).cast("string"))).otherwise(distinct)


def _rows(docs: DataFrame, sources: Column, seed: int) -> DataFrame:
    """The narrow table of documents that the choice is made on."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        word_count(F.col("text").cast("string")).alias("size"),
        F.to_json(_source_set(sources)).alias("pattern"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.monotonically_increasing_id().alias("uid"),
    )
    draw = F.xxhash64(F.lit(seed), "doc_id", "text_hash", "pattern")
    rows = rows.withColumn("draw", draw).withColumn("bucket", F.pmod("draw", F.lit(HASH_BUCKETS)).cast("int"))
    return materialize(rows, "mix-rows")


def _counted(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows that the driver holds, one per pattern: broadcast while they are few, so that the documents
    of a hot source stay where they are; beyond that an ordinary join, which Spark splits by skew."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= BROADCAST_PATTERNS else made


def _choose(rows: DataFrame, weights, most: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The rows with `extra` (taken in the last, partial pass) and one plan per pattern."""
    spark = rows.sparkSession
    # one row per pattern; documents stay where they are
    supply = {r["pattern"]: r["words"] for r in rows.groupBy("pattern").agg(F.sum("size").alias("words")).collect()}
    members = {p: json.loads(p) for p in supply}
    sizes: dict[str | None, int] = {}
    for p, words in supply.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + words
    targets = quota_targets(sizes, weights(list(sizes)), float(most))
    quota = {s: round(t) for s, t in targets.items()}
    flow = min_cost_flow(supply, members, quota, [(r + 1) ** 2 for r in range(most)])

    plan = []
    for p, words in supply.items():
        parts, at = [], 0
        for s in members[p]:
            if flow.get((p, s)):
                parts.append((s, at, at + flow[p, s]))
                at += flow[p, s]
        passes, rest = divmod(at, words) if words else (0, 0)
        own = [sizes[s] for s in members[p]], [float(targets[s]) for s in members[p]]
        plan.append((p, members[p], *own, passes, rest, parts))
    schema = (
        "pattern string, sources array<string>, source_sizes array<long>, targets array<double>, passes int, rest long, "
        "pieces array<struct<source string, first long, end long>>"
    )
    plans = _counted(spark, plan, schema)

    state = rows.withColumn("extra", F.lit(False))
    gaps = {p: rest for p, *_, rest, _ in plan}
    floor = {p: tolerance * (passes * supply[p] + rest) for p, *_, passes, rest, _ in plan}
    while gaps := {p: g for p, g in gaps.items() if g > floor[p] and g > 0}:
        gap = _counted(spark, list(gaps.items()), "pattern string, gap long")
        fits = state.join(gap, "pattern").where("not extra and size > 0 and size <= gap")
        chosen = _prefix(fits, "_before").where("_before + size <= gap").select("uid", F.lit(True).alias("_now"))
        state = state.join(chosen, "uid", "left")
        state = materialize(
            state.withColumn("_now", F.coalesce("_now", F.lit(False)))
            .withColumn("extra", F.col("extra") | F.col("_now")), "mix-state",
        )
        added = state.where("_now").groupBy("pattern").agg(F.sum("size").alias("words")).collect()
        state = state.drop("_now")
        # a pattern to which nothing was added holds nothing that fits
        gaps = {r["pattern"]: gaps[r["pattern"]] - r["words"] for r in added}
    return state, plans


def repeat_documents(docs: DataFrame, sources: Column, **options) -> DataFrame:
    """Rows of `docs`, all columns, each as often as `mix_sources` takes it.

    Rows that agree in doc_id, text and sources are interchangeable: together they come as
    often as the mix takes them all.
    """
    takes = mix_sources(docs, sources, **options)
    keys = ["_id", "_hash", "_pattern"]
    marks = takes.groupBy(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
        F.col("text_hash").alias("_hash"), F.to_json("sources").alias("_pattern"),
    ).agg(F.sum("repeats").alias("_takes"), F.count(F.lit(1)).alias("_rows"))
    # a row travels as one struct, whatever its columns are called
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).alias("_id"),
        F.xxhash64(F.col("text").cast("string")).alias("_hash"),
        F.to_json(_source_set(sources)).alias("_pattern"), F.struct("*").alias("_row"),
    )
    chosen = rows.join(marks.where("_takes > 0"), keys)
    same = Window.partitionBy(*keys).orderBy(F.lit(0))
    # equal rows share their takes: as even as whole numbers allow
    single = chosen.where("_rows = 1").withColumn("_mine", F.col("_takes"))
    several = chosen.where("_rows > 1").withColumn("_at", F.row_number().over(same) - 1).withColumn(
        "_mine", F.floor(F.col("_takes") / F.col("_rows")) + (F.col("_at") < F.col("_takes") % F.col("_rows")).cast("int")
    ).drop("_at")
    counted = single.unionByName(several).where("_mine > 0")
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mine").cast("long")))).select("_row.*")
