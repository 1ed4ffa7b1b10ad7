"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.session import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """u, m: least neighbour of each u, itself included (combined before the shuffle)."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every node that has an edge.

    `edges`: two long columns. Alternates the large-star and small-star steps, which
    rewrite edges towards the least node and never hold a node's neighbours together:
    each step is one minimum per node and one join back, in a job of its own. The joins merge:
    of the many rounds of small tables none passes through the driver. Ends when the edges are stars.
    """
    a, b = edges.columns
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = None
    while True:
        turned = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
        both = now.select(F.inline(F.array(F.struct("u", "v"), turned)))
        # u > v in every row, so the neighbours above a node are those of the turned rows
        above = now.select("v", "u").toDF("u", "v").join(_least(both).hint("merge"), "u")
        large = materialize(above.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        small = large.join(_least(large).hint("merge"), "u")
        rewired, own = F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
        now = materialize(small.select(F.inline(F.array(rewired, own))).where("u <> v").distinct(), "edges")
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
