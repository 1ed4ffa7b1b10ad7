"""Global positions and running totals without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelore.llm.files import parallelism
from sitelore.session import materialize

_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def number_rows(df: DataFrame, order: list[Column], out: str, total: str | None = None) -> DataFrame:
    """Add `out`, the 0-based position in `order` over the whole table, and, with `total`,
    `<total>_before`, the sum of that column over all rows before.

    Rows are range-partitioned and sorted once and written; only one row per partition is
    then accumulated. Rows that tie in `order` get positions in any order, so give a full
    order where it matters. Range bounds are sampled, so pass rows that are cheap to read
    twice (a written table).
    """
    ranged = df.repartitionByRange(parallelism(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()), f"order-{out}")
    rows = rows.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_at", F.col("_mid").bitwiseAND(F.lit(_IN_PARTITION))
    )
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(total).alias("_t")] if total else [])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(*sums)
    starts = starts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
        *([F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_sum")] if total else []),
    )
    if total:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_in", F.coalesce(F.sum(total).over(inside), F.lit(0)))
    joined = rows.join(starts, "_part").withColumn(out, F.col("_first") + F.col("_at"))
    if total:
        joined = joined.withColumn(f"{total}_before", F.col("_sum") + F.col("_in"))
    return joined.drop("_part", "_mid", "_at", "_first", "_sum", "_in")
