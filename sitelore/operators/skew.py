"""Building blocks that keep every task bounded when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelore.session import materialize

ORDINAL_BLOCK = 1 << 16


def fan_out(sizes: DataFrame, keys: list[str], rows: str, target: int, name: str) -> DataFrame:
    """`keys`, `name`: number of slices so that no slice holds more than about `target` rows."""
    return sizes.select(
        *keys,
        F.greatest(F.lit(1), F.ceil(F.col(rows) / F.lit(target))).cast("int").alias(name),
    )


def slice_of(identity: list[Column], slices: Column) -> Column:
    """Stable slice number of a row: depends on the row's identity only, so retries agree."""
    return F.pmod(F.xxhash64(*identity), slices.cast("bigint")).cast("int")


def sliced_join(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    identity: list[str],
    target: int = 200_000,
    how: str = "inner",
) -> DataFrame:
    """Equi-join (inner, or left to keep every row of `many`) where `many` may have hot keys and `few` has few rows per key.

    Rows of `many` under one key are spread over slices sized from counted rows;
    the matching rows of `few` are copied once per slice. A key that fits stays
    in one slice, so ordinary keys pay nothing.
    """
    plan = fan_out(
        many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, "_rows", target, "_slices"
    )
    own = slice_of([F.col(c) for c in identity], F.coalesce("_slices", F.lit(1)))  # null keys match nothing
    left = many.join(plan, keys, how).withColumn("_slice", own).drop("_slices")
    right = (
        few.join(plan, keys)
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
        .drop("_slices")
    )
    return left.join(right, keys + ["_slice"], how).drop("_slice")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key. Spark keeps one row per key in every map task before the
    shuffle, so a key that repeats without end still sends one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_key(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank"
) -> DataFrame:
    """First `limit` rows of each key with their 1-based rank; also limited before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)


def running_index(
    df: DataFrame,
    group: str,
    major: str,
    order: list[str],
    out: str,
    block: int = ORDINAL_BLOCK,
) -> DataFrame:
    """Dense 0-based position inside `group`, ordered by integer `major`, then `order`.

    A plain window would send a whole group to one task. Rows are range-partitioned and
    sorted over the whole table instead, so every block is a counted run of neighbours,
    however `major` is spaced; only one total per block and group is accumulated. The rows
    are written once because both passes read them: pass narrow rows (keys, not texts).
    """
    by = [group, major, *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(
        df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        .withColumn("_id", F.monotonically_increasing_id()),
        f"index-{out}",
    ).withColumn("_block", F.floor(F.col("_id") / F.lit(block)))
    totals = rows.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.select(
        group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(group, "_block").orderBy("_id")
    return (
        rows.withColumn("_pos", F.row_number().over(inside))
        .join(starts, [group, "_block"])
        .withColumn(out, F.col("_start") + F.col("_pos") - 1)
        .drop("_block", "_pos", "_start", "_id")
    )


def with_context(df: DataFrame, at: str, reach: int, block: int = ORDINAL_BLOCK) -> DataFrame:
    """Rows with dense positions `at` in their group, cut into blocks (`_block`) so that a window of up
    to `reach` rows before a row works inside (group, `_block`): the last rows of a block come once more,
    as context of the next one, without `_own`. Keep the rows with `_own` after the window."""
    own = df.withColumn("_block", F.floor(F.col(at) / F.lit(block))).withColumn("_own", F.lit(True))
    ahead = own.where(F.pmod(F.col(at), F.lit(block)) >= block - reach).withColumn("_block", F.col("_block") + 1)
    return own.unionByName(ahead.withColumn("_own", F.lit(False)))
