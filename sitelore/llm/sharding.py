"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to `BITS` bits. Rows are put in the order of their cell's
index on the Hilbert curve and the order is cut into runs of near equal bytes. Rows of a
run are close in every dimension, so the value ranges of a file are narrow in all of
them and a reader can skip most files for a filter on any. Only SQL functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.llm.files import crc32_of
from sitelore.llm.positions import number_rows
from sitelore.session import materialize

BITS = 4
ROW_BYTES = 16  # a row costs this much besides its text


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell with integer coordinates below 2^bits.

    The published transposition of coordinates (exchange or invert the low bits from the
    highest bit down, then Gray-code) as a fold over a small array.
    """
    n = len(axes)
    steps = F.array(
        *(
            F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i"))
            for b in range(bits - 1, 0, -1)
            for i in range(n)
        )
    )

    def turn(x: Column, step: Column) -> Column:
        low = step["q"] - 1
        mine = F.get(x, step["i"])
        swap = F.get(x, F.lit(0)).bitwiseXOR(mine).bitwiseAND(low)
        flip = mine.bitwiseAND(step["q"]) != 0
        first = F.when(flip, low).otherwise(swap)
        other = F.when(flip, F.lit(0)).otherwise(swap)
        return F.transform(
            x,
            lambda v, j: v.bitwiseXOR(F.when(j == 0, first).otherwise(F.lit(0))).bitwiseXOR(
                F.when(j == step["i"], other).otherwise(F.lit(0))
            ),
        )

    turned = F.aggregate(steps, F.array(*(a.cast("int") for a in axes)), turn)

    def gray(acc: Column, v: Column) -> Column:
        last = F.coalesce(F.element_at(acc, -1), F.lit(0))
        return F.concat(acc, F.array(v.bitwiseXOR(last)))

    coded = F.aggregate(turned, F.array().cast("array<int>"), lambda acc, v: F.when(
        F.size(acc) == 0, F.array(v)).otherwise(gray(acc, v)))

    def index(x: Column) -> Column:
        last = F.element_at(x, -1)
        mask = reduce(
            lambda m, b: m.bitwiseXOR(
                F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0))
            ),
            range(bits - 1, 0, -1), F.lit(0),
        )
        places = F.array(
            *(
                F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i"))
                for b in range(bits - 1, -1, -1)
                for i in range(n)
            )
        )
        return F.aggregate(
            F.transform(places, lambda p: F.get(x, p["i"]).bitwiseXOR(mask).bitwiseAND(p["q"]) != 0),
            F.lit(0).cast("long"),
            lambda h, one: h * 2 + one.cast("long"),
        )

    return F.get(F.transform(F.array(coded), index), F.lit(0))


def value_cells(df: DataFrame, column: str, out: str, bits: int = BITS) -> DataFrame:
    """Add `out`: cell of a discrete column in value order (null first) with about equal
    rows per cell; all rows of a value share one cell."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    placed = number_rows(materialize(counts, "values"), [F.col(column).asc_nulls_first()], "_p", "_rows")
    cell = F.floor((F.col("_rows_before") + F.col("_rows") / 2) * (1 << bits) / F.lit(df.count()))
    cells = placed.select(F.col(column).alias("_v"), cell.cast("int").alias(out))
    return df.join(cells, df[column].eqNullSafe(cells["_v"]), "left").drop("_v")


def range_cell(value: Column, low: Column, high: Column, bits: int = BITS) -> Column:
    """Cell of a number on an even grid from `low` to `high`; null gives 0."""
    share = (value - low).cast("double") / (high - low + 1).cast("double")
    return F.coalesce(F.floor(share * (1 << bits)), F.lit(0)).cast("int")


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Cell of a size: its power of two from 16 up, the last cell is open."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(size.cast("double"))) - 4).cast("int")


def hilbert_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, source, lang, size, text_crc32, hilbert, shard, slot per row of `docs`.

    Dimensions: language, source, size and doc_id. Order: curve index, then text checksum
    (so equal texts of one cell are neighbours), then doc_id. A row goes to the shard in
    which the middle of its bytes lies when the whole order is cut into `shards` equal
    lengths: a shard differs from the mean by less than one row. `slot` counts from 0 in
    each shard. Null texts have no bytes, null metadata has cells of its own; rows with
    equal ids are rows like any other (they tie by id, and only rows equal in cell, checksum and id may
    swap places); equal texts are not kept in one shard; other columns are not read; an empty table gives no rows; a row longer than a
    shard leaves neighbours empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.col("lang").cast("string").alias("lang"),
            (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            crc32_of(text).alias("text_crc32"),
        ),
        "shard-rows",
    )
    low, high, total = narrow.agg(F.min("doc_id"), F.max("doc_id"), F.sum("size")).first()
    cells = value_cells(value_cells(narrow, "lang", "lang_cell"), "source", "source_cell")
    indexed = cells.withColumn("size_cell", size_cell(F.col("size"))).withColumn(
        "id_cell", range_cell(F.col("doc_id"), F.lit(low).cast("long"), F.lit(high).cast("long"))
    )
    indexed = indexed.withColumn(
        "hilbert", hilbert_index([F.col(c) for c in ("lang_cell", "source_cell", "size_cell", "id_cell")])
    ).select("doc_id", "source", "lang", "size", "text_crc32", "hilbert")
    order = [F.col(c).asc_nulls_first() for c in ("hilbert", "text_crc32", "doc_id")]
    placed = number_rows(materialize(indexed, "shard-cells"), order, "position", "size")
    # exact in integers: floor((2 before + size) * shards / (2 total))
    middle = (F.col("size_before") * 2 + F.col("size")).cast("decimal(20,0)") * F.lit(shards)
    cut = placed.withColumn("shard", F.floor(middle / F.lit(2 * (total or 1)).cast("decimal(20,0)")).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("position").alias("_first"))
    return cut.join(firsts, "shard").select(
        "doc_id", "source", "lang", "size", "text_crc32", "hilbert", "shard",
        (F.col("position") - F.col("_first")).alias("slot"),
    )


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """Per shard the value ranges that a reader prunes files by."""
    ranges = [f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size", "doc_id") for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"), *ranges)
