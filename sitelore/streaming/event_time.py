"""Event-time jobs: repeated log rows taken once, and counts per hour."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sitelore.operators.skew import first_per_key
from sitelore.session import checkpoint_root


def once(rows: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Streaming rows without repeats of `key` that arrive up to `delay` late."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def per_window(rows: DataFrame, keys: list[str], time: str, length: str, metrics: list[Column]) -> DataFrame:
    """starts, `keys` and metrics per window of event time, for a stream with a watermark or a table."""
    at = F.window(time, length)
    return rows.groupBy(at, *keys).agg(*metrics).withColumn("starts", F.col("window.start")).drop("window")


def windowed_counts(
    rows: DataFrame, key: list[str], keys: list[str], time: str, metrics: list[Column],
    length: str = "1 hour", delay: str = "1 hour", folder: str | None = None,
) -> DataFrame:
    """Metrics per window of a stream of `rows`, all that has arrived so far (available now).

    Two queries. The first appends every row once to a log (state: the keys within `delay`); the
    second updates window totals from that log, of which each micro-batch is a folder of
    its own that a repeat overwrites, and the latest total of a window counts. Calling it again with
    the same `folder` (checkpoints, log, totals) goes on where it stopped: windows are updated by
    what has come since. Rows older than the watermark are left out of later batches.
    """
    spark = rows.sparkSession
    root = folder or f"{checkpoint_root(spark)}/events-{uuid.uuid4().hex}"
    log = f"{root}/log"
    writing = once(rows, key, time, delay).writeStream.format("parquet").option("path", log)
    writing.option("checkpointLocation", f"{root}/log-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    arrived = spark.readStream.schema(rows.schema).parquet(log).withWatermark(time, delay)
    totals = per_window(arrived, keys, time, length, metrics)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/totals/batch={number}")

    counting = totals.writeStream.foreachBatch(keep).outputMode("update")
    counting.option("checkpointLocation", f"{root}/totals-state").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*totals.schema.fields, StructField("batch", LongType())])
    found = spark.read.schema(schema).parquet(f"{root}/totals")
    return first_per_key(found, ["starts", *keys], [F.col("batch").desc()]).drop("batch")


def stream_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A parquet table of a folder, `name` a file or a folder of files, as a stream of files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")
