"""Incremental forms of jobs the batch plans do in full.

A micro-batch may be run again after a failure, so each one writes to a folder of its own
that a repeat overwrites, and everything else is derived from those folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitelore.operators.embed import Embedder
from sitelore.operators.skew import first_per_key
from sitelore.operators.store import ChunkStore
from sitelore.plans.ingest import index_pages, page_table

FETCHED = "page_id bigint, url string, html string"
SITE_BUCKETS = 256  # folders of a batch, so that a later one reads few of them


def _site_bucket():
    return F.pmod(F.xxhash64("website_id"), F.lit(SITE_BUCKETS)).cast("int")


def index_batch(batch: DataFrame, number: int, pages: str, store: ChunkStore, embedder: Embedder) -> dict:
    """Index one batch of fetched pages.

    Chunk numbers and the removal of repeated texts go over a whole site, so the extracted
    pages are kept under the folder `pages` and every site in the batch is indexed from all its
    pages, of each URL the one that arrived last. Batches together give what one full run gives.
    """
    spark = batch.sparkSession
    arrived = page_table(batch).withColumn("site_bucket", _site_bucket())
    arrived.write.mode("overwrite").partitionBy("site_bucket").parquet(f"{pages}/batch={number}")
    kept = spark.read.parquet(pages)
    mine = kept.where(F.col("batch") == number).select("website_id", "site_bucket").distinct()
    buckets = [r.site_bucket for r in mine.select("site_bucket").distinct().collect()]  # at most SITE_BUCKETS
    touched = kept.where(F.col("site_bucket").isin(buckets) & (F.col("batch") <= number))
    touched = touched.join(mine.select("website_id"), "website_id", "left_semi")
    latest = first_per_key(
        touched, ["website_id", "page_url"], [F.col("batch").desc(), F.col("page_ord")]
    )
    return index_pages(latest.drop("batch", "site_bucket"), store, embedder, reindex=True)


def index_arriving_pages(
    spark: SparkSession, folder: str, store: ChunkStore, embedder: Embedder, checkpoint: str, pages: str
) -> StreamingQuery:
    """Index page files as they arrive; `pages` is the folder of the extracted pages so far."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        summary = index_batch(batch, number, pages, store, embedder)
        if summary["errors"]:
            # fail the batch so that the stream repeats it
            raise RuntimeError("; ".join(summary["errors"]))

    arriving = spark.readStream.schema(FETCHED).parquet(folder)
    return (
        arriving.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def log_batch(rows: DataFrame, number: int, target: str) -> None:
    """Write the log rows of one batch; a repeated batch replaces its own rows."""
    rows.write.mode("overwrite").json(f"{target}/batch={number}")


def append_arriving_json(
    spark: SparkSession, folder: str, schema: str, shape, target: str, checkpoint: str
) -> StreamingQuery:
    """Append log rows for arriving JSON files; `shape` is `chat_log` or `job_log`."""
    rows = spark.readStream.schema(schema).json(folder)
    return (
        rows.writeStream.foreachBatch(lambda batch, number: log_batch(shape(batch), number, target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
