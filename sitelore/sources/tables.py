"""Input tables and the site identity given to rows that have no crawl URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.functions import urls


KEYS = {
    "documents": ["doc_id"],
    "pages": ["page_id"],
    "embeddings": ["vec_id"],
    "conversations": ["conv_id", "turn"],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a table that is too small to split into as many scan tasks.

    Judged by the size of the table's files, as Spark judges what to broadcast: from one full scan
    split per core on, rows stay where they are read. Hash partitioning on the row's key keeps
    retries deterministic.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if size >= cores * split else df.repartition(cores, *keys)


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are expensive to process (whole texts, HTML, vectors)."""
    return spread(table(spark, folder, name), *KEYS[name])


def source_site(source: Column) -> Column:
    """Site URL of a document source."""
    return F.concat(F.lit("https://"), source, F.lit(".example"))


def documents_as_pages(documents: DataFrame) -> DataFrame:
    """Plain documents as page rows: one site per source, one page per document."""
    site = source_site(F.col("source"))
    return documents.select(
        urls.website_id(site).alias("website_id"),
        site.alias("website_url"),
        site.alias("normalized_website_url"),
        F.lit("high").alias("source_reliability"),
        F.col("doc_id").alias("page_ord"),
        F.concat(site, F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id")).alias("page_url"),
        F.concat(site, F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id")).alias("normalized_page_url"),
        F.lit("other").alias("page_type"),
        F.concat_ws(" ", F.lit("Document"), F.col("doc_id"), F.lit("from"), F.col("source")).alias("title"),
        F.lit("static").alias("extraction_method"),
        F.array(F.col("text")).alias("paragraphs"),
    )
