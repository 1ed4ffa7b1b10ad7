"""Fetched pages to an indexed chunk store."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore import fixed
from sitelore.functions import urls
from sitelore.operators import chunks as chunking
from sitelore.operators import crawl, rank
from sitelore.operators.embed import Embedder, embed
from sitelore.operators.extract import extract_pages
from sitelore.operators.store import ChunkStore
from sitelore.session import materialize, scratch


def crawl_pages(fetched: DataFrame) -> DataFrame:
    """Fetched pages (page_id, url, html) -> input of extraction.

    The site of a page is its host; the page's type comes from its normalised URL.
    """
    typed = crawl.classify_pages(fetched)
    site = F.concat(F.lit("https://"), urls.strip_default_port(urls.netloc_of(F.col("normalized_url"))))
    return typed.withColumn("website_url", site).select(
        urls.website_id(F.col("website_url")).alias("website_id"),
        "website_url",
        F.col("website_url").alias("normalized_website_url"),
        F.lit("high").alias("source_reliability"),
        F.col("page_id").alias("page_ord"),
        F.col("normalized_url").alias("page_url"),
        "page_type",
        "html",
    )


def page_table(fetched: DataFrame) -> DataFrame:
    return extract_pages(crawl_pages(fetched))


def searchable_chunks(pages: DataFrame, embedder: Embedder, indexed: bool = False) -> DataFrame:
    """Chunks with vectors and rank features, ready for retrieval."""
    built = chunking.build_indexed_chunks(pages) if indexed else chunking.build_chunks(pages)
    return rank.add_features(embed(built, "text", embedder))


def index_pages(pages: DataFrame, store: ChunkStore, embedder: Embedder, reindex: bool = True) -> dict:
    """Build, embed and store the chunks of all sites in `pages`; returns a summary.

    With `reindex`, stored chunks of these sites are dropped in the same version. The chunks are
    written once and counted as they are written. Failures of Spark and of storage are
    reported in the summary and logged, not raised: indexing must not fail the crawl job.
    The intermediate tables are gone when it returns.
    """
    with scratch(pages.sparkSession):
        return _index_pages(pages, store, embedder, reindex)


def _index_pages(pages: DataFrame, store: ChunkStore, embedder: Embedder, reindex: bool) -> dict:
    summary = {"chunks_built": 0, "chunks_indexed": 0, "chunks_deleted": 0, "by_type": {}, "errors": []}
    try:
        # chunking reads the pages several times: extract them once
        rows = searchable_chunks(materialize(chunking.chunk_input(pages), "pages"), embedder, indexed=True)
        types = {f"of_{t}": F.count_if(F.col("chunk_type") == t) for t in fixed.CHUNK_TYPES}
        done = store.upsert(rows, replace_sites=reindex, metrics=types)
        by_type = {t: done[f"of_{t}"] for t in sorted(fixed.CHUNK_TYPES) if done[f"of_{t}"]}
        summary |= {
            "by_type": by_type, "chunks_built": done["upserted"], "chunks_indexed": done["upserted"],
            "chunks_deleted": done["deleted"],
        }
    except (PySparkException, Py4JJavaError, OSError) as exc:  # reported to the caller
        logging.getLogger(__name__).exception("indexing failed")
        summary["errors"].append(str(exc))
    return summary
