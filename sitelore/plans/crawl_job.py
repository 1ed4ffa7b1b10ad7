"""From links and sitemaps to an indexed site: discovery, selection, extraction, indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelore.operators.embed import Embedder
from sitelore.operators.extract import extract_pages
from sitelore.operators.store import ChunkStore
from sitelore.plans.discover import discover, site_root
from sitelore.plans.ingest import crawl_pages, index_pages
from sitelore.session import materialize
from sitelore.sources.sitemaps import walk_sitemaps


def link_rows(pages: DataFrame) -> DataFrame:
    """base_url, page_ord, pos, url, anchor_text of every link of extracted pages."""
    found = pages.select("website_url", "page_ord", F.posexplode("anchors").alias("pos", "l"))
    return found.select(
        F.col("website_url").alias("base_url"), "page_ord", "pos", F.col("l.url").alias("url"), F.col("l.text").alias("anchor_text")
    )


def select_pages(crawled: DataFrame, robots: DataFrame, sitemap_files: DataFrame, max_pages: int) -> DataFrame:
    """Of `crawled` (see `crawl_pages`), the pages that their site's links and sitemaps lead to, that
    are among its best `max_pages` and that its robots file allows.

    `robots`: base_url (root page), disallowed, sitemaps. `sitemap_files`: url, xml.
    """
    # only the links of a page are extracted here; columns that nobody reads are not built
    linked = materialize(extract_pages(crawled).select("website_url", "page_ord", "anchors"), "links")
    roots = linked.select(F.col("website_url").alias("base_url")).distinct().withColumn("_root", site_root(F.col("base_url")))
    seeds = roots.join(robots.select(F.col("base_url").alias("_root"), "sitemaps"), "_root", "left").drop("_root")
    listed = walk_sitemaps(seeds, sitemap_files).select("base_url", "url")
    picked = discover(link_rows(linked), listed, robots, max_pages)
    wanted = materialize(picked.select(F.col("base_url").alias("website_url"), F.col("url").alias("page_url")), "picked")
    return crawled.join(wanted, ["website_url", "page_url"], "left_semi")


def crawl_job(
    fetched: DataFrame, robots: DataFrame, sitemap_files: DataFrame, store: ChunkStore, embedder: Embedder, max_pages: int
) -> dict:
    """Select, extract and index in one go; returns the summary of `index_pages`.

    `fetched`: page_id, url, html, whatever a fetcher has brought in. Sites in it are re-indexed from
    the pages selected now.
    """
    crawled = crawl_pages(fetched)
    chosen = select_pages(crawled, robots, sitemap_files, max_pages)
    return index_pages(extract_pages(chosen), store, embedder)
