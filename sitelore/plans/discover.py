"""Pages worth fetching: links and sitemap URLs of a site to one selection that robots allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.functions import urls
from sitelore.operators import crawl


def site_root(url: Column) -> Column:
    """Root page of a URL's site, by its canonical domain."""
    return F.concat(F.lit("https://"), urls.canonical_domain(urls.netloc_of(url)))


def discover(
    anchors: DataFrame, sitemap_urls: DataFrame, rules: DataFrame, max_pages: int, include_homepage: bool = False
) -> DataFrame:
    """base_url, rank, url, score, depth: the best `max_pages` URLs of every site, without
    those that its robots file closes (which are not replaced by others).

    `anchors`: base_url, url, anchor_text, page_ord, pos. `sitemap_urls`: base_url, url.
    `rules`: base_url (root page), disallowed. Anchors come before sitemap URLs.
    """
    linked = anchors.select(
        "base_url", "url", "anchor_text",
        F.struct(F.lit(0).alias("from"), F.col("page_ord").cast("bigint").alias("page"), F.col("pos").cast("bigint").alias("at")).alias("pos"),
    )
    listed = sitemap_urls.select(
        "base_url", "url", F.lit("").alias("anchor_text"),
        F.struct(F.lit(1).alias("from"), F.lit(0).cast("bigint").alias("page"), F.lit(0).cast("bigint").alias("at")).alias("pos"),
    )
    picked = crawl.select_candidates(linked.unionByName(listed), max_pages, include_homepage)
    keyed = picked.withColumn("_root", site_root(F.col("base_url")))
    closed = rules.select(F.col("base_url").alias("_root"), "disallowed")
    return crawl.allowed_by_robots(keyed, closed, "url", "_root").drop("_root")
