"""Sitemap files: parsing and the walk through sitemap indexes as a frontier of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore import fixed
from sitelore.functions import urls
from sitelore.operators.skew import first_per_key, top_per_key
from sitelore.session import materialize

_ENTRIES = "array<struct<loc:array<string>>>"
_FILE = f"url {_ENTRIES}, sitemap {_ENTRIES}, _broken string"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreNamespace": "true"}


def _locations(entries: Column) -> Column:
    """First location with a text of each entry, in file order; entries without one are left out."""
    texts = F.transform(
        entries,
        lambda e: F.trim(F.get(F.filter(F.coalesce(e["loc"], F.array()), lambda x: F.length(x) > 0), F.lit(0))),
    )
    return F.coalesce(F.filter(texts, lambda t: F.length(t) > 0), F.array().cast("array<string>"))


def parse_sitemap(xml: Column) -> Column:
    """struct<urls, sitemaps> of a sitemap or sitemap index text, whatever its namespace; a text
    that is not XML, an empty one and a null have neither."""
    read = F.from_xml(F.trim(xml), _FILE, _OPTIONS)
    whole = F.when(read["_broken"].isNull(), read)
    return F.struct(_locations(whole["url"]).alias("urls"), _locations(whole["sitemap"]).alias("sitemaps"))


def parsed_files(files: DataFrame) -> DataFrame:
    """url (normalised, unique), urls, sitemaps of fetched files (url, xml)."""
    rows = files.select(urls.crawl_url(F.col("url")).alias("url"), F.col("xml").cast("string").alias("xml"))
    once = rows.where("url <> ''").groupBy("url").agg(F.min(F.coalesce("xml", F.lit(""))).alias("xml"))
    found = once.select("url", parse_sitemap(F.col("xml")).alias("_f"))
    return found.select("url", "_f.urls", "_f.sitemaps")


def walk_sitemaps(
    sites: DataFrame, files: DataFrame, max_files: int | None = None, max_urls: int | None = None
) -> DataFrame:
    """base_url, url, place: page URLs that a site's sitemaps list, each once; sorting a site's
    rows by `place` gives the order in which a first-in-first-out walk finds them.

    `sites`: base_url, sitemaps (from its robots file), to which the common paths are added.
    `files`: url, xml of the fetched sitemaps; a file that is not among them lists nothing. Nothing is
    cut unless `max_files` (visited per site, missing and broken ones included) or `max_urls`
    is given.

    The frontier is a table of (site, file, path of positions that led there). One round visits a
    whole level for all sites: a join with the files, the nested files that the site has
    not visited, of those met twice the one with the least path. Files are visited once per site,
    so indexes that list each other end; rounds are the depth of nesting.
    """
    parsed = materialize(parsed_files(files), "sitemaps")
    base, none = F.col("base_url"), F.array().cast("array<string>")
    origin = F.concat(urls.scheme_of(base), F.lit("://"), urls.netloc_of(base))
    common = F.array(*[F.concat(origin, F.lit(p)) for p in fixed.COMMON_SITEMAP_PATHS])
    seeds = sites.select("base_url", F.posexplode(F.concat(F.coalesce("sitemaps", none), common)).alias("_i", "_u"))
    key = ["base_url", "url"]

    def met(rows: DataFrame) -> DataFrame:
        """First meeting of each file of a site."""
        return rows.where("url <> ''").groupBy(*key).agg(F.min("path").alias("path"))

    level = met(seeds.select("base_url", urls.crawl_url(F.col("_u")).alias("url"), F.array(F.col("_i").cast("long")).alias("path")))
    visited: DataFrame | None = None
    while True:
        fresh = level if visited is None else level.join(visited.select(*key), key, "left_anti")
        if max_files is not None:  # the walk's first files of a level are all that can count
            fresh = top_per_key(fresh, ["base_url"], [F.col("path")], max_files, "_n").drop("_n")
        fresh = materialize(fresh, "frontier")
        if fresh.isEmpty():
            break
        visited = fresh if visited is None else visited.unionByName(fresh)
        nested = fresh.join(parsed.select("url", "sitemaps"), "url").select(
            "base_url", "path", F.posexplode("sitemaps").alias("_i", "_u")
        )
        level = met(
            nested.select(
                "base_url", urls.crawl_url(F.col("_u")).alias("url"), F.array_append("path", F.col("_i").cast("long")).alias("path")
            )
        )
    if visited is None:
        visited = level
    order = F.struct(F.size("path").alias("level"), F.col("path").alias("path"))
    if max_files is not None:
        visited = top_per_key(visited, ["base_url"], [order], max_files, "_n").drop("_n")
    listed = visited.join(parsed.select("url", "urls"), "url").select(
        "base_url", order.alias("file"), F.posexplode("urls").alias("_i", "_u")
    )
    rows = listed.select(
        "base_url", urls.crawl_url(F.col("_u")).alias("url"), F.struct("file.level", "file.path", F.col("_i").alias("at")).alias("place")
    ).where("url <> ''")
    found = first_per_key(rows, key, [F.col("place")])
    if max_urls is not None:
        found = top_per_key(found, ["base_url"], [F.col("place")], max_urls, "_n").drop("_n")
    return found.select("base_url", "url", "place")
