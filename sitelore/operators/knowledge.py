"""Site knowledge: document shape, legacy pages, and text contexts built from pages.

Pages stay rows (`knowledge_tables`). A site's pages are only gathered into one document or
text where the caller names a limit that bounds them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelore import fixed
from sitelore.functions import urls
from sitelore.functions.text import contains_any
from sitelore.operators.skew import top_per_key
from sitelore.schemas import LEGACY_PAGE, PAGE, PAGE_COLUMNS, SEARCHES, SECTIONS, with_page_defaults


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _or(c: Column, fallback: Column | str) -> Column:
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(_text(c) != "", c).otherwise(other)


def to_legacy(page: Column) -> Column:
    """Current page struct -> legacy page struct."""
    return F.struct(
        _text(page["title"]).alias("title"),
        _text(page["description"]).alias("description"),
        F.coalesce(page["sections"], F.array().cast(SECTIONS)).alias("sections"),
        _text(page["content"]).alias("content"),
        _text(page["page_url"]).alias("url"),
        _or(page["page_type"], "other").alias("page_type"),
    ).cast(LEGACY_PAGE)


def from_legacy(page: Column) -> Column:
    """Legacy page struct -> current page struct with defaults."""
    given = {
        "page_url": _text(page["url"]),
        "normalized_page_url": urls.cache_url(page["url"]),
        "page_type": _or(page["page_type"], "other"),
        "title": _text(page["title"]),
        "description": _text(page["description"]),
        "extraction_method": F.lit("static"),
        "sections": F.coalesce(page["sections"], F.array().cast(SECTIONS)),
        "content": _text(page["content"]),
        "quality": F.struct(
            F.lit(200).alias("status_code"),
            F.length(_text(page["content"])).alias("content_length"),
            F.lit(0.0).alias("useful_text_score"),
            F.lit(0).alias("image_count"),
            F.lit(0).alias("link_count"),
            F.lit(None).cast("string").alias("scraped_at"),
            F.array().cast("array<string>").alias("errors"),
            F.lit(None).cast("int").alias("render_time_ms"),
            F.lit(None).cast("string").alias("final_url"),
        ),
        "metadata": F.struct(
            F.lit("").alias("canonical"),
            F.create_map().cast("map<string,string>").alias("open_graph"),
            F.create_map().cast("map<string,string>").alias("twitter"),
        ),
    }
    fields = []
    for name, kind in PAGE_COLUMNS.items():
        value = given.get(name, F.array())
        fields.append(value.cast(kind).alias(name))
    return F.struct(*fields).cast(PAGE)


def upgrade_knowledge(docs: DataFrame, fallback_url: str = "") -> DataFrame:
    """Complete a knowledge document of any age; running it twice changes nothing.

    Whichever of the two page lists is missing is rebuilt from the other, and site
    metadata gets its identity.
    """
    meta, primary, secondary = F.col("metadata"), F.col("primary_content"), F.col("secondary_content")
    legacy = F.coalesce(primary["pages"], F.array().cast(f"array<{LEGACY_PAGE}>"))
    current = F.col("pages")
    searches = F.coalesce(secondary["searches"], F.array().cast(SEARCHES))
    df = docs.withColumn(
        "pages",
        F.when(F.size(current) > 0, current).otherwise(F.transform(legacy, from_legacy)),
    ).withColumn("_legacy", legacy)
    df = df.withColumn(
        "primary_content",
        F.struct(
            _or(primary["source"], "website_scraping").alias("source"),
            _or(primary["reliability"], "high").alias("reliability"),
            F.when(F.size("_legacy") > 0, F.col("_legacy"))
            .otherwise(F.transform("pages", to_legacy))
            .alias("pages"),
        ),
    ).withColumn(
        "secondary_content",
        F.struct(
            _or(secondary["source"], "web_search").alias("source"),
            _or(secondary["reliability"], "medium").alias("reliability"),
            searches.alias("searches"),
        ),
    )
    source_url = F.col("source_url") if "source_url" in docs.columns else F.lit("")
    df = df.withColumn("_url", _or(meta["url"], _or(F.lit(fallback_url), _text(source_url))))
    df = df.withColumn("_normalized", _or(meta["normalized_url"], urls.cache_url(F.col("_url"))))
    counted = F.size(F.col("primary_content")["pages"])
    return df.withColumn(
        "metadata",
        F.struct(
            _or(meta["website_id"], urls.website_id(F.col("_normalized"))).alias("website_id"),
            F.col("_url").alias("url"),
            F.col("_normalized").alias("normalized_url"),
            _text(meta["name"]).alias("name"),
            F.coalesce(
                F.nullif(meta["created_at"], F.lit("")),
                F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"),
            ).alias("created_at"),
            _or(meta["scraping_version"], "v2").alias("scraping_version"),
            F.coalesce(F.nullif(meta["pages_scraped"], F.lit(0)), counted).alias("pages_scraped"),
            (
                F.coalesce(meta["has_web_search_supplement"], F.lit(False))
                | (F.size(F.col("secondary_content")["searches"]) > 0)
            ).alias("has_web_search_supplement"),
        ),
    ).drop("_legacy", "_url", "_normalized")


def knowledge_pages(docs: DataFrame) -> DataFrame:
    """Upgraded knowledge documents -> page table with site columns."""
    exploded = docs.select(
        F.col("metadata.website_id").alias("website_id"),
        F.col("metadata.url").alias("website_url"),
        F.col("metadata.normalized_url").alias("normalized_website_url"),
        F.col("primary_content.reliability").alias("source_reliability"),
        F.posexplode("pages").alias("page_ord", "_page"),
    )
    return exploded.withColumn("page_ord", F.col("page_ord").cast("bigint")).select(
        "website_id", "website_url", "normalized_website_url", "source_reliability", "page_ord", "_page.*"
    )


def knowledge_tables(sites: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Site knowledge of any size as two tables: metadata, one row per site, and pages, one row
    per (website_id, page_ord) with the current and the legacy form of the page.

    `sites`: website_id, url, name. Nothing is gathered: a site may hold any number of pages.
    """
    full = with_page_defaults(pages)
    rows = full.select("website_id", "page_ord", F.struct(*PAGE_COLUMNS).cast(PAGE).alias("page"))
    counts = rows.groupBy("website_id").agg(F.count(F.lit(1)).alias("pages_scraped"))
    normalized = urls.cache_url(F.col("url"))
    meta = sites.join(counts, "website_id", "left").select(
        _or(F.col("website_id"), urls.website_id(normalized)).alias("website_id"),
        _text(F.col("url")).alias("url"), normalized.alias("normalized_url"), _text(F.col("name")).alias("name"),
        F.lit("v2").alias("scraping_version"), F.coalesce("pages_scraped", F.lit(0)).alias("pages_scraped"),
    )
    return meta, rows.withColumn("legacy", to_legacy(F.col("page")))


def build_knowledge(
    sites: DataFrame, pages: DataFrame, searches: DataFrame | None = None, *,
    max_pages: int, max_searches: int | None = None, search_chars: int | None = None,
) -> DataFrame:
    """One knowledge document per site row (website_id, url, name), for writing as JSON.

    Pages carry website_id and page_ord. `max_pages` bounds a document, which one task
    holds; `knowledge_tables` has no bound. All searches and their whole texts are kept
    unless the caller says otherwise.
    """
    full = with_page_defaults(pages)
    first = top_per_key(
        full.select("website_id", "page_ord", F.struct(*PAGE_COLUMNS).cast(PAGE).alias("page")),
        ["website_id"], [F.col("page_ord")], max_pages, rank="n",
    )
    gathered = first.groupBy("website_id").agg(
        # maps inside pages cannot be compared, so order the list by `n` alone
        F.array_sort(
            F.collect_list(F.struct("n", "page")), lambda a, b: a["n"] - b["n"]
        ).alias("ps")
    )
    docs = sites.join(gathered, "website_id", "left")
    page_list = F.transform(F.col("ps"), lambda p: p["page"])
    docs = docs.withColumn("pages", F.coalesce(page_list, F.array().cast(f"array<{PAGE}>")))
    if searches is None:
        found = F.array().cast(SEARCHES)
        docs = docs.withColumn("searches", found)
    else:
        kept = searches.withColumn(
            "n", F.row_number().over(Window.partitionBy("website_id").orderBy("index"))
        )
        if max_searches is not None:
            kept = kept.where(F.col("n") <= max_searches)
        result = F.col("result") if search_chars is None else F.substring("result", 1, search_chars)
        listed = kept.groupBy("website_id").agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("n").alias("index"),
                        result.alias("result"),
                    )
                )
            ).alias("searches")
        )
        docs = docs.join(listed, "website_id", "left")
    raw = docs.select(
        F.struct(
            "website_id", "url", F.lit("").alias("normalized_url"), "name",
            F.lit("").alias("created_at"), F.lit("v2").alias("scraping_version"),
            F.size("pages").alias("pages_scraped"), F.lit(False).alias("has_web_search_supplement"),
        ).alias("metadata"),
        F.struct(
            F.lit("").alias("source"), F.lit("").alias("reliability"),
            F.array().cast(f"array<{LEGACY_PAGE}>").alias("pages"),
        ).alias("primary_content"),
        "pages",
        F.struct(F.lit("").alias("source"), F.lit("").alias("reliability"), "searches").alias(
            "secondary_content"
        ),
    )
    return upgrade_knowledge(raw)


# --- contexts ---------------------------------------------------------------
@dataclass(frozen=True)
class TextSizes:
    """How much of each page goes into a text context. None, the default everywhere: all of it."""

    sections: int | None = None  # of a page
    section_chars: int | None = None
    content_chars: int | None = None  # of a page without sections
    home_section_chars: int | None = None
    home_content_chars: int | None = None
    blog_chars: int | None = None  # of a blog page's description
    search_chars: int | None = None  # of a search result


def _start(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def _section_lines(sections: Column, limit: int | None, chars: int | None) -> Column:
    """Heading and content lines of sections, or of the first ones."""
    taken = sections if limit is None else F.slice(sections, 1, limit)
    return F.flatten(
        F.transform(
            taken,
            lambda s: F.array_compact(
                F.array(
                    F.when(_text(s["heading"]) != "", F.concat(F.lit("\n### "), s["heading"])),
                    F.when(_text(s["content"]) != "", _start(s["content"], chars)),
                )
            ),
        )
    )


def _lines(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def _line(prefix: str, c: Column) -> Column:
    return F.when(_text(c) != "", F.concat(F.lit(prefix), c))


def _page_lines(head: Column, sizes: TextSizes) -> Column:
    """Shared page block: head lines, sections, or the content when there are none."""
    no_sections = F.coalesce(F.size("sections"), F.lit(0)) <= 0
    none = F.array().cast("array<string>")
    return F.concat(
        head,
        F.coalesce(_section_lines(F.col("sections"), sizes.sections, sizes.section_chars), none),
        _lines(
            F.when(no_sections & (_text(F.col("content")) != ""), _start(F.col("content"), sizes.content_chars)),
            F.lit(fixed.CONTEXT_RULE),
        ),
    )


def _joined(rows: DataFrame, key: str, order: str, block: Column) -> DataFrame:
    """Blocks of a key joined by newlines in order; rows per key are already limited."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, block.alias("b")))).alias("bs"))
    return packed.select(key, F.array_join(F.transform("bs", lambda x: x["b"]), "\n").alias("text"))


def scraped_context(pages: DataFrame, sites: DataFrame, sizes: TextSizes, *, max_pages: int) -> DataFrame:
    """website_id, context: the first `max_pages` scraped pages of a site as text."""
    first = top_per_key(
        with_page_defaults(pages), ["website_id"], [F.col("page_ord")], max_pages, rank="n"
    )
    head = _lines(
        _line("## ", F.col("title")), _line("URL: ", F.col("page_url")),
        _line("Description: ", F.col("description")),
    )
    block = F.array_join(_page_lines(head, sizes), "\n")
    counted = first.groupBy("website_id").agg(F.count(F.lit(1)).alias("n_pages"))
    joined = _joined(first, "website_id", "n", block).join(counted, "website_id").join(sites, "website_id")
    return joined.select(
        "website_id",
        F.concat_ws(
            "\n",
            F.lit(fixed.CONTEXT_SCRAPED_HEADER),
            F.concat(F.lit("Source: "), "url"),
            F.concat(F.lit("Pages scraped: "), F.col("n_pages").cast("string")),
            F.lit(""),
            "text",
        ).alias("context"),
    )


def page_bucket(page_type: Column, url: Column) -> Column:
    lower = F.lower(_text(url))
    return (
        F.when(page_type == "homepage", "homepage")
        .when(contains_any(lower, fixed.KEY_PAGE_WORDS), "key")
        .when(contains_any(lower, ["blog", "/20"]), "blog")
        .otherwise("key")
    )


def chatbot_context(
    pages: DataFrame, sites: DataFrame, sizes: TextSizes, searches: DataFrame | None = None, *,
    key_pages: int, blog_pages: int, max_searches: int = 0,
) -> DataFrame:
    """website_id, context: homepage in full, then the first key pages, blog pages and search
    results. Of several homepages the last one counts."""
    p = with_page_defaults(pages).withColumn("_bucket", page_bucket(F.col("page_type"), F.col("page_url")))

    def first(bucket: str, order: Column, limit: int) -> DataFrame:
        return top_per_key(p.where(F.col("_bucket") == bucket), ["website_id"], [order], limit, rank="n")

    none = F.array().cast("array<string>")
    home = first("homepage", F.col("page_ord").desc(), 1)
    home_lines = F.concat(
        _lines(
            F.lit(fixed.CONTEXT_HOMEPAGE_HEADER), _line("Title: ", F.col("title")),
            _line("Description: ", F.col("description")),
        ),
        F.coalesce(_section_lines(F.col("sections"), None, sizes.home_section_chars), none),
        _lines(_line("\nMain content: ", _start(F.col("content"), sizes.home_content_chars)), F.lit(fixed.CONTEXT_RULE)),
    )
    key_head = _lines(_line("## ", F.col("title")), _line("Description: ", F.col("description")))
    blog_lines = _lines(_line("- ", F.col("title")), _line("  ", _start(F.col("description"), sizes.blog_chars)))
    parts = {
        "home": _joined(home, "website_id", "n", F.array_join(home_lines, "\n")),
        "key": _joined(
            first("key", F.col("page_ord"), key_pages), "website_id", "n",
            F.array_join(_page_lines(key_head, sizes), "\n"),
        ),
        # pages without title and description leave no line
        "blog": first("blog", F.col("page_ord"), blog_pages)
        .groupBy("website_id")
        .agg(F.array_sort(F.collect_list(F.struct("n", blog_lines.alias("b")))).alias("bs"))
        .select(
            "website_id",
            F.array_join(
                F.concat(
                    F.array(F.lit(fixed.CONTEXT_BLOG_HEADER)),
                    F.flatten(F.transform("bs", lambda x: x["b"])),
                    F.array(F.lit(fixed.CONTEXT_RULE)),
                ),
                "\n",
            ).alias("text"),
        ),
    }
    if searches is not None:
        kept = top_per_key(searches, ["website_id"], [F.col("index")], max_searches, rank="n")
        block = F.concat(
            F.lit("Search result "), F.col("index").cast("string"), F.lit(":\n"),
            _start(F.col("result"), sizes.search_chars), F.lit("\n"),
        )
        parts["search"] = _joined(kept, "website_id", "n", block).select(
            "website_id",
            F.concat(
                F.lit(fixed.CONTEXT_SECONDARY_HEADER),
                "text",
            ).alias("text"),
        )
    counted = pages.groupBy("website_id").agg(F.count(F.lit(1)).alias("n_pages"))
    out = sites.join(counted, "website_id", "left")
    for name, frame in parts.items():
        out = out.join(frame.withColumnRenamed("text", name), "website_id", "left")
    return out.select(
        "website_id",
        F.concat_ws(
            "\n",
            F.lit(fixed.CONTEXT_SITE_HEADER),
            F.concat(F.lit("Name: "), F.coalesce("name", F.lit("Unknown"))),
            F.concat(F.lit("URL: "), _text(F.col("url"))),
            F.concat(F.lit("Pages analyzed: "), F.coalesce("n_pages", F.lit(0)).cast("string")),
            F.lit(""),
            F.lit(fixed.CONTEXT_PRIMARY_HEADER),
            F.lit(fixed.CONTEXT_PRIMARY_NOTE),
            F.lit(""),
            *parts,
        ).alias("context"),
    )
