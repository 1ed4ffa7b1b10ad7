"""Table schemas. One row per page; nested values stay inside the page row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADINGS = "array<struct<level:int,text:string>>"
SECTIONS = "array<struct<heading:string,level:int,content:string>>"
LISTS = "array<struct<type:string,items:array<string>>>"
FAQS = "array<struct<question:string,answer:string>>"
TABLES = "array<struct<headers:array<string>,rows:array<array<string>>>>"
IMAGES = (
    "array<struct<src:string,absolute_url:string,alt:string,title:string,figcaption:string,"
    "nearby_text:string,width:int,height:int,loading:string,page_url:string,image_type:string>>"
)
LINKS = "array<struct<text:string,url:string,is_internal:boolean>>"
PAGE_METADATA = "struct<canonical:string,open_graph:map<string,string>,twitter:map<string,string>>"
QUALITY = (
    "struct<status_code:int,content_length:int,useful_text_score:double,image_count:int,"
    "link_count:int,scraped_at:string,errors:array<string>,render_time_ms:int,final_url:string>"
)
SEARCHES = "array<struct<index:int,result:string>>"

# column -> type of the page table
PAGE_COLUMNS = {
    "page_url": "string",
    "normalized_page_url": "string",
    "page_type": "string",
    "title": "string",
    "description": "string",
    "extraction_method": "string",
    "headings": HEADINGS,
    "sections": SECTIONS,
    "paragraphs": "array<string>",
    "lists": LISTS,
    "faqs": FAQS,
    "tables": TABLES,
    "images": IMAGES,
    "links": LINKS,
    "structured_data": "array<string>",  # canonical JSON text
    "metadata": PAGE_METADATA,
    "quality": QUALITY,
    "content": "string",
}
# site columns carried by every page row
SITE_COLUMNS = {
    "website_id": "string",
    "website_url": "string",
    "normalized_website_url": "string",
    "source_reliability": "string",
    "page_ord": "bigint",
}
LEGACY_PAGE = (
    f"struct<title:string,description:string,sections:{SECTIONS},content:string,"
    "url:string,page_type:string>"
)
PAGE = "struct<" + ",".join(f"{k}:{v}" for k, v in PAGE_COLUMNS.items()) + ">"
SITE_METADATA = (
    "struct<website_id:string,url:string,normalized_url:string,name:string,created_at:string,"
    "scraping_version:string,pages_scraped:int,has_web_search_supplement:boolean>"
)
KNOWLEDGE = (
    f"metadata {SITE_METADATA}, "
    f"primary_content struct<source:string,reliability:string,pages:array<{LEGACY_PAGE}>>, "
    f"pages array<{PAGE}>, "
    f"secondary_content struct<source:string,reliability:string,searches:{SEARCHES}>, "
    "source_url string"
)
QUESTION = (
    "id string, category string, intent string, question string, expected_behavior string, "
    "answer_format string, requires_source boolean, hallucination_sensitive boolean, "
    "manual_review_required boolean, expected_entities array<string>"
)
SOURCE = (
    "struct<source_url:string,page_title:string,chunk_type:string,score:double,"
    "distance:double,text_preview:string>"
)


def with_page_defaults(df: DataFrame) -> DataFrame:
    """Add the page and site columns that are missing: '' for text, empty for lists."""
    missing = {}
    for name, kind in {**SITE_COLUMNS, **PAGE_COLUMNS}.items():
        if name in df.columns:
            continue
        if kind == "string":
            missing[name] = F.lit("")
        elif kind.startswith("array"):
            missing[name] = F.array().cast(kind)
        else:
            missing[name] = F.lit(None).cast(kind)
    return df.withColumns(missing) if missing else df
