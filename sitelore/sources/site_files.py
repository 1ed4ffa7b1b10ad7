"""One knowledge document per site: written as a stream of pages, found by name, read by line.

A document is one JSON object over many lines, each page on a line of its own:

    {"metadata": {...},
    "primary_content": {"source": ..., "reliability": ..., "pages": [
    <legacy page>, ...
    ]}, "secondary_content": {...}, "pages": [
    <page>, ...
    ]}

so any JSON reader takes it whole, and `read_site_pages` takes a folder of documents of
any size line by line. Beside the usual fields a page has its number, `page_ord`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore.functions import urls
from sitelore.functions.slices import ROWS
from sitelore.operators.knowledge import knowledge_tables
from sitelore.schemas import PAGE, SITE_METADATA
from sitelore.sources.files import find_cached

_HEAD, _LEGACY, _MIDDLE, _PAGE, _END = range(5)


def _uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def site_lines(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """cache_name, kind, page_ord, line: the lines of every site's document, to be sorted by these.

    `sites`: website_id, url, name. A site without pages has a document with empty lists.
    """
    meta, rows = knowledge_tables(sites, pages)
    named = meta.withColumn("cache_name", urls.cache_name(F.col("normalized_url")))
    about = F.to_json(
        F.struct(
            "website_id", "url", "normalized_url", "name",
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"),
            "scraping_version", "pages_scraped", F.lit(False).alias("has_web_search_supplement"),
        )
    )
    head = F.concat(F.lit('{"metadata": '), about, F.lit(',\n"primary_content": {"source": "website_scraping", "reliability": "high", "pages": ['))
    middle = F.lit(']}, "secondary_content": {"source": "web_search", "reliability": "medium", "searches": []}, "pages": [')
    none = F.lit(None).cast("bigint")
    frame = F.array(*[
        F.struct(F.lit(kind).alias("kind"), line.alias("line"))
        for kind, line in ((_HEAD, head), (_MIDDLE, middle), (_END, F.lit("]}")))
    ])
    lines = named.select("cache_name", F.explode(frame).alias("f")).select("cache_name", "f.kind", none.alias("page_ord"), "f.line")
    # a site may hold most pages: its few metadata columns travel to them, not the other way round
    rows = rows.withColumn("page_ord", F.coalesce(F.col("page_ord").cast("bigint"), F.lit(0)))
    owned = rows.join(named.select("website_id", "cache_name"), "website_id")
    both = F.array(
        F.struct(F.lit(_LEGACY).alias("kind"), F.to_json("legacy").alias("line")),
        F.struct(F.lit(_PAGE).alias("kind"), F.to_json(F.struct("page_ord", "page.*")).alias("line")),
    )
    texts = owned.select("cache_name", "page_ord", F.explode(both).alias("f"))
    return lines.unionByName(texts.select("cache_name", "f.kind", "page_ord", "f.line"))


def write_site_files(sites: DataFrame, pages: DataFrame, folder: str) -> DataFrame:
    """Write one document per site into `folder`; returns name, pages, bytes of each (runs on use).

    Lines are sorted by site and written as they come, so a document of any size takes the memory
    of a batch. A file gets its name when it is complete: a task that is lost or repeated leaves the
    same whole file. `folder` is shared by all executors.
    """
    root = _uri(folder)
    lines = site_lines(sites, pages).repartition("cache_name").sortWithinPartitions("cache_name", "kind", "page_ord")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(root)
        store.create_dir(path, recursive=True)
        now, out, draft, n, size, before = None, None, "", 0, 0, None

        def finish() -> pa.RecordBatch:
            out.close()
            store.move(draft, f"{path}/{now}")
            return pa.RecordBatch.from_pydict(
                {"name": pa.array([now]), "pages": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())}
            )

        few = (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))
        for batch in few:
            for name, kind, line in zip(*(batch.column(c).to_pylist() for c in ("cache_name", "kind", "line"))):
                if name != now:
                    if out is not None:
                        yield finish()
                    now, n, size, before = name, 0, 0, None
                    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(draft)
                comma = "," if kind == before and kind in (_LEGACY, _PAGE) else ""
                data = ("" if before is None else f"{comma}\n").encode() + line.encode("utf-8", "surrogatepass")
                out.write(data)
                size += len(data)
                n += kind == _PAGE
                before = kind
        if out is not None:
            yield finish()

    return lines.select("cache_name", "kind", "line").mapInArrow(write, "name string, pages bigint, bytes bigint")


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """name of every document in `folder`, by listing it."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return listed.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    text = spark.read.option("pathGlobFilter", "*.json").text(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    return text.select(name.alias("name"), F.regexp_replace("value", ",$", "").alias("line"))


def read_site_pages(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """Page table (site columns and page columns) of the documents in `folder`, of those that `names`
    (name) lists, line by line: no document is held."""
    lines = _lines(spark, folder)
    if names is not None:
        lines = lines.join(names.select("name").distinct(), "name", "left_semi")
    about = lines.where(F.col("line").startswith('{"metadata": ')).select(
        "name", F.from_json(F.replace(F.col("line"), F.lit('{"metadata": '), F.lit("")), SITE_METADATA).alias("m")
    )
    page = F.from_json("line", PAGE.replace("struct<", "struct<page_ord:bigint,", 1))
    rows = lines.where(F.col("line").startswith('{"page_ord":')).select("name", page.alias("p"))
    site = about.select(
        "name", F.col("m.website_id").alias("website_id"), F.col("m.url").alias("website_url"),
        F.col("m.normalized_url").alias("normalized_website_url"), F.lit("high").alias("source_reliability"),
    )
    return rows.join(site, "name").select("name", *[c for c in site.columns if c != "name"], "p.*")


def cached_pages(spark: SparkSession, requests: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(requests with the `cached_name` that answers each, page table of the documents found).

    `requests`: url and any other columns. The current name is looked up first, then the legacy one.
    """
    found = find_cached(requests, catalog(spark, folder))
    names = found.where("cached_name is not null").select(F.col("cached_name").alias("name"))
    return found, read_site_pages(spark, folder, names)
