"""Nothing is cut by default, and long pages take time in proportion."""

import time

import pytest
from pyspark.sql import functions as F

from sitelore.functions.html import parse_html
from sitelore.operators.extract import Limits, extract_pages
from sitelore.operators.knowledge import knowledge_tables
from sitelore.operators.retrieve import hybrid_search, prepare_queries
from sitelore.operators import rank
from sitelore.operators.embed import embed, hash_embedder
from sitelore.plans.discover import discover


def page(n):
    body = "".join(
        f"<h2>Head {i}</h2><p>Paragraph {i} with some words.</p><ul><li>x{i}</li></ul>"
        f'<a href="/l{i}">link {i}</a><img src="/i{i}.png" alt="picture number {i} of the page">'
        for i in range(n)
    )
    return f"<html><body><main>{body}</main></body></html>"


def extracted(spark, html, **options):
    df = spark.createDataFrame([("https://e.com/p", html)], "page_url string, html string")
    return extract_pages(df, **options).collect()[0]


def test_long_page_is_kept_whole(spark):
    row = extracted(spark, page(700))
    assert len(row.sections) == len(row.paragraphs) == len(row.lists) == 700
    assert len(row.links) == len(row.images) == len(row.anchors) == 700
    assert len(row.content) > 12_000 and row.content.endswith("link 699")
    cut = extracted(spark, page(700), limits=Limits(content=100, sections=3, section=20))
    assert len(cut.content) == 100 and len(cut.sections) == 3
    assert all(len(s.content) <= 20 for s in cut.sections)


def test_time_grows_with_the_page(spark):
    def seconds(n):
        start = time.perf_counter()
        extracted(spark, page(n))
        return time.perf_counter() - start

    seconds(200)  # builds and compiles the expressions
    small, large = seconds(2000), seconds(16_000)
    assert large < 8 * 3 * max(small, 1.0)


def test_relations_of_nodes():
    nodes = parse_html("<div><h2>a</h2><p>b</p><h4>c</h4><p>d</p><h3 class='sidebar-x'>e</h3><p>f</p></div><img>")["nodes"]
    by_tag = [n for n in nodes if n["tag"] in ("h2", "h3", "h4")]
    div = next(n for n in nodes if n["tag"] == "div")
    assert [nodes[k]["tag"] for k in div["kids"]] == ["h2", "p", "h4", "p", "h3", "p"]
    assert [n["place"] for n in by_tag] == [0, 2, 4]
    assert by_tag[0]["stop4"] == 2
    assert [nodes[i]["tag"] for i in next(n for n in nodes if n["tag"] == "img")["up"]] == ["html", "body"]


def test_knowledge_of_many_pages(spark):
    pages = spark.range(40).select(
        F.lit("w").alias("website_id"), F.col("id").alias("page_ord"),
        F.concat(F.lit("https://e.com/"), "id").alias("page_url"), F.concat(F.lit("T"), "id").alias("title"),
    )
    sites = spark.createDataFrame([("w", "https://e.com", "E"), ("v", "https://v.com", None)], "website_id string, url string, name string")
    meta, rows = knowledge_tables(sites, pages)
    assert {r.website_id: r.pages_scraped for r in meta.collect()} == {"w": 40, "v": 0}
    assert sorted(r.legacy.title for r in rows.collect()) == sorted(f"T{i}" for i in range(40))


@pytest.mark.parametrize("limit,found", [(None, True), (2000, False)])
def test_lexical_search_reads_every_chunk(spark, limit, found):
    n = 2300
    chunks = spark.range(n).select(
        F.format_string("c%05d", "id").alias("chunk_id"), F.lit("s").alias("website_id"), F.col("id").cast("int").alias("chunk_index"),
        F.when(F.col("id") == n - 1, "the zanzibar warehouse opens daily").otherwise(F.concat(F.lit("filler text number "), "id")).alias("text"),
        F.lit("Page").alias("page_title"), F.lit("https://e.com/a").alias("source_url"), F.lit("section").alias("chunk_type"),
    )
    features = rank.add_features(embed(chunks, "text", hash_embedder(8)))
    asked = spark.createDataFrame([("q", "s", "zanzibar warehouse")], "qid string, website_id string, query string")
    results, counts = hybrid_search(prepare_queries(asked, hash_embedder(8)), features, ["chunk_index"], lexical_limit=limit)
    vector = {r.chunk_id for r in results.where("score is not null").collect()}
    best = results.orderBy("rank").first()
    assert (best.chunk_id == "c02299") == (found or "c02299" in vector)
    assert counts.first().candidate_count_lexical == (limit or n)


def test_discovery_joins_links_and_sitemaps(spark):
    anchors = spark.createDataFrame(
        [("https://e.com", "https://e.com/about", "About us", 0, 0), ("https://e.com", "https://e.com/private/x", "", 0, 1)],
        "base_url string, url string, anchor_text string, page_ord bigint, pos bigint",
    )
    listed = spark.createDataFrame([("https://e.com", "https://e.com/contact"), ("https://e.com", "https://e.com/about")], "base_url string, url string")
    rules = spark.createDataFrame([("https://e.com", ["/private"])], "base_url string, disallowed array<string>")
    got = {r.url for r in discover(anchors, listed, rules, 9).collect()}
    assert got == {"https://e.com/about", "https://e.com/contact"}
