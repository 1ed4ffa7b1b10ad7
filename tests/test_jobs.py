"""Crawl selection, quality, prompts, evaluation, knowledge, store, files, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sitelore import fixed
from sitelore.operators import crawl, evaluate, knowledge, prompt, quality
from sitelore.operators.embed import batch_embedder, embed, hash_embedder
from sitelore.operators.store import ChunkStore, flatten_metadata
from sitelore.plans.ask import answer_questions, batch_chat, retrieve_chunks
from sitelore.plans.ingest import index_pages, page_table
from sitelore.plans.queries import SITE_SIZES, SIZES
from sitelore.sources import files
from sitelore.sources.sitemaps import parse_sitemap, walk_sitemaps
from sitelore.streaming.micro_batches import index_arriving_pages, index_batch, log_batch


def candidates(spark, base, links):
    rows = [(base, u, i, "") for i, u in enumerate(links)]
    return spark.createDataFrame(rows, "base_url string, url string, pos int, anchor_text string")


def test_site_crawl_selection(spark):
    links = [
        "https://e.com/", "/login", "https://e.com/login", "https://www.e.com/pricing", "https://e.com/blog/a", "https://e.com/blog/a/",
        "https://e.com/x.pdf", "https://other.com/a", "https://e.com/?q=x", "https://e.com/misc", "https://e.com/a/b/c/d/e", "", "https://e.com/terms",
    ]
    df = candidates(spark, "https://e.com", links)
    got = [(r.url, r.score) for r in crawl.select_candidates(df, 10).orderBy("rank").collect()]
    assert got == [
        ("https://www.e.com/pricing", 975), ("https://e.com/blog/a", 620), ("https://e.com/misc", 325), ("https://e.com/terms", 125),
    ]
    c = crawl.selection_counts(df).collect()[0]
    assert (c.crawl_intent, c.filtered_count, c.utility_filtered_count, c.candidate_count) == (fixed.CRAWL_HOMEPAGE, 7, 0, 11)


def test_specific_crawl_prefers_related_pages(spark):
    links = [
        "https://en.wiki.org/wiki/Green_tea", "https://en.wiki.org/wiki/Help:Contents", "https://en.wiki.org/about",
        "https://en.wiki.org/wiki/Tea_ceremony", "https://en.wiki.org/wiki/Ocean", "https://en.wiki.org/wiki/Ocean",
    ]
    df = candidates(spark, "https://en.wiki.org/wiki/Green_tea", links)
    got = [(r.url, r.score) for r in crawl.select_candidates(df, 5).orderBy("rank").collect()]
    assert got[0] == ("https://en.wiki.org/wiki/Green_tea", 10000)
    assert [u for u, _ in got[1:]] == ["https://en.wiki.org/wiki/Tea_ceremony", "https://en.wiki.org/wiki/Ocean"]
    assert got[1][1] == 150 + 300 + 150 + 150 + 14
    c = crawl.selection_counts(df).collect()[0]
    assert (c.filtered_count, c.utility_filtered_count, c.candidate_count) == (2, 2, 5)


def test_robots_and_sitemaps(spark):
    text = "User-agent: a\nDisallow: /a\nUser-agent: *\nDISALLOW: /Private\nDisallow:\nAllow: /x\n# Sitemap: no\nSiteMap : https://e.com/s1.xml\r\nSitemap:\n"
    robots = crawl.parse_robots(spark.createDataFrame([("https://e.com", text)], "base_url string, robots_text string"))
    row = robots.collect()[0]
    assert row.disallowed == ["/private"] and row.sitemaps == ["https://e.com/s1.xml"]
    pages = spark.createDataFrame([("https://e.com", "https://e.com/PRIVATE/1"), ("https://e.com", "https://e.com/a"), ("https://n.com", "https://n.com/private")], "base_url string, url string")
    kept = crawl.allowed_by_robots(pages, robots, "url", "base_url").collect()
    assert {r.url for r in kept} == {"https://e.com/a", "https://n.com/private"}
    xml = [
        ("https://e.com/s1.xml", '<sitemapindex xmlns="http://x"><sitemap><loc> https://e.com/s2.xml </loc></sitemap></sitemapindex>'),
        ("https://e.com/s2.xml", "<urlset><url><loc>https://e.com/p/</loc></url><url><loc>https://e.com/q</loc></url><url/></urlset>"),
        ("https://e.com/sitemap.xml", "not xml"), ("https://e.com/sitemap_index.xml", "<urlset><url><loc>https://e.com/p</loc></url><url><loc>https://e.com/r</loc></url></urlset>"),
    ]
    fetched = spark.createDataFrame(xml, "url string, xml string")

    def walked(**limits):
        return [r.url for r in walk_sitemaps(robots, fetched, **limits).orderBy("place").collect()]

    assert walked() == ["https://e.com/p", "https://e.com/r", "https://e.com/q"]
    assert walked(max_files=3) == ["https://e.com/p", "https://e.com/r"]
    assert walked(max_urls=1) == ["https://e.com/p"]


def test_sitemap_texts(spark):
    texts = {
        "plain": ("<urlset><url><loc>https://e.com/a</loc></url><url><loc/></url><url><x/></url></urlset>", ["https://e.com/a"], []),
        "namespaces": ('<?xml version="1.0"?>\n<s:urlset xmlns:s="http://w/0.9"><s:url><s:loc>\n https://e.com/a?x=1&amp;y=2 \n</s:loc><s:lastmod>1</s:lastmod></s:url></s:urlset>', ["https://e.com/a?x=1&y=2"], []),
        "second": ("<urlset><url><loc> </loc><loc>https://e.com/b</loc></url></urlset>", None, []),
        "index": ("<sitemapindex><sitemap><loc>https://e.com/1.xml</loc></sitemap><sitemap><loc>https://e.com/2.xml</loc></sitemap></sitemapindex>", [], ["https://e.com/1.xml", "https://e.com/2.xml"]),
        "both": ("<m><url><loc>u</loc></url><sitemap><loc>s</loc></sitemap><url><loc>v</loc></url></m>", ["u", "v"], ["s"]),
        "cut": ("<urlset><url><loc>https://e.com/a</loc></url>", [], []),
        "text": ("not xml", [], []), "empty": ("", [], []), "null": (None, [], []),
        "html": ("<html><body><p>Not found<br></body></html>", [], []),
        "other": ("<feed><entry><loc>u</loc></entry></feed>", [], []),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in texts.items()], "name string, xml string")
    got = {r.name: (r.f.urls, r.f.sitemaps) for r in df.select("name", parse_sitemap(F.col("xml")).alias("f")).collect()}
    for name, (_, pages, nested) in texts.items():
        assert got[name][1] == nested and (pages is None or got[name][0] == pages), name


def walk_by_hand(seeds, files, max_files, max_urls):
    """First in, first out over dictionaries of (urls, sitemaps)."""
    queue, seen, found = list(seeds), [], []
    while queue and len(seen) < max_files and len(found) < max_urls:
        at = queue.pop(0)
        if at in seen:
            continue
        seen.append(at)
        pages, nested = files.get(at, ([], []))
        queue += [n for n in nested if n not in seen]
        for p in pages:
            if p not in found and len(found) < max_urls:
                found.append(p)
    return found


def test_sitemap_walk_equals_a_queue(spark):
    rng = random.Random(4)
    names = [f"https://e.com/m{i}.xml" for i in range(40)] + ["https://e.com/sitemap.xml", "https://e.com/sitemap-index.xml"]
    files = {}
    for n in names[:-2:1] + names[-1:]:
        files[n] = (
            [f"https://e.com/p{rng.randrange(60)}" for _ in range(rng.randrange(5))],
            [rng.choice(names + ["https://e.com/gone.xml"]) for _ in range(rng.randrange(4))],  # cycles, repeats, missing ones
        )
    xml = [
        (n, "<x>" + "".join(f"<url><loc>{u}</loc></url>" for u in pages) + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in nested) + "</x>")
        for n, (pages, nested) in files.items()
    ]
    sites = spark.createDataFrame([("https://e.com", names[:3] + names[:1]), ("https://n.org", [names[7]])], "base_url string, sitemaps array<string>")
    fetched = spark.createDataFrame(xml, "url string, xml string")
    common = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml"]
    for max_files, max_urls in ((None, None), (6, None), (None, 7), (9, 10)):
        rows = walk_sitemaps(sites, fetched, max_files, max_urls).orderBy("base_url", "place").collect()
        for site, first in (("https://e.com", names[:3] + names[:1]), ("https://n.org", [names[7]])):
            want = walk_by_hand(first + [site + c for c in common], files, max_files or 999, max_urls or 999)
            assert [r.url for r in rows if r.base_url == site] == want
    assert walk_sitemaps(sites.limit(0), fetched).count() == 0
    assert walk_sitemaps(sites, fetched.limit(0)).count() == 0


RETRIEVED = "qid string, rank int, chunk_id string, text string, source_url string, page_title string, chunk_type string, score double, distance double"


def retrieved(spark):
    rows = [
        ("a", 1, "1", "x" * 300, "https://e.com", "T", "section", 0.9, 0.1), ("a", 2, "2", "  ", "", "", "", None, None),
        ("a", 3, "3", "y y " * 20, "https://e.com", "T", "section", 0.83, 0.17), ("b", 1, "4", "short", "", "", "faq", None, None),
    ]
    return spark.createDataFrame(rows, RETRIEVED)


def test_coverage_and_warnings(spark):
    got = {r.qid: r for r in quality.debug_summary(retrieved(spark)).collect()}
    a = got["a"]
    assert (a.chunks_retrieved, a.usable_chunks, a.source_count, a.empty_text_count, a.total_text_chars) == (3, 2, 1, 1, 379)
    assert (a.average_score, a.average_distance) == (0.865, 0.135)
    assert [tuple(t) for t in a.chunk_types] == [("section", 2), ("unknown", 1)]
    assert a.warnings == [fixed.MSG_SOME_WEAK, fixed.MSG_NO_URL, fixed.MSG_NO_TITLE, fixed.MSG_ONE_SOURCE]
    assert got["b"].average_score is None and got["b"].warnings[0] == fixed.MSG_NOT_READABLE


def test_context_keeps_numbering_gap(spark):
    text = {r.qid: r.context for r in prompt.rag_context(retrieved(spark), SIZES).collect()}
    blocks = text["a"].split("\n\n")
    assert [b.split("\n")[0] for b in blocks] == ["[Source 1]", "[Source 3]"]
    assert "Type: section, score=0.9\nURL: https://e.com\nContent:\nxxx" in blocks[0]
    assert text["b"] == "[Source 1]\nTitle: Untitled page\nType: faq\nURL: Not available\nContent:\nshort"


def test_sources_are_unique_and_shortened(spark):
    got = prompt.format_sources(retrieved(spark), SIZES).orderBy("qid", "source_rank").collect()
    assert [(r.qid, r.source_rank) for r in got] == [("a", 1), ("b", 1)]
    assert got[0].text_preview == "x" * 240 + "..."
    problems = quality.source_problems(prompt.format_sources(retrieved(spark), SIZES), position="source_rank").collect()
    assert {p.message for p in problems} == {"Source 1 is missing source_url.", "Source 1 is missing page_title."}


def test_history_rules(spark):
    history = [("system", "s"), ("user", "a"), ("assistant", " "), *[("assistant", f"m{i}") for i in range(7)], ("user", "the  question")]
    df = spark.createDataFrame([(history, " the question ")], "h array<struct<role:string,content:string>>, q string")
    row = df.select(prompt.prior_messages(F.col("h"), F.col("q"), SIZES).alias("p"), prompt.latest_question(F.lit(" "), F.col("h")).alias("l"),
                    prompt.rag_messages(F.lit(""), F.col("h"), F.col("q"), SIZES).alias("m")).collect()[0]
    assert [m.content for m in row.p] == [f"m{i}" for i in range(1, 7)] and row.l == "the  question"
    assert row.m[0].role == "system" and prompt.NO_CONTEXT in row.m[0].content and row.m[-1].content == "the question" and len(row.m) == 8


def test_flags_and_summary(spark, tmp_path):
    rows = [
        ("q1", "social_links", "Share the link", "clickable_link", "Here: [X](https://x.com/a)", "rag", 1, True, False, "2"),
        ("q2", "contact_support", "contact number?", "contact_card", "We have none of those here", "rag", 0, True, True, "N/A"),
        ("q3", "store_locations", "Where?", "grouped_locations", "- Lahore\n- Karachi branch is here now", "legacy_prompt", 1, False, False, "1"),
        ("q4", "contact_support", "hours and email?", "contact_card", "Call +92 300 1234567, 9am, a@b.co", "rag", 1, False, False, ""),
    ]
    cols = "question_id string, category string, question string, answer_format string, answer string, mode string, source_count int, requires_source boolean, hallucination_sensitive boolean, manual_score string"
    df = evaluate.answer_flags(spark.createDataFrame(rows, cols).withColumn("latency_ms", F.lit(100)))
    got = {r.question_id: r for r in df.collect()}
    assert got["q1"].flags == ["very_short_answer"]
    assert got["q2"].flags == ["missing_sources", "possible_hallucination", "missing_phone"]
    assert got["q3"].flags == ["non_rag_mode"] and got["q3"].cities == ["Lahore", "Karachi"]
    assert got["q4"].flags == [] and got["q4"].emails == ["a@b.co"]
    path = str(tmp_path / "r.csv")
    df.select("category", "answer", "latency_ms", "manual_score", F.array_join("flags", "; ").alias("flags")).coalesce(1).write.option("header", True).csv(path)
    total = {r.category: r for r in evaluate.summarize(files.read_results(spark, path)).collect()}
    assert total[None].total_questions == 4 and total[None].average_latency_ms == 100.0 and total[None].average_manual_score == 1.5
    assert total["contact_support"].flag_missing_phone == 1 and total["contact_support"].average_manual_score is None
    assert {r.manual_score: r.n for r in evaluate.manual_score_counts(df).collect()} == {"2": 1, "N/A": 1, "1": 1}
    with pytest.raises(ValueError):
        files.read_results(spark, "x.txt")


def test_knowledge_upgrade_is_idempotent(spark, tmp_path):
    old = {"metadata": {"url": "http://e.com/"}, "primary_content": {"pages": [{"title": "Home", "url": "http://e.com/", "content": "Body", "page_type": "homepage", "sections": []}]}}
    (tmp_path / "k.json").write_text(json.dumps(old))
    once = files.read_knowledge(spark, str(tmp_path / "k.json"))
    row = once.collect()[0]
    assert row.metadata.normalized_url == "https://e.com" and len(row.metadata.website_id) == 12 and row.metadata.pages_scraped == 1
    assert row.pages[0].title == "Home" and row.pages[0].normalized_page_url == "https://e.com" and row.pages[0].quality.content_length == 4
    assert row.secondary_content.source == "web_search" and row.primary_content.reliability == "high"
    again = knowledge.upgrade_knowledge(once).collect()[0]
    assert again.pages == row.pages and again.metadata.website_id == row.metadata.website_id
    assert knowledge.knowledge_pages(once).count() == 1


def test_site_context_buckets(spark):
    rows = [
        (0, "https://e.com", "homepage", "Old", "", "x"), (1, "https://e.com/home", "homepage", "Home", "Desc", "Main text"),
        *[(i, f"https://e.com/about{i}", "about", f"A{i}", "", "c" * 700) for i in range(2, 9)], (10, "https://e.com/blog/1", "blog", "Post", "d" * 300, ""),
    ]
    pages = spark.createDataFrame(rows, "page_ord bigint, page_url string, page_type string, title string, description string, content string").withColumn("website_id", F.lit("s"))
    sites = spark.createDataFrame([("s", "https://e.com", "Shop")], "website_id string, url string, name string")
    found = spark.createDataFrame([("s", 1, "found it")], "website_id string, index int, result string")
    text = knowledge.chatbot_context(pages, sites, SITE_SIZES, found, key_pages=5, blog_pages=3, max_searches=5).collect()[0].context
    assert "Title: Home" in text and "Old" not in text and "Main content: Main text" in text
    assert [f"## A{i}" in text for i in range(2, 9)] == [True] * 5 + [False] * 2 and "c" * 600 in text and "c" * 601 not in text
    assert "- Post\n  " + "d" * 200 + "\n" in text and "Search result 1:\nfound it" in text
    assert "Pages scraped: 10" in knowledge.scraped_context(pages, sites, SITE_SIZES, max_pages=10).collect()[0].context
    docs = knowledge.build_knowledge(sites, pages, found, max_pages=4).collect()[0]
    assert [p.title for p in docs.pages] == ["Old", "Home", "A2", "A3"] and docs.metadata.has_web_search_supplement


FETCHED = [
    (1, "https://tea.example/contact", "<html><head><title>Contact</title></head><body><main><h1>Contact us</h1><p>Call 03001234567 or write to help@tea.example for customer service every day.</p></main></body></html>"),
    (2, "https://tea.example/about", "<html><head><title>About</title></head><body><main><h1>About</h1><p>We grow green tea on a small hill and roast it by hand in spring.</p></main></body></html>"),
]


def test_store_upsert_delete_and_ask(spark, tmp_path):
    fetched = spark.createDataFrame(FETCHED, "page_id bigint, url string, html string")
    store = ChunkStore(spark, str(tmp_path / "store"))
    pages = page_table(fetched)
    first = index_pages(pages, store, hash_embedder(8))
    assert first["errors"] == [] and first["chunks_built"] == first["chunks_indexed"] == store.read().count() > 0
    again = index_pages(pages, store, hash_embedder(8))
    assert again["chunks_deleted"] == first["chunks_built"] == store.read().count()
    assert index_pages(pages, store, hash_embedder(8), reindex=False)["chunks_deleted"] == 0 and store.read().count() == first["chunks_built"]
    site = store.read().first().website_id
    assert store.count_site(site) == first["chunks_built"] and store.count_site("none") == 0
    assert {r.chunk_type for r in store.site(site, {"chunk_type": ["section", None], "page_type": None}).collect()} == {"section"}
    assert [r.rank for r in store.site_chunks(site, limit=2).collect()] == [1, 2]

    asked = spark.createDataFrame(
        [("1", site, "What is the customer service number?", None), ("2", "nosite", "Anything?", None), ("3", "nosite", "Anything?", "SECONDARY SOURCE prompt")],
        "qid string, website_id string, query string, system_prompt string",
    )
    got = retrieve_chunks(asked, store.read(), hash_embedder(8), ["chunk_index"])
    answers = {r.qid: r for r in answer_questions(asked, got, batch_chat(lambda ms: f"{len(ms)} messages"), SIZES).collect()}
    assert answers["1"].mode == "rag" and answers["1"].answer == "2 messages" and answers["1"].sources[0].page_title == "Contact"
    assert "03001234567" in answers["1"].messages[0].content and answers["1"].warnings == []
    assert answers["2"].answer == fixed.INSUFFICIENT_ANSWER and answers["2"].warnings == [fixed.MSG_NO_CHUNKS]
    assert answers["3"].mode == "legacy_prompt" and answers["3"].provenance == "primary_plus_secondary"

    assert store.delete_sites(spark.createDataFrame([(site,)], "website_id string")) == first["chunks_built"]
    assert store.count_site(site) == 0


def test_metadata_flattening(spark):
    df = spark.createDataFrame([("w", 3)], "website_id string, chunk_index int").withColumn(
        "metadata", F.struct(F.lit("old").alias("website_id"), F.lit(None).cast("string").alias("n"), F.array(F.lit(1)).alias("a"), F.lit(True).alias("b"))
    )
    assert flatten_metadata(df).collect()[0].flat_metadata == {"website_id": "w", "n": "", "a": "[1]", "b": "true", "chunk_index": "3"}


def test_embedding_batches_and_errors(spark):
    df = spark.createDataFrame([("a",), ("bb",), ("c  c",)], "t string").coalesce(1)
    sizes = batch_embedder(lambda texts: [[float(len(t)), float(len(texts))] for t in texts], batch_size=2)
    assert [r.embedding for r in embed(df, "t", sizes).collect()] == [[1.0, 2.0], [2.0, 2.0], [3.0, 1.0]]
    with pytest.raises(Exception, match="Cannot embed empty text"):
        embed(spark.createDataFrame([(" ",)], "t string"), "t", hash_embedder()).collect()
    with pytest.raises(Exception, match="count mismatch"):
        embed(df, "t", batch_embedder(lambda texts: [])).collect()


def test_logs_and_cache_lookup(spark, tmp_path):
    jobs = spark.createDataFrame([("u", "x", None)], "url string, tcr_seconds string, pages_scraped string")
    row = files.job_log(jobs).collect()[0]
    assert (row.tcr_seconds, row.pages_scraped, row.cache_hit, row.user_id) == (0.0, 0, False, None)
    chats = spark.createDataFrame([("q", "é", "rag")], "question string, answer string, provenance string")
    files.append_json(files.chat_log(chats), str(tmp_path / "log"))
    files.append_json(files.chat_log(chats), str(tmp_path / "log"))
    assert [r.answer for r in spark.read.json(str(tmp_path / "log")).collect()] == ["é", "é"]
    asked = spark.createDataFrame([("http://e.com",), ("https://n.com",)], "url string")
    wanted = files.find_cached(asked, spark.createDataFrame([("none",)], "name string")).collect()
    catalog = spark.createDataFrame([(wanted[0].legacy_name,)], "name string")
    got = {r.url: r.cached_name for r in files.find_cached(asked, catalog).collect()}
    assert got[wanted[0].url] == wanted[0].legacy_name and got[wanted[1].url] is None


FETCHED_SCHEMA = "page_id bigint, url string, html string"


def stored(store):
    return sorted((r.chunk_id, r.chunk_index) for r in store.read().select("chunk_id", "chunk_index").collect())


def test_pages_stream_into_store(spark, tmp_path):
    """Pages of one site in two batches, texts repeated between them, equal one full run."""
    shared = "<p>The same long paragraph stands on both pages of the site, word for word.</p>"
    pages = [
        (i, f"https://one.example/p{i}", f"<html><title>Page {i}</title><body><h1>Head {i}</h1><p>Own words of page number {i} here.</p>{shared}</body></html>")
        for i in range(4)
    ] + list(FETCHED)
    pages = [(i, u, h) for i, (_, u, h) in enumerate(pages)]
    arriving = str(tmp_path / "in")
    store = ChunkStore(spark, str(tmp_path / "store"))

    def run():
        index_arriving_pages(
            spark, arriving, store, hash_embedder(8), str(tmp_path / "cp"), str(tmp_path / "pages")
        ).awaitTermination(120)

    spark.createDataFrame(pages[:2], FETCHED_SCHEMA).write.parquet(arriving)
    run()
    first = store.read().count()
    spark.createDataFrame(pages[2:], FETCHED_SCHEMA).write.mode("append").parquet(arriving)
    run()
    whole = ChunkStore(spark, str(tmp_path / "whole"))
    index_pages(page_table(spark.createDataFrame(pages, FETCHED_SCHEMA)), whole, hash_embedder(8))
    assert 0 < first < store.read().count()
    assert stored(store) == stored(whole)
    # a repeated batch and a changed page
    index_batch(spark.createDataFrame(pages[2:], FETCHED_SCHEMA), 1, str(tmp_path / "pages"), store, hash_embedder(8))
    assert stored(store) == stored(whole)
    changed = [(0, pages[0][1], pages[0][2].replace("Own words", "Other words"))]
    index_batch(spark.createDataFrame(changed, FETCHED_SCHEMA), 2, str(tmp_path / "pages"), store, hash_embedder(8))
    texts = [r.text for r in store.read().select("text").collect()]
    assert any("Other words of page number 0" in t for t in texts) and not any("Own words of page number 0" in t for t in texts)


def test_repeated_log_batch(spark, tmp_path):
    chats = spark.createDataFrame([("q", "a", "rag")], "question string, answer string, provenance string")
    for number in (0, 1, 1):
        log_batch(files.chat_log(chats), number, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
