"""Registered queries: every operator over whole given tables.

Each takes (spark, folder) and returns a DataFrame. Long texts are reported as hashes
of the whole text, so results stay small without cutting anything.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore import fixed
from sitelore.functions import scoring, urls
from sitelore.functions.sql import register_chunk_functions
from sitelore.functions.text import clean_text, dedupe_key, match_text, query_terms, word_count
from sitelore.operators import chunks as chunking
from sitelore.operators import crawl, evaluate, knowledge, prompt, quality, rank, retrieve
from sitelore.operators.embed import embed, hash_embedder
from sitelore.operators.extract import extract_pages, needs_browser
from sitelore.operators.skew import first_per_key, running_index, sliced_join
from sitelore.operators.store import ChunkStore
from sitelore.plans.ask import retrieve_chunks
from sitelore.plans.crawl_job import crawl_job
from sitelore.plans.discover import discover, site_root
from sitelore.plans.evaluate_batch import evaluate_bank
from sitelore.plans.ingest import index_pages, page_table, searchable_chunks
from sitelore.session import checkpoint_root, materialize, materialize_alone
from sitelore.sources import site_files
from sitelore.sources.sitemaps import walk_sitemaps
from sitelore.sources.tables import documents_as_pages, source_site, table, text_table
from sitelore.streaming.event_time import stream_table, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
CHUNK_ORDER = ["page_ord", "type_ord", "item", "piece"]
# what the queries put into a prompt; the operators cut nothing of themselves
SIZES = prompt.Sizes(
    chunks=fixed.MAX_CONTEXT_CHUNKS, chunk_chars=fixed.MAX_CONTEXT_CHARS, sources=fixed.MAX_SOURCES, messages=fixed.HISTORY_MESSAGES
)
# the reference's cuts of a whole-site prompt, for callers that want them; `site_contexts` takes whole texts
SITE_SIZES = knowledge.TextSizes(
    sections=4, section_chars=400, content_chars=600, home_section_chars=800, home_content_chars=1500, blog_chars=200, search_chars=500
)
SOURCES = 20  # document sources in the tables: conversations are spread over them


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def big(c: Column) -> Column:
    return c.cast("bigint")


# --- URLs -------------------------------------------------------------------
@query
def url_normalize_cache(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.cache_url(F.col("url")).alias("normalized_url"))


@query
def url_normalize_crawl(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.crawl_url(F.col("url")).alias("normalized_url"))


@query
def website_identity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", urls.cache_url(F.col("url")).alias("n"))
    return p.select(
        "page_id",
        urls.website_id(F.col("n")).alias("website_id"),
        urls.cache_name(F.col("n")).alias("cache_name"),
        urls.legacy_cache_name(F.col("url")).alias("legacy_name"),
    )


@query
def canonical_domain_counts(spark: SparkSession, d: str) -> DataFrame:
    domain = urls.canonical_domain(urls.netloc_of(F.col("url"))).alias("domain")
    return table(spark, d, "pages").select(domain).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query
def page_type_priority(spark: SparkSession, d: str) -> DataFrame:
    return crawl.classify_pages(table(spark, d, "pages").select("page_id", "url")).drop("url")


def _candidates(spark: SparkSession, d: str, base: Column | None = None) -> DataFrame:
    """Every page URL as a crawl candidate of its own site's root page."""
    p = table(spark, d, "pages")
    return p.select(
        site_root(F.col("url")).alias("base_url"), "url", F.col("page_id").alias("pos"),
        F.lit("").alias("anchor_text"),
    )


def _specific_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every page URL as a candidate of the first page of its site."""
    c = _candidates(spark, d)
    first = c.groupBy("base_url").agg(F.min_by("url", "pos").alias("first_url"))
    joined = sliced_join(c, first, ["base_url"], ["pos"])
    return joined.select(F.col("first_url").alias("base_url"), "url", "pos", "anchor_text")


@query
def crawl_url_filter(spark: SparkSession, d: str) -> DataFrame:
    judged = crawl.judge_candidates(_candidates(spark, d))
    return judged.select(F.col("base").alias("base_url"), "candidate", "copies", "verdict", "score", "depth")


@query
def crawl_select_topk(spark: SparkSession, d: str) -> DataFrame:
    return crawl.select_candidates(_candidates(spark, d), fixed.MAX_PAGES_PER_SITE - 1)


@query
def crawl_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    return crawl.selection_counts(_candidates(spark, d))


@query
def crawl_specific_topk(spark: SparkSession, d: str) -> DataFrame:
    return crawl.select_candidates(_specific_candidates(spark, d), fixed.MAX_SPECIFIC_PAGES)


@query
def crawl_specific_counts(spark: SparkSession, d: str) -> DataFrame:
    return crawl.selection_counts(_specific_candidates(spark, d))


def _robots(spark: SparkSession, d: str) -> DataFrame:
    """A robots file per site, derived from its pages: the first page's top folder is closed
    to everyone, `/` to one other robot."""
    p = table(spark, d, "pages").select(
        site_root(F.col("url")).alias("base_url"), "page_id",
        F.get(urls.path_segments(urls.path_of(F.col("url"))), F.lit(0)).alias("folder"),
    )
    first = p.groupBy("base_url").agg(F.min_by("folder", "page_id").alias("folder"))
    text = F.concat(
        F.lit("User-agent: otherbot\nDisallow: /\n\nUser-Agent: *\nDisallow:\nDisallow: /"),
        F.col("folder"), F.lit("\nSitemap: "), F.col("base_url"), F.lit("/map.xml\n"),
    )
    return crawl.parse_robots(first.select("base_url", text.alias("robots_text")))


def _sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """url, xml: sitemap files of every site, derived from all its pages. `/map.xml` lists branches,
    a branch lists leaves and `/map.xml` again, a leaf lists 50 page numbers; `/sitemap.xml`
    lists the last leaf's pages once more."""
    p = table(spark, d, "pages").select(
        site_root(F.col("url")).alias("base"), "page_id", "url", F.expr("page_id div 50").alias("leaf")
    )
    p = p.withColumn("branch", F.expr("leaf div 50"))
    xmlns = "http://www.sitemaps.org/schemas/sitemap/0.9"

    def text(kind: str, entry: str, locations: Column, more: Column | None = None) -> Column:
        parts = F.transform(locations, lambda u: F.concat(F.lit(f"<{entry}><loc>"), u, F.lit(f"</loc></{entry}>")))
        return F.concat(
            F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<{kind} xmlns="{xmlns}">'), F.array_join(parts, "\n"),
            F.lit("") if more is None else more, F.lit(f"</{kind}>"),
        )

    def ordered(rows: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
        return rows.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias("locs"))

    escaped = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    leaves = materialize(ordered(p, ["base", "branch", "leaf"], "page_id", escaped), "leaves")
    named = lambda kind, n: F.concat(F.col("base"), F.lit(f"/map-{kind}"), F.col(n).cast("string"), F.lit(".xml"))
    branches = ordered(leaves, ["base", "branch"], "leaf", named("leaf", "leaf"))
    top = ordered(branches, ["base"], "branch", named("branch", "branch"))
    last = leaves.groupBy("base").agg(F.max_by("locs", "leaf").alias("locs"))
    back = F.concat(F.lit("<sitemap><loc>"), F.col("base"), F.lit("/map.xml</loc></sitemap>"))
    urlset = text("urlset", "url", F.col("locs")).alias("xml")
    files = leaves.select(named("leaf", "leaf").alias("url"), urlset)
    files = files.unionByName(branches.select(named("branch", "branch").alias("url"), text("sitemapindex", "sitemap", F.col("locs"), back).alias("xml")))
    files = files.unionByName(top.select(F.concat("base", F.lit("/map.xml")).alias("url"), text("sitemapindex", "sitemap", F.col("locs")).alias("xml")))
    return files.unionByName(last.select(F.concat("base", F.lit("/sitemap.xml")).alias("url"), urlset))


@query
def sitemap_walk(spark: SparkSession, d: str) -> DataFrame:
    """Every page URL that the sitemaps of a site list, in the order in which a walk finds them."""
    found = walk_sitemaps(_robots(spark, d).select("base_url", "sitemaps"), _sitemaps(spark, d))
    ranked = running_index(found.withColumn("_all", F.lit(0)), "base_url", "_all", ["place"], "rank")
    return ranked.select("base_url", big(F.col("rank")).alias("rank"), "url")


@query
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    return _robots(spark, d).select(
        "base_url",
        F.array_join("disallowed", ",").alias("disallowed"),
        F.array_join("sitemaps", ",").alias("sitemaps"),
    )


@query
def robots_allowed_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", site_root(F.col("url")).alias("base_url"))
    return crawl.allowed_by_robots(p, _robots(spark, d), "url", "base_url").select("page_id", "base_url")


# --- texts and chunks -------------------------------------------------------
@query
def clean_texts(spark: SparkSession, d: str) -> DataFrame:
    t = text_table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("t"))
    return t.select(
        "doc_id", big(word_count(F.col("t"))).alias("words"), big(F.length("t")).alias("chars"),
        F.md5("t").alias("text_md5"),
    )


@query
def dedupe_keys(spark: SparkSession, d: str) -> DataFrame:
    t = text_table(spark, d, "documents")
    return t.select("doc_id", F.md5(dedupe_key(F.col("text"))).alias("key_md5"))


@query
def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = text_table(spark, d, "documents").select(
        "doc_id", "source", F.md5(dedupe_key(F.col("text"))).alias("key_md5")
    )
    return first_per_key(t, ["source", "key_md5"], [F.col("doc_id")])


@query
def chunk_split_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = text_table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("t"))
    pieces = t.select("doc_id", F.posexplode(chunking.split_words(F.col("t"))).alias("piece", "text"))
    return pieces.select(
        "doc_id", big(F.col("piece")).alias("piece"), big(word_count(F.col("text"))).alias("words"),
        F.md5("text").alias("text_md5"),
    )


def _document_pages(spark: SparkSession, d: str) -> DataFrame:
    return documents_as_pages(text_table(spark, d, "documents"))


@query
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.build_indexed_chunks(_document_pages(spark, d))
    return c.select(
        "chunk_id", "website_id", "source_url", "page_title", "chunk_type",
        big(F.col("chunk_index")).alias("chunk_index"), F.md5("text").alias("text_md5"),
    )


@query
def chunks_by_sql(spark: SparkSession, d: str) -> DataFrame:
    """`chunk_records` written in SQL over a table function for pages."""
    register_chunk_functions(spark)
    name = f"pages_{uuid.uuid4().hex}"
    _document_pages(spark, d).select(
        "website_id", "page_ord", F.col("page_url").alias("source_url"), clean_text(F.col("title")).alias("page_title"),
        F.get("paragraphs", F.lit(0)).alias("body"),
    ).createOrReplaceTempView(name)
    pieces = spark.sql(
        f"""SELECT p.website_id, p.page_ord, p.source_url, p.page_title, c.type_ord, c.chunk_type, c.piece, c.text
        FROM {name} p, LATERAL page_pieces(p.page_title, p.body) c"""
    ).withColumn("key", dedupe_key(F.col("text")))
    digest = F.substring(F.md5(F.concat_ws("|", "website_id", "source_url", "chunk_type", "key")), 1, 16)
    # texts end here: all that is left to do needs their hashes
    pieces = materialize(
        pieces.where("key <> ''").select(
            "website_id", "page_ord", "source_url", "page_title", "type_ord", "chunk_type", "piece", F.md5("key").alias("text_key"),
            F.concat_ws("_", "website_id", digest).alias("chunk_id"), F.md5("text").alias("text_md5"),
        ),
        "sql-pieces",
    )
    at = ["website_id", "page_ord", "type_ord", "piece"]
    winners = first_per_key(pieces.select(*at, "text_key"), ["website_id", "text_key"], [F.col(c) for c in at[1:]])
    numbered = running_index(winners.drop("text_key"), "website_id", "page_ord", ["type_ord", "piece"], "chunk_index")
    return pieces.join(numbered, at).select(
        "chunk_id", "website_id", "source_url", "page_title", "chunk_type", big(F.col("chunk_index")).alias("chunk_index"), "text_md5"
    )


@query
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents through the store: half of them inserted, two thirds upserted with
    another heading, two sites deleted, and all that is left read."""
    kept = ["chunk_id", "website_id", "source_url", "chunk_type", "text", "page_ord"]
    c = materialize(chunking.build_chunks(_document_pages(spark, d)).select(*kept, F.lit("first").alias("state")), "chunks")
    store = ChunkStore(spark, f"{checkpoint_root(spark)}/store-{uuid.uuid4().hex}")
    store.upsert(c.where("page_ord % 2 = 0"))
    store.upsert(c.where("page_ord % 3 <> 0").withColumn("state", F.lit("second")))
    store.delete_sites(c.select("website_id").distinct().orderBy("website_id").limit(2))
    return store.read().select("chunk_id", "website_id", "state", F.md5("text").alias("text_md5"))


@query
def index_summary(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all pages written to a store, counted by type as they are written."""
    store = ChunkStore(spark, f"{checkpoint_root(spark)}/store-{uuid.uuid4().hex}")
    done = index_pages(page_table(text_table(spark, d, "pages")), store, hash_embedder(8))
    if done["errors"]:
        raise RuntimeError("; ".join(done["errors"]))
    rows = [("all", done["chunks_indexed"]), *done["by_type"].items()]
    return spark.createDataFrame(rows, "chunk_type string, chunks bigint")


@query
def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    s = chunking.chunk_summary(chunking.build_chunks(_document_pages(spark, d)))
    shown = F.transform("by_type", lambda t: F.concat_ws("=", t["chunk_type"], t["n"].cast("string")))
    return s.select(
        "website_id", "total_chunks", F.array_join(shown, ",").alias("by_type"), "pages_covered"
    )


# --- queries and scoring ----------------------------------------------------
@query
def query_terms_intents(spark: SparkSession, d: str) -> DataFrame:
    c = text_table(spark, d, "conversations").withColumn("m", match_text(F.col("text")))
    return c.select(
        "conv_id", "turn",
        F.array_join(query_terms(F.col("m")), " ").alias("terms"),
        scoring.classify_intent(F.col("m")).alias("intent"),
        big(scoring.platform_mask(F.col("m"))).alias("platforms"),
    )


@query
def chunk_features(spark: SparkSession, d: str) -> DataFrame:
    """Query-independent signals of every document as one chunk."""
    rows = text_table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        "text",
        F.concat_ws(" ", F.lit("Contact page"), F.col("lang")).alias("page_title"),
        source_site(F.col("source")).alias("source_url"),
        F.when(F.col("lang") == "en", "faq").when(F.col("lang") == "de", "page_summary")
        .when(F.col("lang") == "fr", "structured_data").otherwise("image_context").alias("chunk_type"),
    )
    f = rank.add_features(rows)
    by_intent = {
        f"{label}_{name}": F.get(col, F.lit(i))
        for label, col in (("match", "signals"), ("weight", "type_weights"), ("source", "source_scores"))
        for i, name in enumerate(fixed.INTENTS)
    }
    return f.select(
        F.col("chunk_id").cast("bigint").alias("doc_id"), "quality", "short_summary",
        "under_six_words", "social_url", big(F.col("platforms")).alias("platforms"),
        *[c.alias(n) for n, c in by_intent.items()],
    )


def _turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each question with the next turn of its conversation as the candidate text."""
    c = text_table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    ask = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    reply = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), "text"
    )
    return ask.join(reply, ["conv_id", "turn"])


@query
def rerank_turns(spark: SparkSession, d: str) -> DataFrame:
    """Score every reply as a candidate for its question, all components."""
    pairs = _turn_pairs(spark, d).select(
        F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), "conv_id", "turn", "query", "text",
        F.lit("Support").alias("page_title"), F.lit("https://help.example/contact").alias("source_url"),
        F.lit("paragraph_group").alias("chunk_type"),
        (F.length("text") % 1000 / 1000.0).alias("score"), F.lit(None).cast("double").alias("distance"),
    )
    scored = rank.score_rows(rank.query_side(rank.add_features(pairs)))
    return scored.select(
        "conv_id", "turn", "query_intent", "vector_score", "keyword_overlap", "intent_match",
        "chunk_type_weight", "source_relevance", "content_quality", "penalty", "rerank_score",
    )


def _listed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source as candidates for one question to it; ids repeat over different
    texts, and copies of a text carry different ids."""
    rows = text_table(spark, d, "documents").select(
        "source", "doc_id", F.concat_ws("-", "lang", (F.col("n_chars") % 50).cast("string")).alias("chunk_id"),
        F.concat(F.lit("Where can I find the price and contact email of "), F.col("source")).alias("query"), "text",
        F.lit("Document").alias("page_title"), source_site(F.col("source")).alias("source_url"),
        F.lit("paragraph_group").alias("chunk_type"),
        (F.col("n_chars") % 1000 / 1000.0).alias("score"), F.lit(None).cast("double").alias("distance"),
    )
    return materialize(rank.score_rows(rank.query_side(rank.add_features(rows))), "listed")


@query
def rerank_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Ranking of candidates of which each keeps its id and its text from later ones."""
    kept = rank.rerank_listed(_listed_pairs(spark, d), "source", "doc_id")
    return kept.select("source", big(F.col("rank")).alias("rank"), "doc_id", "rerank_score")


@query
def rerank_debug_record(spark: SparkSession, d: str) -> DataFrame:
    """What a reranking saw and returned, one record per question."""
    pairs = _listed_pairs(spark, d)
    found = rank.rerank_debug(pairs, rank.rerank_listed(pairs, "source", "doc_id"), top_k=5, query="source")
    top = F.transform("top_scores", lambda t: F.concat_ws(":", t["chunk_id"], t["rerank_score"].cast("decimal(12,6)").cast("string")))
    return found.select(
        "source", "query_intent", "input_count", "deduped_count", "final_count", F.array_join(top, " ").alias("top")
    )


# --- embeddings and retrieval -----------------------------------------------
@query
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    t = text_table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("t")).where("t != ''")
    e = t.select("doc_id", hash_embedder(8)(F.col("t")).alias("e"))
    return e.select("doc_id", *[F.get("e", F.lit(i)).alias(f"e{i}") for i in range(8)])


def _label_queries(vectors: DataFrame) -> DataFrame:
    """One query per label: the mean vector of the label."""
    dims = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))
    return packed.select(
        F.col("label").cast("string").alias("qid"),
        F.concat(F.lit("label"), F.col("label")).alias("website_id"),
        F.lit("nearest").alias("query"),
        F.transform("v", lambda x: x["m"]).alias("vector"),
    )


@query
def vector_topk_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Twenty nearest vectors of every label to the label's mean."""
    v = text_table(spark, d, "embeddings")
    stored = v.select(
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"),
        F.concat(F.lit("label"), F.col("label")).alias("website_id"),
        F.lit("section").alias("chunk_type"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
    )
    q = _label_queries(v).withColumn("top_k", F.lit(20))
    near = retrieve.vector_search(retrieve.prepare_queries(q, None, hybrid=False), stored)
    return near.select(
        F.col("qid").cast("int").alias("label"), big(F.col("rank")).alias("rank"),
        big(F.col("chunk_id").cast("bigint")).alias("vec_id"), "score",
    )


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every user turn asks the site its conversation is assigned to."""
    c = text_table(spark, d, "conversations").where("role = 'user'")
    source = F.concat(F.lit("src"), (F.col("conv_id") % SOURCES).cast("string"))
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("qid"),
        urls.website_id(source_site(source)).alias("website_id"),
        F.col("text").alias("query"),
    )


def _features(spark: SparkSession, d: str, *records: str) -> DataFrame:
    """The chunk index of all documents, built once: retrieval reads it several times. It holds what the
    search reads, and `records` of what is shown with a result."""
    searched = ["website_id", "chunk_type", "chunk_id", "embedding", *CHUNK_ORDER, *rank.FEATURES]
    built = searchable_chunks(_document_pages(spark, d), hash_embedder(8))
    return materialize_alone(built.select(*searched, *records), "chunks")


def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = materialize(retrieve.prepare_queries(_questions(spark, d), hash_embedder(8)), "queries")
    return retrieve.hybrid_search(q, _features(spark, d), CHUNK_ORDER)


@query
def hybrid_retrieval(spark: SparkSession, d: str) -> DataFrame:
    results, _ = _hybrid(spark, d)
    return results.select(
        "qid", big(F.col("rank")).alias("rank"), "chunk_id", "query_intent", "rerank_score",
        "vector_score", "keyword_overlap", "intent_match", "chunk_type_weight", "source_relevance",
        "content_quality", "penalty",
    )


@query
def hybrid_candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    _, counts = _hybrid(spark, d)
    return counts


@query
def vector_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Vector search without reranking."""
    q = retrieve.prepare_queries(_questions(spark, d), hash_embedder(8), hybrid=False)
    chunks = embed(chunking.build_chunks(_document_pages(spark, d)), "text", hash_embedder(8))
    return retrieve.vector_search(q, materialize(chunks, "vectors")).select(
        "qid", big(F.col("rank")).alias("rank"), "chunk_id", "score", "distance"
    )


@query
def vector_retrieval_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Vector search restricted to chunk types, as part of the search scope."""
    asked = _questions(spark, d).withColumn("chunk_types", F.array(F.lit("page_summary"), F.lit("faq")))
    q = retrieve.prepare_queries(asked, hash_embedder(8), hybrid=False)
    chunks = embed(chunking.build_chunks(_document_pages(spark, d)), "text", hash_embedder(8))
    return retrieve.vector_search(q, materialize(chunks, "vectors")).select(
        "qid", big(F.col("rank")).alias("rank"), "chunk_id", "score", "distance"
    )


# --- prompt and quality -----------------------------------------------------
def _retrieved_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source as its retrieved chunks, in document order."""
    t = text_table(spark, d, "documents")
    listed = F.col("lang").isin("en", "de")
    return t.select(
        F.col("source").alias("qid"), F.col("doc_id").alias("rank"),
        F.col("doc_id").cast("string").alias("chunk_id"), "text",
        F.when(listed, F.concat(source_site(F.col("source")), F.lit("/"), F.col("lang"))).otherwise("").alias("source_url"),
        F.when(F.col("lang") != "es", F.col("lang")).otherwise("").alias("page_title"),
        F.when(F.col("lang") == "en", "section").otherwise("paragraph_group").alias("chunk_type"),
        F.when(listed, F.col("n_chars") % 100 / 100.0).alias("score"),
        F.when(F.col("lang") == "fr", F.col("n_chars") % 10 / 10.0).alias("distance"),
    )


@query
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    c = prompt.rag_context(_retrieved_by_source(spark, d), SIZES)
    return c.select(
        F.col("qid").alias("source"), big(F.length("context")).alias("chars"), F.md5("context").alias("context_md5")
    )


@query
def format_sources(spark: SparkSession, d: str) -> DataFrame:
    s = prompt.format_sources(_retrieved_by_source(spark, d), SIZES)
    return s.select(
        F.col("qid").alias("source"), big(F.col("source_rank")).alias("source_rank"), "source_url",
        "page_title", "chunk_type", "score", "distance", "text_preview",
    )


@query
def source_validation(spark: SparkSession, d: str) -> DataFrame:
    s = prompt.format_sources(_retrieved_by_source(spark, d), SIZES)
    p = quality.source_problems(s, position="source_rank")
    return p.select(
        F.col("qid").alias("source"), big(F.col("position")).alias("position"),
        big(F.col("ord")).alias("ord"), "message",
    )


@query
def context_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = quality.debug_summary(_retrieved_by_source(spark, d))
    shown = F.transform("chunk_types", lambda t: F.concat_ws("=", t["chunk_type"], t["count"].cast("string")))
    return c.select(
        F.col("qid").alias("source"), "chunks_retrieved", "usable_chunks", "source_count",
        F.array_join(shown, ",").alias("chunk_types"), "missing_source_url_count",
        "missing_page_title_count", "empty_text_count", "total_text_chars", "average_score",
        "average_distance", F.array_join("warnings", " ").alias("warnings"),
    )


def _histories(spark: SparkSession, d: str) -> DataFrame:
    """Every turn with the turns up to it: a conversation as it stood then. The history holds the last
    `HISTORY_MESSAGES` usable turns plus the repeat that is dropped."""
    return prompt.histories(text_table(spark, d, "conversations"), fixed.HISTORY_MESSAGES)


@query
def history_window(spark: SparkSession, d: str) -> DataFrame:
    h = _histories(spark, d).where("role = 'user'")
    kept = prompt.prior_messages(F.col("history"), F.col("text"), SIZES)
    shown = F.transform("kept", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return h.withColumn("kept", kept).select(
        "conv_id", "turn", big(F.size("kept")).alias("messages"),
        F.md5(F.array_join(shown, "\n")).alias("history_md5"),
    )


@query
def latest_user_turn(spark: SparkSession, d: str) -> DataFrame:
    """Latest non-blank user message of each conversation, found without gathering it."""
    c = text_table(spark, d, "conversations").where("role = 'user'")
    usable = c.where(clean_text(F.col("text")) != "")
    last = first_per_key(usable, ["conv_id"], [F.col("turn").desc()])
    one = F.array(F.struct("role", F.col("text").alias("content")))
    return last.select(
        "conv_id", "turn", F.md5(prompt.latest_question(F.lit(""), one)).alias("question_md5")
    )


# --- evaluation -------------------------------------------------------------
def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Every reply as an evaluated answer; the question's properties follow from its ids."""
    p = _turn_pairs(spark, d)
    k = F.col("conv_id") % 5
    forms = F.array(*[F.lit(f) for f in (
        "clickable_link", "grouped_locations", "contact_card", "insufficient_info", "short_summary",
    )])
    kinds = F.array(*[F.lit(c) for c in (
        "social_links", "store_locations", "contact_support", "policies", "general",
    )])
    rows = p.select(
        "conv_id", "turn", F.col("text").alias("answer"),
        F.get(kinds, k.cast("int")).alias("category"), F.get(forms, k.cast("int")).alias("answer_format"),
        F.concat(
            F.lit("Which link, contact number, email or time? "), F.col("query")
        ).alias("question"),
        (F.col("turn") % 4 == 0).alias("requires_source"),
        (F.col("conv_id") % 2 == 0).alias("hallucination_sensitive"),
        F.when(F.col("conv_id") % 3 == 0, "legacy_prompt").otherwise("rag").alias("mode"),
        (F.col("turn") % 3).cast("int").alias("source_count"),
        F.length("text").alias("latency_ms"),
        F.when(F.col("conv_id") % 7 == 0, "N/A").otherwise((F.col("turn") % 3).cast("string")).alias("manual_score"),
    )
    return evaluate.answer_flags(rows)


@query
def answer_flags(spark: SparkSession, d: str) -> DataFrame:
    return _reviewed(spark, d).select(
        "conv_id", "turn", F.array_join("flags", "; ").alias("flags"),
        big(F.col("answer_length")).alias("answer_length"),
        F.array_join("urls", "; ").alias("detected_url"),
        F.array_join("phones", "; ").alias("detected_phone"),
        F.array_join("emails", "; ").alias("detected_email"),
        F.array_join("cities", "; ").alias("detected_cities"),
        "has_bullets", "has_numbered_list", "has_clickable_markdown_link", "says_not_enough_info",
    )


@query
def evaluation_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every question of the conversations answered from its site by a fixed chat function, and reviewed."""
    of = F.split_part("qid", F.lit("-"), F.lit(1)).cast("bigint")
    form = F.element_at(F.array(F.lit("clickable_link"), F.lit("grouped_locations"), F.lit("short_summary")), (of % 3 + 1).cast("int"))
    none = F.lit(None).cast("string")
    bank = _questions(spark, d).where(clean_text(F.col("query")) != "").select(
        F.col("qid").alias("id"), "website_id", F.col("query").alias("question"), F.lit("general").alias("category"),
        none.alias("intent"), none.alias("expected_behavior"), form.alias("answer_format"), F.lit(True).alias("requires_source"),
        (of % 2 == 0).alias("hallucination_sensitive"), F.array().cast("array<string>").alias("expected_entities"),
    )
    chat = lambda ms: F.concat(F.lit("You asked: "), F.element_at(ms, -1)["content"], F.lit(" Write to help@shop.example."))
    records = evaluate_bank(materialize(bank, "bank"), _features(spark, d, *retrieve.RECORD), hash_embedder(8), chat, SIZES, CHUNK_ORDER)
    return records.select(
        "question_id", "mode", big(F.col("source_count")).alias("source_count"), F.md5("answer").alias("answer_md5"),
        F.array_join("flags", "; ").alias("flags"), "detected_email",
    )


@query
def document_detections(spark: SparkSession, d: str) -> DataFrame:
    """The answer detectors over whole documents, which hold contacts and lists."""
    t = text_table(spark, d, "documents")
    found = t.withColumns(evaluate.detect(F.col("text")))
    return found.select(
        "doc_id",
        F.array_join("urls", "; ").alias("detected_url"),
        F.array_join("phones", "; ").alias("detected_phone"),
        F.array_join("emails", "; ").alias("detected_email"),
        F.array_join("cities", "; ").alias("detected_cities"),
        "has_bullets", "has_numbered_list", "has_clickable_markdown_link",
        "has_time_like_pattern", "says_not_enough_info",
    )


@query
def answer_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _reviewed(spark, d).withColumns(
        {"has_raw_url": F.size("urls") > 0, "detected_url": F.array_join("urls", "; ")}
    )
    return evaluate.summarize(rows)


@query
def event_summary(spark: SparkSession, d: str) -> DataFrame:
    """Latency report over the event log: type as category, value as latency."""
    e = table(spark, d, "events").select(
        F.col("event_type").alias("category"), F.col("value").alias("latency_ms"),
        F.col("props").alias("answer"),
        F.when(F.col("event_type") == "error", "failed").otherwise("").alias("error"),
    )
    s = evaluate.summarize(e)
    return s.select("category", "total_questions", "answer_count", "error_count", "average_latency_ms")


# --- HTML -------------------------------------------------------------------
def _extracted(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return page_table(text_table(spark, d, "pages")).select(F.col("page_ord").alias("page_id"), *columns)


def _unrolled(df: DataFrame, key: str, items: str, item: str) -> DataFrame:
    """One row per array element. The outer form keeps the optimizer from filtering on the
    array first, which would compute the extraction twice."""
    rows = df.select(key, F.posexplode_outer(items).alias("pos", item))
    return rows.where("pos is not null")


@query
def html_metadata(spark: SparkSession, d: str) -> DataFrame:
    p = _extracted(spark, d, "title", "description", "metadata", "structured_data", "images")
    return p.select(
        "page_id", "title", "description", F.col("metadata.canonical").alias("canonical"),
        big(F.size("structured_data")).alias("structured"), big(F.size("images")).alias("images"),
    )


@query
def html_headings(spark: SparkSession, d: str) -> DataFrame:
    p = _unrolled(_extracted(spark, d, "headings"), "page_id", "headings", "h")
    return p.select("page_id", big(F.col("pos")).alias("pos"), big(F.col("h.level")).alias("level"), F.col("h.text").alias("text"))


@query
def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = _unrolled(_extracted(spark, d, "paragraphs"), "page_id", "paragraphs", "t")
    return p.select("page_id", big(F.col("pos")).alias("pos"), F.md5("t").alias("text_md5"))


@query
def html_lists(spark: SparkSession, d: str) -> DataFrame:
    p = _unrolled(_extracted(spark, d, "lists"), "page_id", "lists", "l")
    return p.select(
        "page_id", big(F.col("pos")).alias("pos"), F.col("l.type").alias("type"),
        F.array_join("l.items", "|").alias("items"),
    )


@query
def html_links(spark: SparkSession, d: str) -> DataFrame:
    p = _unrolled(_extracted(spark, d, "links"), "page_id", "links", "l")
    return p.select("page_id", big(F.col("pos")).alias("pos"), "l.text", "l.url", "l.is_internal")


@query
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    p = _unrolled(_extracted(spark, d, "sections"), "page_id", "sections", "s")
    return p.select(
        "page_id", big(F.col("pos")).alias("pos"), big(F.col("s.level")).alias("level"),
        F.col("s.heading").alias("heading"), F.md5("s.content").alias("content_md5"),
    )


@query
def html_content_quality(spark: SparkSession, d: str) -> DataFrame:
    p = _extracted(spark, d, "content", "quality")
    return p.select(
        "page_id", F.md5("content").alias("content_md5"),
        big(F.col("quality.content_length")).alias("content_length"), "quality.useful_text_score",
        big(F.col("quality.image_count")).alias("image_count"), big(F.col("quality.link_count")).alias("link_count"),
    )


@query
def render_decision(spark: SparkSession, d: str) -> DataFrame:
    p = page_table(text_table(spark, d, "pages"))
    weak = needs_browser(
        F.col("html_empty"), F.col("has_hydration"), F.col("quality.content_length"), F.size("paragraphs"),
        F.col("title"), F.col("has_spa_root"), F.col("script_count"), F.col("body_chars"),
    )
    return p.select(F.col("page_ord").alias("page_id"), weak.alias("needs_browser"))


# --- pages written from the columns of whole documents -------------------------------
def _rich_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a page with metadata, a table, questions, an image and a social link."""
    t = text_table(spark, d, "documents")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.format_string(
        '<html><head><title>Document %1$s</title><meta name="description" content="About %1$s from %2$s">'
        '<link rel="canonical" href="/c/%1$s"><meta property="og:title" content="Open %3$s %1$s">'
        '<meta name="twitter:card" content="Card %2$s"><script type="application/ld+json">{"n": %1$s, "@type": "Thing"}</script>'
        '</head><body><nav><p>Menu</p></nav><article><h1>Head %1$s</h1><p>%5$s</p>'
        '<table><tr><th>Source</th><th>Size</th></tr><tr><td>%2$s</td><td>%4$s</td></tr></table>'
        '<details><summary>What is %1$s?</summary><p>A text from %2$s.</p></details>'
        '<h2>How large is %1$s?</h2><p>It has %4$s characters.</p>'
        '<img src="/i/%1$s.png" alt="A wide view of document %1$s" width="640" height="480">'
        '<a href="https://www.instagram.com/%2$s">Instagram</a></article></body></html>',
        F.col("doc_id").cast("string"), "source", "lang", F.col("n_chars").cast("string"), escaped,
    )
    page_url = F.concat(source_site(F.col("source")), F.lit("/d/"), F.col("doc_id"))
    return extract_pages(t.select("doc_id", page_url.alias("page_url"), html.alias("html")))


def _illustrated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a page with several images, a ragged table, a question, links and
    embedded JSON that holds more JSON."""
    t = text_table(spark, d, "documents")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    room = "<p>Shown in room %4$s today</p></section>"
    html = F.format_string(
        '<html><head><title>Atlas %1$s</title><script type="application/ld+json">{"@type": "Organization", "sameAs": '
        '["https://www.facebook.com/%2$s", "https://blog.example/%1$s"], "more": "{\\"u\\": \\"https://youtu.be/%1$s\\"}"}</script></head>'
        "<body><article><h1>Atlas %1$s</h1><p>%5$s</p>"
        '<section><div><img src="data:image/gif;base64,AA" data-src="/l/%1$s.jpg" alt="Short"></div>' + room +
        '<section><div><img src="/l/%1$s.jpg" alt="A view over the old harbour of document %1$s" title="Harbour"></div>' + room +
        '<section><figure><picture><source srcset="/p/%1$s.webp 1x, /p/%1$s-big.webp 2x"><img src="data:image/gif;base64,AA" width="800" height="600">'
        "</picture><figcaption>Plate %1$s of %2$s</figcaption></figure></section>"
        '<section><div><img src="/logo-%1$s.png" alt="Logo of %2$s"></div>' + room +
        '<section><div><img src="/pixel-%1$s.png" width="1" height="1" alt="a dot that counts visits"></div>' + room +
        '<section><div><img srcset="/s/%1$s.png 320w, /s/%1$s-2.png 640w" alt="Size guide for %2$s" style="width: 640px; height: 480.5px"></div>' + room +
        "<table><tr><th>Source</th><th> </th><th>Size</th></tr><tr><td>%2$s</td><td></td><td>%4$s</td></tr><tr><td> </td></tr><tr><td>only %1$s</td></tr></table>"
        "<details><summary>Where is %1$s?</summary><p>In the atlas of %2$s.</p></details>"
        '<a href="https://www.instagram.com/%2$s">Insta</a> <a href="https://e.example/%1$s">Twitter</a> <a href="/plain">Plain</a>'
        "</article></body></html>",
        F.col("doc_id").cast("string"), "source", "lang", F.col("n_chars").cast("string"), escaped,
    )
    page_url = F.concat(source_site(F.col("source")), F.lit("/a/"), F.col("doc_id"))
    return extract_pages(t.select("doc_id", page_url.alias("page_url"), html.alias("html"), source_site(F.col("source")).alias("website_url")))


@query
def rich_image_choice(spark: SparkSession, d: str) -> DataFrame:
    """Images of pages that hold lazy, repeated, framed, sized and useless ones."""
    rows = _unrolled(_illustrated_pages(spark, d).select("doc_id", "images"), "doc_id", "images", "i")
    return rows.select(
        "doc_id", big(F.col("pos")).alias("pos"), "i.src", "i.absolute_url", "i.alt", "i.title", "i.figcaption", "i.nearby_text",
        big(F.col("i.width")).alias("width"), big(F.col("i.height")).alias("height"), "i.image_type",
    )


@query
def builder_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the question, table, image, social and structured-data builders."""
    pages = materialize(chunking.chunk_input(_illustrated_pages(spark, d).withColumn("page_ord", F.col("doc_id"))), "illustrated")
    pages = pages.withColumns({"website_id": urls.website_id(F.col("website_url")), "normalized_website_url": F.col("website_url")})
    c = chunking.build_chunks(pages).where(F.col("chunk_type").isin("faq", "table", "image_context", "social_link", "structured_data"))
    return c.select(
        F.col("page_ord").alias("doc_id"), "chunk_id", "source_url", "chunk_type", big(F.col("item")).alias("item"), "text",
        F.col("metadata.heading").alias("heading"), F.coalesce("metadata.image_url", F.lit("")).alias("image_url"),
        F.coalesce("metadata.social_platform", F.lit("")).alias("platform"), F.coalesce("metadata.source_kind", F.lit("")).alias("source_kind"),
    )


@query
def rich_metadata(spark: SparkSession, d: str) -> DataFrame:
    p = _rich_pages(spark, d)
    return p.select(
        "doc_id", "title", "description", F.col("metadata.canonical").alias("canonical"),
        F.col("metadata.open_graph")["title"].alias("og_title"), F.col("metadata.twitter")["card"].alias("twitter_card"),
        F.array_join("structured_data", "|").alias("structured"),
    )


@query
def rich_tables(spark: SparkSession, d: str) -> DataFrame:
    rows = _unrolled(_rich_pages(spark, d).select("doc_id", "tables"), "doc_id", "tables", "t")
    cells = F.transform("t.rows", lambda r: F.array_join(r, "|"))
    return rows.select(
        "doc_id", big(F.col("pos")).alias("pos"), F.array_join("t.headers", "|").alias("headers"),
        F.array_join(cells, ";").alias("cells"),
    )


@query
def rich_faqs(spark: SparkSession, d: str) -> DataFrame:
    rows = _unrolled(_rich_pages(spark, d).select("doc_id", "faqs"), "doc_id", "faqs", "q")
    return rows.select("doc_id", big(F.col("pos")).alias("pos"), "q.question", "q.answer")


@query
def rich_images(spark: SparkSession, d: str) -> DataFrame:
    rows = _unrolled(_rich_pages(spark, d).select("doc_id", "images"), "doc_id", "images", "i")
    return rows.select(
        "doc_id", big(F.col("pos")).alias("pos"), "i.absolute_url", "i.alt",
        big(F.col("i.width")).alias("width"), big(F.col("i.height")).alias("height"),
    )


@query
def rich_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = _unrolled(_rich_pages(spark, d).select("doc_id", "paragraphs"), "doc_id", "paragraphs", "p")
    return rows.select("doc_id", big(F.col("pos")).alias("pos"), F.md5("p").alias("text_md5"))


@query
def discovered_links(spark: SparkSession, d: str) -> DataFrame:
    """Crawl selection over the links found in each site's pages."""
    p = page_table(text_table(spark, d, "pages"))
    site = F.struct("website_url", "page_ord").alias("site")
    found = _unrolled(p.select(site, "links"), "site", "links", "l")
    candidates = found.select(
        F.col("site.website_url").alias("base_url"), F.col("l.url").alias("url"),
        F.struct("site.page_ord", "pos").alias("pos"), F.col("l.text").alias("anchor_text"),
    )
    return crawl.select_candidates(candidates, fixed.MAX_PAGES_PER_SITE - 1)


def _anchor_rows(p: DataFrame) -> DataFrame:
    site = F.struct("website_url", "page_ord").alias("site")
    found = _unrolled(p.select(site, "anchors"), "site", "anchors", "l")
    return found.select(
        F.col("site.website_url").alias("base_url"), F.col("site.page_ord").alias("page_ord"), "pos",
        F.col("l.url").alias("url"), F.col("l.text").alias("anchor_text"),
    )


@query
def anchor_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every link of every page as delivered, first per normalised URL."""
    rows = _anchor_rows(page_table(text_table(spark, d, "pages")))
    return rows.select(F.col("page_ord").alias("page_id"), big(F.col("pos")).alias("pos"), "url", F.col("anchor_text").alias("text"))


@query
def discovered_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Links of all pages of a site and the URLs that its sitemaps list, to one selection that
    its robots file allows."""
    p = materialize(page_table(text_table(spark, d, "pages")).select("website_url", "page_ord", "anchors"), "pages")
    robots = materialize(_robots(spark, d), "robots")
    sites = p.select(F.col("website_url").alias("base_url")).distinct().withColumn("_root", site_root(F.col("base_url")))
    seeds = sites.join(robots.select(F.col("base_url").alias("_root"), "sitemaps"), "_root", "left").drop("_root")
    listed = walk_sitemaps(seeds, _sitemaps(spark, d)).select("base_url", "url")
    return discover(_anchor_rows(p), listed, robots, max_pages=9)


@query
def crawl_to_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the pages that links, sitemaps and robots files lead to, selected and indexed in one job."""
    robots = materialize(_robots(spark, d), "robots")
    store = ChunkStore(spark, f"{checkpoint_root(spark)}/store-{uuid.uuid4().hex}")
    done = crawl_job(text_table(spark, d, "pages"), robots, _sitemaps(spark, d), store, hash_embedder(8), max_pages=60)
    if done["errors"]:
        raise RuntimeError("; ".join(done["errors"]))
    if not store.exists():  # no page was selected
        return spark.createDataFrame([], "website_id string, chunk_type string, chunks bigint, pages bigint")
    return store.read().groupBy("website_id", "chunk_type").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("source_url").alias("pages"))


@query
def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Web pages to indexed chunks, all builders."""
    pages = materialize(chunking.chunk_input(page_table(text_table(spark, d, "pages"))), "pages")
    c = chunking.build_indexed_chunks(pages)
    return c.select(
        "chunk_id", "website_id", "source_url", "chunk_type", big(F.col("chunk_index")).alias("chunk_index"),
        F.col("metadata.heading").alias("heading"), F.md5("text").alias("text_md5"),
    )


@query
def site_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Text context of every site for a whole-site prompt, with the whole text of each page that is in it."""
    pages = materialize(page_table(text_table(spark, d, "pages")), "pages")
    sites = pages.select("website_id", F.col("website_url").alias("url"), F.col("website_url").alias("name")).distinct()
    # the pages of a prompt: one homepage, five key pages, three blog pages
    c = knowledge.chatbot_context(pages, sites, knowledge.TextSizes(), key_pages=5, blog_pages=3)
    return c.select("website_id", big(F.length("context")).alias("chars"), F.md5("context").alias("context_md5"))


@query
def knowledge_documents(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge of every site, whole: each page with its site's metadata."""
    pages = materialize(page_table(text_table(spark, d, "pages")), "pages")
    sites = pages.select("website_id", F.col("website_url").alias("url"), F.lit("").alias("name")).distinct()
    meta, rows = knowledge.knowledge_tables(sites, pages)
    return rows.join(meta, "website_id").select(
        "website_id", "url", "normalized_url", big(F.col("pages_scraped")).alias("pages_scraped"),
        F.col("page_ord").alias("page_id"), F.col("legacy.url").alias("page_url"),
        F.col("legacy.title").alias("title"), F.md5("legacy.content").alias("content_md5"),
    )


@query
def knowledge_files(spark: SparkSession, d: str) -> DataFrame:
    """One document per site, written, found again by the URL of every page's site and read by line."""
    pages = materialize(page_table(text_table(spark, d, "pages")), "pages")
    sites = pages.select("website_id", F.col("website_url").alias("url"), F.lit("").alias("name")).distinct()
    folder = f"{checkpoint_root(spark)}/sites-{uuid.uuid4().hex}"
    written = materialize(site_files.write_site_files(sites, pages, folder), "written")
    asked = sites.select("website_id", "url")
    found, stored = site_files.cached_pages(spark, asked, folder)
    named = found.join(written.select(F.col("name").alias("cached_name"), "pages"), "cached_name")
    return stored.drop("website_id").join(named.withColumnRenamed("cached_name", "name"), "name").select(
        "website_id", "name", big(F.col("pages")).alias("pages"), F.col("page_ord").alias("page_id"), "page_url", "title",
        F.md5("content").alias("content_md5"),
    )


@query
def event_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and type from a stream in which every tenth event comes twice."""
    schema = table(spark, d, "events").schema
    twice = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = stream_table(spark, d, "events.parquet", schema).withColumn("copy", F.explode(twice)).drop("copy")
    metrics = [
        F.count(F.lit(1)).alias("events"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"),
        F.count_if(F.trim("props") != "").alias("with_props"),
    ]
    found = windowed_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], ["event_type"], "ts", metrics, delay="400 days")
    return found.select(F.col("starts").cast("timestamp_ntz").alias("starts"), "event_type", "events", F.col("total").cast("double").alias("total"), "with_props")


# --- flagship ---------------------------------------------------------------
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents -> chunks -> vectors -> hybrid retrieval -> cited results, for every question."""
    found = retrieve_chunks(_questions(spark, d), _features(spark, d, *retrieve.RECORD), hash_embedder(8), CHUNK_ORDER)
    return found.select(
        "qid", "rank", "chunk_id", "query_intent", "rerank_score", "page_title", "source_url", "chunk_type"
    )
