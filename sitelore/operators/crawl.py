"""Crawl-candidate selection: normalise, filter, deduplicate, rank, cut, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore import fixed
from sitelore.functions import urls
from sitelore.functions.binding import built_once, let
from sitelore.functions.text import strip
from sitelore.operators.skew import sliced_join, top_per_key


def with_url_parts(df: DataFrame, url: str, prefix: str) -> DataFrame:
    """Add `<prefix>scheme|netloc|path|query` of a URL column."""
    c = F.col(url)
    return df.withColumns(
        {
            f"{prefix}scheme": urls.scheme_of(c),
            f"{prefix}netloc": urls.netloc_of(c),
            f"{prefix}path": urls.path_of(c),
            f"{prefix}query": urls.query_of(c),
        }
    )


def classify_pages(df: DataFrame, url: str = "url") -> DataFrame:
    """Normalised URL, page type, depth and whole-site priority of each page URL."""
    staged = df.withColumn("normalized_url", urls.crawl_url(F.col(url)))
    staged = with_url_parts(staged, "normalized_url", "_u_")
    staged = staged.withColumn("page_type", urls.page_type(F.col("_u_path"), F.col("_u_query")))
    return staged.select(
        *df.columns,
        "normalized_url",
        "page_type",
        urls.path_depth(F.col("_u_path")).cast("bigint").alias("depth"),
        urls.priority_score(F.col("_u_path"), F.col("_u_query"), F.col("page_type"))
        .cast("bigint")
        .alias("priority"),
    )


def judge_candidates(candidates: DataFrame) -> DataFrame:
    """One row per (base_url, distinct normalised candidate) with its verdict and score.

    Input: base_url, url, pos, anchor_text. Repeats are counted, not kept: the
    rules only look at the URL, so they run once per distinct URL, and the
    aggregation combines repeats before the shuffle.
    """
    normalized = candidates.select(
        urls.crawl_url(F.col("base_url")).alias("base"),
        urls.crawl_url(F.col("url")).alias("candidate"),
        F.coalesce(F.col("anchor_text"), F.lit("")).alias("anchor_text"),
        "pos",
    )
    distinct = normalized.groupBy("base", "candidate").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min_by("anchor_text", "pos").alias("anchor_text"),
    )
    return distinct.withColumn("_j", built_once("crawl.judgement", _judgement)).select(
        "base", "candidate", "copies", "_j.*"
    )


def _judgement() -> Column:
    """struct<intent, verdict, score, depth> of columns base, candidate, anchor_text.

    One bound expression: later filters on the verdict copy a reference, not the rules.
    """
    candidate, base = F.col("candidate"), F.col("base")
    parts = F.struct(
        candidate.alias("url"),
        base.alias("base"),
        F.col("anchor_text").alias("anchor_text"),
        urls.scheme_of(candidate).alias("scheme"),
        urls.netloc_of(candidate).alias("netloc"),
        urls.path_of(candidate).alias("path"),
        urls.query_of(candidate).alias("query"),
        urls.netloc_of(base).alias("base_netloc"),
        urls.path_of(base).alias("base_path"),
    )

    def judge(u: Column) -> Column:
        path, query, base_path = u["path"], u["query"], u["base_path"]
        intent = urls.crawl_intent(base_path)
        specific = intent == fixed.CRAWL_SPECIFIC
        crawlable = urls.is_crawlable(u["scheme"], u["netloc"], path, query, u["base_netloc"])
        verdict = (
            F.when(u["url"] == "", F.lit("rejected"))
            .when(u["url"] == u["base"], F.lit("base"))
            .when(~crawlable, F.lit("rejected"))
            .when(specific & urls.is_utility_page(path, query, base_path), F.lit("utility"))
            .otherwise(F.lit("kept"))
        )
        own = let(urls.page_type(path, query), lambda kind: urls.priority_score(path, query, kind))
        score = F.when(
            specific, urls.specific_score(path, query, base_path, u["anchor_text"])
        ).otherwise(own)
        return F.struct(
            intent.alias("intent"),
            verdict.alias("verdict"),
            score.cast("bigint").alias("score"),
            urls.path_depth(path).cast("bigint").alias("depth"),
        )

    return let(parts, judge)


def _base_rows(sites: DataFrame, include_homepage: bool) -> DataFrame:
    """The base page itself takes part when asked for or in a specific-page crawl."""
    base = sites.select(urls.crawl_url(F.col("base_url")).alias("base")).where("base != ''").distinct()
    parts = with_url_parts(base, "base", "b_")
    parts = parts.withColumn("intent", urls.crawl_intent(F.col("b_path")))
    kind = urls.page_type(F.col("b_path"), F.col("b_query"))
    own = urls.priority_score(F.col("b_path"), F.col("b_query"), kind)
    rows = parts.select(
        "base", F.col("base").alias("candidate"), "intent",
        F.when(F.col("intent") == fixed.CRAWL_SPECIFIC, F.lit(10000)).otherwise(own)
        .cast("bigint").alias("score"),
        F.lit(0).cast("bigint").alias("depth"),
    )
    return rows if include_homepage else rows.where(F.col("intent") == fixed.CRAWL_SPECIFIC)


def select_candidates(
    candidates: DataFrame, max_pages: int, include_homepage: bool = False
) -> DataFrame:
    """base_url, rank, url, score, depth: the best `max_pages` URLs of every site."""
    kept = judge_candidates(candidates).where("verdict = 'kept'").select(
        "base", "candidate", "intent", "score", "depth"
    )
    pool = kept.unionByName(_base_rows(candidates, include_homepage))
    ranked = top_per_key(
        pool, ["base"], [F.col("score").desc(), F.col("depth"), F.col("candidate")], max_pages
    )
    return ranked.select(
        F.col("base").alias("base_url"),
        F.col("rank").cast("bigint").alias("rank"),
        F.col("candidate").alias("url"),
        "score", "depth",
    )


def selection_counts(candidates: DataFrame, include_homepage: bool = False) -> DataFrame:
    """Per site: crawl intent, filtered, utility-filtered and candidate counts."""
    judged = judge_candidates(candidates)

    def copies(*verdicts: str) -> Column:
        return F.sum(F.when(F.col("verdict").isin(*verdicts), F.col("copies")).otherwise(0))

    counts = judged.groupBy("base").agg(
        F.max("intent").alias("crawl_intent"),
        copies("rejected", "utility").alias("filtered_count"),
        copies("utility").alias("utility_filtered_count"),
        F.count_if(F.col("verdict") == "kept").alias("kept"),
    )
    own = (F.col("crawl_intent") == fixed.CRAWL_SPECIFIC) | F.lit(include_homepage)
    base_counted = F.when(own & (F.col("base") != ""), 1).otherwise(0)
    return counts.select(
        F.col("base").alias("base_url"), "crawl_intent", "filtered_count",
        "utility_filtered_count",
        (F.col("kept") + base_counted + F.col("filtered_count")).alias("candidate_count"),
    )


# --- robots.txt -------------------------------------------------------------
def parse_robots(robots: DataFrame, text: str = "robots_text", agents: list[str] | None = None) -> DataFrame:
    """Add `disallowed` (path prefixes for our agents) and `sitemaps` to robots files.

    One file is one row, so the agent in force is carried along by folding over
    the file's lines; nothing is shuffled.
    """
    wanted = [a.lower() for a in (agents or ["*"])]
    lines = F.transform(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n"), strip)
    start = F.struct(F.lit("").alias("agent"), F.array().cast("array<string>").alias("rules"))

    def value(line: Column) -> Column:
        return strip(F.regexp_replace(line, "^[^:]*:", ""))

    folded = F.aggregate(
        lines,
        start,
        lambda acc, line: F.when(
            line.startswith("user-agent:"),
            F.struct(value(line).alias("agent"), acc["rules"].alias("rules")),
        )
        .when(
            line.startswith("disallow:") & acc["agent"].isin(wanted) & (value(line) != ""),
            F.struct(
                acc["agent"].alias("agent"),
                F.array_append(acc["rules"], value(line)).alias("rules"),
            ),
        )
        .otherwise(acc),
    )
    raw_lines = F.transform(
        F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"),
        strip,
    )
    directives = F.filter(raw_lines, lambda l: l.rlike(r"(?i)^sitemap[\s\p{Z}]*:") )
    sitemaps = F.filter(F.transform(directives, value), lambda u: u != "")
    return robots.withColumns(
        {"disallowed": F.array_distinct(folded["rules"]), "sitemaps": sitemaps}
    )


def allowed_by_robots(pages: DataFrame, rules: DataFrame, url: str, key: str) -> DataFrame:
    """Keep pages whose lower-case path starts with no disallowed prefix of their site.

    `rules` has one row per `key` (one robots file per host), so no path meets the prefixes
    of another site. Hosts with very many pages are joined in slices.
    """
    path = F.lower(urls.path_of(F.col(url)))
    joined = sliced_join(pages, rules.select(key, "disallowed"), [key], [url], how="left")
    blocked = let(path, lambda own: F.exists(F.col("disallowed"), lambda p: F.startswith(own, p)))
    return joined.where(~F.coalesce(blocked, F.lit(False))).drop("disallowed")
