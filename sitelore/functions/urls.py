"""URL parts, normal forms, page types and priorities as column expressions.

`parse_url` is not used: it rejects URLs that crawls contain (spaces, odd
escapes). The generic-syntax split below never fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelore import fixed
from sitelore.functions.binding import let
from sitelore.functions.text import blank_if_null, contains_any, has_any, strip

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


# --- parts ------------------------------------------------------------------
def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def _after_scheme(url: Column) -> Column:
    return F.regexp_replace(url, SCHEME, "")


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^//([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    """Path without the `;parameters` of its last segment."""
    path = F.regexp_extract(_after_scheme(url), r"^(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def host_of(netloc: Column) -> Column:
    """Host name: user info and port removed, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":[^:\]]*$", ""))


def canonical_domain(netloc: Column) -> Column:
    """Lower case, default port and leading `www.` removed."""
    return F.regexp_replace(strip_default_port(netloc), r"^www\.", "")


def strip_default_port(netloc: Column) -> Column:
    return F.regexp_replace(F.lower(blank_if_null(netloc)), r":(443|80)$", "")


def path_segments(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "/"), lambda s: s != "")


def path_tokens(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "[/_-]+"), lambda s: s != "")


def path_depth(path: Column) -> Column:
    return F.size(path_segments(path))


# --- query strings ----------------------------------------------------------
def _escape_stray_percent(c: Column) -> Column:
    return F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")


def decode_form(c: Column) -> Column:
    """Form decoding; a `%` that starts no escape stays as it is."""
    return F.coalesce(F.try_url_decode(_escape_stray_percent(c)), c)


def encode_form(c: Column) -> Column:
    """Form encoding that keeps `~` and escapes `*`."""
    encoded = F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """array<struct<k,v>> in query order, decoded, blank values kept."""
    return F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            decode_form(F.substring_index(p, "=", 1)).alias("k"),
            F.when(
                F.contains(p, F.lit("=")),
                decode_form(F.regexp_replace(p, "^[^=]*=", "")),
            ).otherwise(F.lit("")).alias("v"),
        ),
    )


def clean_query(query: Column) -> Column:
    """Tracking keys dropped, pairs sorted, re-encoded."""

    def cleaned(q: Column) -> Column:
        kept = F.filter(
            query_pairs(q),
            lambda p: ~(
                F.lower(p.k).startswith(fixed.TRACKING_QUERY_PREFIX)
                | F.lower(p.k).isin(fixed.TRACKING_QUERY_KEYS)
            ),
        )
        encoded = F.transform(
            F.array_sort(kept),
            lambda p: F.concat(encode_form(p.k), F.lit("="), encode_form(p.v)),
        )
        return F.when(q == "", F.lit("")).otherwise(F.array_join(encoded, "&"))

    return let(query, cleaned)


# --- normal forms -----------------------------------------------------------
def _normalize(url: Column, force_https: bool) -> Column:
    def parts(full: Column) -> Column:
        scheme = scheme_of(full)
        if force_https:
            scheme = F.when(scheme == "http", F.lit("https")).otherwise(scheme)
        return F.struct(
            scheme.alias("scheme"),
            strip_default_port(netloc_of(full)).alias("netloc"),
            F.regexp_replace(path_of(full), "/+$", "").alias("path"),
            clean_query(query_of(full)).alias("query"),
        )

    def joined(p: Column) -> Column:
        scheme, netloc, path, query = p["scheme"], p["netloc"], p["path"], p["query"]
        rootless = (path != "") & ~path.startswith("/")
        location = (
            F.when(
                netloc != "",
                F.concat(
                    F.lit("//"), netloc, F.when(rootless, F.lit("/")).otherwise(F.lit("")), path
                ),
            )
            .when(scheme.isin("http", "https", "ftp", "file") & ~rootless, F.concat(F.lit("//"), path))
            .otherwise(path)
        )
        tail = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
        return F.concat(scheme, F.lit(":"), location, tail)

    def normal(raw: Column) -> Column:
        full = F.when(raw.rlike(SCHEME), raw).otherwise(F.concat(F.lit("https://"), raw))
        return F.when(raw == "", F.lit("")).otherwise(let(let(full, parts), joined))

    return let(strip(url), normal)


def crawl_url(url: Column) -> Column:
    """Normal form of a crawl candidate; the scheme is kept."""
    return _normalize(url, force_https=False)


def cache_url(url: Column) -> Column:
    """Normal form that identifies a site or page: http and https are one."""
    return _normalize(url, force_https=True)


def website_id(normalized_url: Column) -> Column:
    return F.substring(F.md5(blank_if_null(normalized_url)), 1, 12)


def cache_name(normalized_url: Column) -> Column:
    """File name of a site's knowledge document."""
    host = F.replace(netloc_of(normalized_url), F.lit("www."), F.lit(""))
    slug = F.regexp_replace(
        F.regexp_replace(F.lower(host), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )
    slug = F.when(slug == "", F.lit("website")).otherwise(slug)
    return F.concat(slug, F.lit("_"), website_id(normalized_url), F.lit(".json"))


def legacy_cache_name(url: Column) -> Column:
    """Older file name: host with underscores plus the hash of the raw URL."""
    host = F.replace(F.replace(netloc_of(url), F.lit("www."), F.lit("")), F.lit("."), F.lit("_"))
    return F.concat(host, F.lit("_"), F.substring(F.md5(url), 1, 12), F.lit(".json"))


# --- predicates -------------------------------------------------------------
def is_root(path: Column) -> Column:
    return path.isin("", "/")


def has_search_query(query: Column) -> Column:
    keys = F.transform(query_pairs(query), lambda p: F.lower(p.k))
    return (query != "") & has_any(keys, fixed.SEARCH_QUERY_KEYS)


def is_search_path(path: Column) -> Column:
    return has_any(path_segments(path), fixed.SEARCH_PATH_SEGMENTS)


def has_keyword(path: Column, keywords: list[str]) -> Column:
    """Keyword anywhere in the path once separators are removed.

    Removing every separator also covers the spaced form: a spaced match always
    remains a match after the spaces go.
    """
    compact = F.regexp_replace(F.lower(path), "[^a-z0-9]+", "")
    return contains_any(compact, [k.replace("-", "").replace("_", "") for k in keywords])


def unquote_path(path: Column) -> Column:
    """Percent-decoding where `+` stays `+`."""
    plus_kept = F.replace(_escape_stray_percent(path), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plus_kept), path)


def token_set(text: Column) -> Column:
    """Distinct meaningful tokens of lower-case text."""
    return F.array_distinct(
        F.filter(
            F.split(F.lower(blank_if_null(text)), "[^a-z0-9]+"),
            lambda t: (F.length(t) > 1) & ~t.isin(fixed.URL_TOKEN_STOPWORDS),
        )
    )


def meaningful_tokens(path: Column) -> Column:
    return token_set(unquote_path(path))


def _raw_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _is_wiki(path: Column) -> Column:
    segments = _raw_segments(path)
    return (F.size(segments) >= 2) & (F.lower(F.get(segments, F.lit(0))) == "wiki")


def is_wiki_namespace(path: Column) -> Column:
    segments = _raw_segments(path)
    title = F.lower(unquote_path(F.array_join(F.slice(segments, F.lit(2), F.size(segments)), "/")))
    return _is_wiki(path) & title.rlike("^(" + "|".join(fixed.WIKI_NAMESPACES) + "):")


def is_wiki_content(path: Column) -> Column:
    return _is_wiki(path) & ~is_wiki_namespace(path)


def page_type(path: Column, query: Column) -> Column:
    """Coarse page type, first matching rule."""
    tokens = path_tokens(path)
    kind = (
        F.when(is_search_path(path) | has_search_query(query), F.lit("search_result"))
        .when(is_root(path) & (query != ""), F.lit("query"))
        .when(is_root(path), F.lit("homepage"))
    )
    for name, values in fixed.PAGE_TYPE_TOKENS:
        kind = kind.when(has_any(tokens, values), F.lit(name))
    return kind.when(is_wiki_namespace(path), F.lit("wiki_meta")).otherwise(F.lit("other"))


def priority_score(path: Column, query: Column, kind: Column) -> Column:
    """Whole-site crawl: valuable page types first, shallow first, no queries."""
    base = (
        F.when(kind == "homepage", 1000)
        .when(kind.isin(fixed.HIGH_VALUE_PAGE_TYPES), 900)
        .when(
            kind.isin(fixed.MEDIUM_VALUE_PAGE_TYPES)
            | has_keyword(path, fixed.MEDIUM_PRIORITY_KEYWORDS),
            600,
        )
        .when((kind == "legal") | has_keyword(path, fixed.LOW_PRIORITY_KEYWORDS), 100)
        .when(kind.isin("search_result", "query"), 10)
        .otherwise(300)
    )
    score = (
        base
        + F.greatest(F.lit(0), F.lit(30) - path_depth(path) * 5)
        + F.when(has_keyword(path, fixed.HIGH_PRIORITY_KEYWORDS), 50).otherwise(0)
        - F.when(query != "", 200).otherwise(0)
        - F.when(kind == "search_result", 300).otherwise(0)
    )
    return F.greatest(F.lit(0), score)


def is_crawlable(
    scheme: Column, netloc: Column, path: Column, query: Column, base_netloc: Column
) -> Column:
    """Same site, a page rather than a file, no account or search pages, not too deep."""
    lower_path = F.lower(path)
    is_file = lower_path.rlike(
        "(" + "|".join(e.replace(".", r"\.") for e in fixed.DOWNLOAD_EXTENSIONS) + ")$"
    )
    important = has_keyword(
        path, fixed.HIGH_PRIORITY_KEYWORDS + fixed.MEDIUM_PRIORITY_KEYWORDS
    )
    crowded = (F.size(query_pairs(query)) > 2) | (path_depth(path) > 4)
    return (
        scheme.isin("http", "https")
        & (canonical_domain(netloc) == canonical_domain(base_netloc))
        & ~is_file
        & ~contains_any(lower_path, fixed.SKIP_PATH_KEYWORDS)
        & ~is_search_path(path)
        & ~has_search_query(query)
        & ~((query != "") & is_root(path))
        & (~crowded | important)
    )


def crawl_intent(path: Column) -> Column:
    return F.when(is_root(path), F.lit(fixed.CRAWL_HOMEPAGE)).otherwise(
        F.lit(fixed.CRAWL_SPECIFIC)
    )


def is_utility_page(path: Column, query: Column, base_path: Column) -> Column:
    """Low-value pages of a specific-page crawl (the base page itself is the caller's case)."""
    tokens = meaningful_tokens(path)
    group_hit = F.lit(False)
    for group in fixed.UTILITY_TOKEN_GROUPS:
        wanted = F.array(*[F.lit(t) for t in group])
        group_hit = group_hit | (F.size(F.array_except(wanted, tokens)) == 0)
    return (
        (is_wiki_namespace(path) & ~is_wiki_namespace(base_path))
        | page_type(path, query).isin(fixed.UTILITY_PAGE_TYPES)
        | has_any(path_segments(path), fixed.UTILITY_SEGMENTS)
        | has_any(tokens, fixed.UTILITY_SEGMENTS)
        | group_hit
    )


def specific_score(
    path: Column, query: Column, base_path: Column, anchor_text: Column
) -> Column:
    """Specific-page crawl: pages that share words with the base page first."""
    tokens = meaningful_tokens(path)
    shared = F.size(
        F.array_intersect(
            meaningful_tokens(base_path), F.array_union(tokens, token_set(anchor_text))
        )
    )
    first, base_first = (
        F.get(path_segments(path), F.lit(0)),
        F.get(path_segments(base_path), F.lit(0)),
    )
    score = (
        F.lit(150)
        + shared * 300
        + F.when(first == base_first, 150).otherwise(0)
        + F.when(is_wiki_content(path), 150).otherwise(0)
        + F.when(page_type(path, query).isin("docs", "blog"), 100).otherwise(0)
        - F.when(query != "", 150).otherwise(0)
        - F.when(F.size(tokens) <= 1, 50).otherwise(0)
        + F.greatest(F.lit(0), F.lit(20) - path_depth(path) * 3)
    )
    return F.greatest(F.lit(0), score)


# --- relative references ----------------------------------------------------
def _without_dots(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    parts = F.split(path, "/")
    stacked = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..",
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).when(s == ".", acc).otherwise(F.array_append(acc, s)),
    )
    tail = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(stacked, "/"), tail)
    return F.when(
        path.rlike(r"/\.\.?(/|$)"), F.regexp_replace(joined, "^//", "/")
    ).otherwise(path)


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on page `base`."""
    origin = F.concat(
        F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1),
        F.lit("//"),
        netloc_of(base),
    )
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    base_path = F.regexp_extract(_after_scheme(base), r"^(?://[^/?#]*)?([^?#]*)", 1)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(ref.rlike(SCHEME), ref)
        .when(ref.startswith("//"), F.concat(scheme_of(base), F.lit(":"), ref))
        .when(ref == "", base)
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .when(ref.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), ref))
        .when(ref.startswith("/"), F.concat(origin, _without_dots(ref_path), ref_tail))
        .otherwise(
            F.concat(origin, _without_dots(F.concat(folder, ref_path)), ref_tail)
        )
    )


# --- social links -----------------------------------------------------------
def clean_social_url(cleaned: Column) -> Column:
    return F.regexp_replace(cleaned, r"[.,;)]+$", "")


def _host_in(host: Column, domains: list[str]) -> Column:
    hit = F.lit(False)
    for domain in domains:
        hit = hit | (host == domain) | F.endswith(host, F.lit("." + domain))
    return hit


def social_platform(url: Column, link_text: Column) -> Column:
    """First platform whose domain holds the URL or whose name is in the link text; '' if none."""
    host = host_of(netloc_of(F.lower(url)))
    text = F.lower(link_text)
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    platform = None
    for name, domains in fixed.SOCIAL_DOMAINS.items():
        hit = _host_in(host, domains) | F.contains(padded, F.lit(f" {name} "))
        platform = F.when(hit, F.lit(name)) if platform is None else platform.when(hit, F.lit(name))
    return platform.when(text.isin(fixed.TWITTER_LINK_TEXTS), F.lit("twitter")).otherwise(
        F.lit("")
    )
