"""Scalar functions against Python's own library."""

import random
from urllib.parse import parse_qsl, urlencode, urljoin, urlparse

from pyspark.sql import functions as F

from sitelore import fixed
from sitelore.functions import scoring, text, urls
from sitelore.functions.numbers import round_exact
from sitelore.operators.chunks import split_words


def values(spark, rows, kind, build):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_round_exact_is_correct_rounding(spark):
    random.seed(1)
    xs = [random.random() * 8 for _ in range(2000)] + [i / 128 for i in range(500)]
    xs += [0.35 * (i / 1e6) + 1.2 * 0.5 for i in range(0, 10**6, 997)] + [2.675, 0.1234565, -1.2345675]
    assert values(spark, xs, "double", round_exact) == [round(x, 6) for x in xs]
    assert values(spark, xs, "double", lambda c: round_exact(c, 2)) == [round(x, 2) for x in xs]
    import numpy as np

    assert scoring.ArrayOps.round6(np.array(xs)).tolist() == [round(x, 6) for x in xs]


def test_clean_text_matches_unicode_whitespace(spark):
    xs = ["  a  b\n\n c\x1c\x85d ", "", None, "x", "　", "a  b", "a\tb c"]
    assert values(spark, xs, "string", text.clean_text) == [" ".join((x or "").split()) for x in xs]


def test_dedupe_key_and_match_text(spark):
    xs = ["Hello, World!", "É-À_1 x", "!!!", "a  b"]
    assert values(spark, xs, "string", text.dedupe_key) == ["hello world", "é à_1 x", "", "a b"]
    ys = ["Call +92-300 NOW!! a@b.com", "x  &  y", "naïve/é"]
    assert values(spark, ys, "string", text.match_text) == ["call +92-300 now a@b.com", "x y", "na ve/"]


def test_query_terms_keep_repeats_and_punctuation(spark):
    got = values(spark, ["what is the Price, price of a shirt. x"], "string", lambda c: text.query_terms(text.match_text(c)))
    assert list(got[0]) == ["price", "price", "shirt."]


def expected_normal(url, force):
    raw = url.strip()
    if not urlparse(raw).scheme:
        raw = "https://" + raw
    p = urlparse(raw)
    host = p.netloc.lower()
    for port in (":443", ":80"):
        if host.endswith(port):
            host = host[: -len(port)]
            break
    pairs = sorted(
        (k, v) for k, v in parse_qsl(p.query, keep_blank_values=True)
        if not k.lower().startswith("utm_") and k.lower() not in fixed.TRACKING_QUERY_KEYS
    )
    scheme = "https" if force and p.scheme == "http" else p.scheme
    query = urlencode(pairs)
    return f"{scheme}://{host}{p.path.rstrip('/')}" + (f"?{query}" if query else "")


def test_url_normal_forms(spark):
    xs = [
        "http://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1&a=~*", "example.com", "https://x.y/",
        "https://x.y/a;p=1/b;q?z=%20+%zz&k", "https://x.y?q=1#top", "  https://x.y/A//  ",
        "http://x.y/a b", "https://x.y:443/p?gclid=1&FBCLID=2&c=%C3%A9", "https://x.y/p?a=1;b=2",
    ]
    assert values(spark, xs, "string", urls.cache_url) == [expected_normal(x, True) for x in xs]
    assert values(spark, xs, "string", urls.crawl_url) == [expected_normal(x, False) for x in xs]
    assert values(spark, ["", None], "string", urls.cache_url) == ["", ""]


def test_variants_of_a_site_share_one_id(spark):
    xs = ["http://example.com/", "https://example.com", "example.com", "HTTPS://EXAMPLE.com:443/?utm_campaign=a"]
    ids = values(spark, xs, "string", lambda c: urls.website_id(urls.cache_url(c)))
    assert len(set(ids)) == 1 and len(ids[0]) == 12
    names = values(spark, xs[:1], "string", lambda c: urls.cache_name(urls.cache_url(c)))
    assert names == [f"example_com_{ids[0]}.json"]


def test_relative_references(spark):
    bases = ["https://ex.com/a/b/c?x=1#f", "https://ex.com", "https://ex.com/d/"]
    refs = ["../x", "./y", "z", "/q/../w", "?k=1", "#t", "//h/p", "http://o/p", "", "../../../u", "a/./b/..", "mailto:x", "../.."]
    rows = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(rows, "b string, r string")
    for row in df.select("b", "r", urls.resolve(F.col("b"), F.col("r")).alias("o")).collect():
        assert row.o == urljoin(row.b, row.r), row


def kind(spark, url):
    return values(spark, [url], "string", lambda c: urls.page_type(urls.path_of(c), urls.query_of(c)))[0]


def test_page_types(spark):
    cases = {
        "https://e.com": "homepage", "https://e.com/?x=1": "query", "https://e.com/?q=1": "search_result",
        "https://e.com/search/a": "search_result", "https://e.com/who/about-us": "about",
        "https://e.com/our_services": "services", "https://e.com/plans": "pricing", "https://e.com/jobs/1": "careers",
        "https://e.com/privacy": "legal", "https://e.com/wiki/Talk:X": "wiki_meta", "https://e.com/zzz": "other",
    }
    for url, want in cases.items():
        assert kind(spark, url) == want, url


def test_social_platform_rules(spark):
    rows = [
        ("https://www.instagram.com/a", "", "instagram"), ("https://m.fb.com/a", "", "facebook"),
        ("https://netflix.com", "", ""), ("https://e.com", "Follow on youtube now", "youtube"),
        ("https://e.com", "X", "twitter"), ("https://wa.me/1", "", "whatsapp"), ("https://x.com/a", "", "twitter"),
    ]
    df = spark.createDataFrame(rows, "u string, t string, want string")
    for r in df.withColumn("got", urls.social_platform(F.col("u"), F.col("t"))).collect():
        assert r.got == r.want, r


def windows(words, size=1000, step=880):
    if len(words) < 4:
        return []
    out, start = [], 0
    while True:
        out.append(" ".join(words[start : start + size]))
        if start + size >= len(words):
            return out
        start += step


def test_split_counts_and_overlap(spark):
    sizes = [0, 3, 4, 999, 1000, 1001, 1300, 1760, 1761, 1880, 1881, 2761, 5000]
    texts = [" ".join(f"w{i}" for i in range(n)) for n in sizes]
    got = values(spark, texts, "string", split_words)
    for n, t, pieces in zip(sizes, texts, got):
        assert list(pieces) == windows(t.split()), n


def test_intents(spark):
    cases = {
        "your instagram please": "social_link", "official account": "social_link", "whatsapp link": "social_link",
        "whatsapp number": "contact", "customer service": "contact", "where are you": "location",
        "refund policy": "policy", "photo of it": "image", "price of shoes": "product", "help": "faq", "hello there": "general",
    }
    got = values(spark, list(cases), "string", lambda c: scoring.classify_intent(text.match_text(c)))
    assert dict(zip(cases, got)) == cases


def test_hash_embedding_follows_digest(spark):
    import hashlib

    from sitelore.operators.embed import hash_embedder

    got = values(spark, ["alpha", "b"], "string", hash_embedder(40))
    for t, vector in zip(["alpha", "b"], got):
        d = hashlib.sha256(t.encode()).digest()
        assert list(vector) == [round(d[i % 32] / 255.0 * 2.0 - 1.0, 6) for i in range(40)]
