"""HTML extraction on a hand-written shop page."""

import pytest
from pyspark.sql import functions as F

from sitelore.functions.html import parse_html
from sitelore.operators.extract import choose_render, extract_pages, needs_browser

PAGE = """<!doctype html><html><head><title> Tea &amp; Co </title>
<meta name="Description" content="Fine  teas."><link rel="canonical" href="/home">
<meta property="og:title" content="Old"><meta property="og:title" content="Tea"><meta name="twitter:card" content="summary">
<script type="application/ld+json">{"b": 1, "a": ["https://instagram.com/tea"]}</script>
<script type="application/ld+json">{broken</script><script>var x = "</p>";</script></head>
<body><div class="promo-box"><p>Buy now</p></div><nav><a href="/">Home</a><a href="mailto:a@b.c">Mail</a>
<a href="/icon" aria-label="Icon only"></a><a href="/img" title="Pic"><img src="/cup.jpg" alt="Cup of green tea for two people in the morning"></a></nav>
<main><h1>Tea</h1><p>One <b>two</b><p>Three<p>Three</p>
<h2>Do you ship?</h2><p>Yes, daily.</p><div>Worldwide.</div><h2></h2><h3>Prices</h3>
<table><tr><th>Kind</th><th>Price</th></tr><tr><td>Green</td><td></td><td>5</td></tr></table>
<ul><li>A</li><li>B <ol><li>c</li></ol></li></ul>
<details><summary>Is it fresh?</summary><p>Always.</p></details>
<figure><img data-src="/leaf.png" src="data:image/gif;base64,xx" alt="Leaf" style="width: 300px"><figcaption>Tea leaf</figcaption></figure>
<picture><source srcset="/field.jpg 2x, /s.jpg 1x"><img alt="Field"></picture>
<img src="/pixel.gif" width=1 height=1 alt="dot"><img src="/cup.jpg" alt="Cup"></main></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    df = spark.createDataFrame([(1, "https://tea.example/shop/", PAGE)], "k int, page_url string, html string")
    return extract_pages(df).collect()[0].asDict(recursive=True)


def test_metadata(page):
    assert page["title"] == "Tea & Co"
    assert page["description"] == "Fine teas."
    assert page["metadata"] == {
        "canonical": "https://tea.example/home", "open_graph": {"title": "Tea"}, "twitter": {"card": "summary"},
    }
    assert page["structured_data"] == ['{"a": ["https://instagram.com/tea"], "b": 1}']


def test_blocks(page):
    assert [(h["level"], h["text"]) for h in page["headings"]] == [(1, "Tea"), (2, "Do you ship?"), (3, "Prices")]
    assert page["paragraphs"] == ["One two", "Three", "Yes, daily.", "Always."]
    assert page["lists"] == [{"type": "ul", "items": ["A", "B c"]}, {"type": "ol", "items": ["c"]}]
    assert page["tables"] == [{"headers": ["Kind", "Price"], "rows": [["Green", "5"]]}]
    assert "Buy now" not in page["content"]


def test_links_drop_empty_anchors(page):
    assert [(l["text"], l["url"], l["is_internal"]) for l in page["links"]] == [
        ("Home", "https://tea.example/", True), ("Pic", "https://tea.example/img", True),
    ]


def test_faqs_and_sections(page):
    faqs = {f["question"]: f["answer"] for f in page["faqs"]}
    assert faqs["Is it fresh?"] == "Always."
    assert faqs["Do you ship?"] == "Yes, daily. Worldwide."
    sections = {s["heading"]: s["content"] for s in page["sections"]}
    assert sections["Tea"] == "One two Three Three"
    assert sections["Do you ship?"] == "Yes, daily. Worldwide."
    assert sections["Prices"].startswith("Kind Price Green 5 A B c Is it fresh?")


def test_images(page):
    found = {i["absolute_url"]: i for i in page["images"]}
    assert list(found) == ["https://tea.example/cup.jpg", "https://tea.example/leaf.png", "https://tea.example/field.jpg"]
    assert found["https://tea.example/cup.jpg"]["alt"].startswith("Cup of green tea")
    leaf = found["https://tea.example/leaf.png"]
    assert (leaf["src"], leaf["width"], leaf["height"], leaf["figcaption"]) == ("/leaf.png", 300, None, "Tea leaf")
    assert page["quality"]["image_count"] == 3


def test_quality(page):
    n, p, h = len(page["content"]), len(page["paragraphs"]), len(page["headings"])
    assert page["quality"]["content_length"] == n
    assert page["quality"]["useful_text_score"] == round(min(1, n / 3000 * 0.5 + p / 12 * 0.3 + h / 8 * 0.2), 3)


def test_fragments_and_bad_markup():
    def shape(html):
        return [n["tag"] for n in parse_html(html)["nodes"]], parse_html(html)["texts"]

    assert shape("Hi") == (["html", "body", "p"], ["Hi"])
    assert shape("") == ([], [])
    tags, texts = shape("<p>a<!-- x -->b</p></div><li>c<li>d")
    assert tags == ["html", "body", "p", "li", "li"] and texts == ["a", "b", "c", "d"]
    nodes = parse_html("<div><p><b>x<br><p>y</div>z")["nodes"]
    by = {n["i"]: n for n in nodes}
    ps = [n for n in nodes if n["tag"] == "p"]
    assert [by[p["parent"]]["tag"] for p in ps] == ["div", "div"]
    assert (ps[0]["t0"], ps[0]["t1"], ps[1]["t0"], ps[1]["t1"]) == (0, 1, 1, 2)


def test_empty_page(spark):
    df = spark.createDataFrame([("https://a.b", ""), ("https://a.c", None)], "page_url string, html string")
    for r in extract_pages(df).collect():
        assert r.content == "" and r.paragraphs == [] and r.quality.content_length == 0


def test_render_decision_and_choice(spark):
    rows = [
        ("", 0, 0, "", False, 0, 0, True), ("<p>", 900, 2, "t", True, 20, 100, False), ("<p>", 400, 5, "", False, 0, 0, True),
        ("<p>", 1000, 0, "t", False, 0, 2000, True), ("<p>", 1000, 1, "", True, 0, 2000, True),
        ("<p>ng-version", 1000, 1, "", False, 0, 2000, True), ("<p>", 1000, 1, "", False, 8, 700, True),
        ("<p>", 1000, 1, "", False, 8, 900, False),
    ]
    df = spark.createDataFrame(rows, "h string, n int, p int, t string, spa boolean, s int, b int, want boolean")
    got = df.withColumn("got", needs_browser(F.col("h") == "", F.contains("h", F.lit("ng-version")), *[F.col(c) for c in ("n", "p", "t", "spa", "s", "b")]))
    assert all(r.got == r.want for r in got.collect())
    modes = [
        ("static", "s", "r", True, "static", "s"), ("auto", "s", "r", False, "static", "s"),
        ("auto", "s", "r", True, "playwright", "r"), ("auto", "s", None, True, "static_with_playwright_failed", "s"),
        ("auto", None, "r", True, "playwright", "r"), ("browser", "s", "r", False, "playwright", "r"),
        ("browser", "s", None, False, "static_after_playwright_failed", "s"), ("browser", None, None, True, None, None),
    ]
    df = spark.createDataFrame(modes, "m string, s string, r string, w boolean, want string, html string")
    for r in choose_render(df, F.col("m"), F.col("s"), F.col("r"), F.col("w")).collect():
        assert (r.extraction_method, r.chosen_html) == (r.want, r.html), r
