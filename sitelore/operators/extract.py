"""Structured page content from node arrays (`functions.html.dom`).

Every step is an expression over the arrays of the same row, so extraction never
shuffles and pages of any host spread evenly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore import fixed
from sitelore.functions import urls
from sitelore.functions.binding import built_once, let
from sitelore.functions.html import NODE, dom
from sitelore.functions.numbers import round_exact
from sitelore.functions.text import clean_text, contains_any, strip
from sitelore.schemas import FAQS, HEADINGS, IMAGES, LINKS, LISTS, SECTIONS, TABLES
from sitelore.session import whole_texts

STRINGS = "array<string>"


@dataclass(frozen=True)
class Limits:
    """Cuts of what is extracted, in characters or items; None keeps everything."""

    content: int | None = None
    section: int | None = None
    sections: int | None = None
    faq_answer: int | None = None
    faq_stop: int | None = None
    nearby: int | None = None


WHOLE = Limits()


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def _over(build, *options) -> Column:
    """`build(nodes, texts, page_url, *options)` with the page's arrays bound once.

    Lambdas below refer to these arrays. Were they plain columns, the optimizer could
    move their definitions into the lambdas and compute them once per element.
    """

    def column() -> Column:
        bound = F.struct("nodes", "texts", "page_url")
        return let(bound, lambda d: build(d["nodes"], d["texts"], d["page_url"], *options))

    return built_once(f"extract.{build.__name__}{options}", column)


# --- node arithmetic --------------------------------------------------------
def _attr(node: Column, name: str) -> Column:
    return F.coalesce(F.element_at(node["attrs"], name), F.lit(""))


def _inside(node: Column, outer: Column) -> Column:
    return (node["i"] > outer["i"]) & (node["i"] < outer["last"])


def _texts(node: Column, texts: Column) -> Column:
    """Text pieces under a node; removed pieces are null."""
    return F.slice(texts, node["t0"] + 1, node["t1"] - node["t0"])


def _text(node: Column, texts: Column) -> Column:
    return clean_text(F.array_join(_texts(node, texts), " "))


def _subtree(node: Column, nodes: Column) -> Column:
    """Descendants of a node; null without a node."""
    return F.slice(nodes, node["i"] + 2, node["last"] - node["i"] - 1)


def _picked(ids: Column, nodes: Column) -> Column:
    return F.transform(ids, lambda i: F.get(nodes, i))


def _first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def _tags(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def _live_tags(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["alive"] & n["tag"].isin(*tags))


def _first_per_key(items: Column, *keys) -> Column:
    """Structs (at, item): of items with equal first key the one that sorts first by the
    other keys and then by place, in the order of the first key. Sorting instead of
    searching keeps long arrays cheap; keys and items must be comparable."""
    rows = F.transform(
        items,
        lambda x, i: F.struct(
            *(k(x).alias(f"k{n}") for n, k in enumerate(keys)), i.alias("at"), x.alias("item")
        ),
    )
    return let(
        F.array_sort(rows),
        lambda s: F.filter(s, lambda r, i: (i == 0) | (F.get(s, i - 1)["k0"] != r["k0"])),
    )


def _first_distinct(items: Column, key) -> Column:
    """Items whose key did not occur earlier in the array."""
    found = F.transform(_first_per_key(items, key), lambda r: F.struct(r["at"].alias("at"), r["item"].alias("item")))
    return F.transform(F.array_sort(found), lambda r: r["item"])


# --- before noise removal ---------------------------------------------------
def _page_metadata(df: DataFrame) -> DataFrame:
    nodes, texts = F.col("nodes"), F.col("texts")

    def unspaced(found: Column) -> Column:
        return clean_text(F.array_join(_texts(_first(found), texts), ""))

    def metas(attr: str, prefix: str) -> Column:
        tagged = F.filter(
            nodes,
            lambda n: (n["tag"] == "meta")
            & F.lower(_attr(n, attr)).startswith(prefix)
            & (F.length(_attr(n, attr)) > len(prefix))
            & (_attr(n, "content") != ""),
        )
        entries = F.transform(
            tagged,
            lambda n: F.struct(
                F.regexp_replace(_attr(n, attr), f"^.{{{len(prefix)}}}", "").alias("key"),
                clean_text(_attr(n, "content")).alias("value"),
            ),
        )
        # a repeated key keeps its last value
        backwards = _first_distinct(F.reverse(entries), lambda e: e["key"])
        return F.map_from_entries(F.reverse(backwards))

    description = _first(
        F.filter(nodes, lambda n: (n["tag"] == "meta") & (F.lower(_attr(n, "name")) == "description"))
    )
    canonical = _first(
        F.filter(nodes, lambda n: (n["tag"] == "link") & F.contains(_attr(n, "rel"), F.lit("canonical")))
    )
    href = F.coalesce(_attr(canonical, "href"), F.lit(""))
    df = df.withColumns(
        {
            "_title": unspaced(_tags(nodes, "title")),
            "_h1": unspaced(_tags(nodes, "h1")),
            "_canonical": href,
        }
    )
    return df.withColumns(
        {
            "title": F.when(F.col("_title") != "", F.col("_title")).otherwise(F.col("_h1")),
            "description": clean_text(_attr(description, "content")),
            "metadata": F.struct(
                F.when(F.col("_canonical") == "", F.lit(""))
                .otherwise(urls.resolve(F.col("page_url"), F.col("_canonical")))
                .alias("canonical"),
                metas("property", "og:").alias("open_graph"),
                metas("name", "twitter:").alias("twitter"),
            ),
            "structured_data": F.filter(F.transform(nodes, lambda n: n["json"]), lambda j: j.isNotNull()),
        }
    ).drop("_title", "_h1", "_canonical")


def _anchors(nodes: Column, texts: Column, page_url: Column) -> Column:
    """Every link of the page as delivered, labelled or not, first per normalised URL."""

    def anchor(a: Column) -> Column:
        return F.struct(
            clean_text(F.array_join(_texts(a, texts), " ")).alias("text"),
            urls.crawl_url(urls.resolve(page_url, strip(_attr(a, "href")))).alias("url"),
        )

    linked = F.filter(_tags(nodes, "a"), lambda n: strip(_attr(n, "href")) != "")
    found = F.filter(F.transform(linked, anchor), lambda l: l["url"] != "")
    return let(found, lambda f: _first_distinct(f, lambda l: l["url"]))


# --- images -----------------------------------------------------------------
def srcset_first(value: Column) -> Column:
    """First URL of a srcset: candidates split at commas, URL before the first space."""
    urls_ = F.transform(F.split(value, ","), lambda c: F.substring_index(strip(c), " ", 1))
    return F.coalesce(_first(F.filter(urls_, lambda u: u != "")), F.lit(""))


def is_placeholder(src: Column) -> Column:
    lower = F.lower(src)
    skipped = reduce(lambda a, b: a | b, [lower.startswith(s) for s in fixed.SKIP_IMAGE_SCHEMES])
    return (lower == "") | skipped | contains_any(lower, fixed.PLACEHOLDER_IMAGE_PATTERNS)


def image_url(src: Column, page_url: Column) -> Column:
    """Absolute http(s) URL of an image source, '' when unusable."""
    raw = F.when(F.contains(src, F.lit(",")), srcset_first(src)).otherwise(src)
    raw = F.regexp_replace(strip(raw), "^['\"]+|['\"]+$", "")

    def absolute(r: Column) -> Column:
        return F.when(is_placeholder(r), F.lit("")).otherwise(urls.resolve(page_url, r))

    return let(
        let(raw, absolute),
        lambda u: F.when(urls.scheme_of(u).isin("http", "https"), u).otherwise(F.lit("")),
    )


def _usable_source(node: Column, attrs: list[str]) -> Column:
    """First attribute that holds a real image source, null if none."""
    options = []
    for name in attrs:
        value = _attr(node, name)
        options.append(srcset_first(value) if "srcset" in name else value)
    return F.get(F.filter(F.array(*options), lambda s: ~is_placeholder(s)), F.lit(0))


def image_type(image: Column) -> Column:
    """Ordered word rules over everything known about the image."""
    known = F.lower(
        F.concat_ws(" ", *[image[f] for f in ("src", "absolute_url", "alt", "title", "figcaption", "nearby_text")])
    )

    def classify(text: Column) -> Column:
        kind = None
        for name, words in fixed.IMAGE_TYPE_WORDS:
            hit = contains_any(text, words)
            kind = F.when(hit, F.lit(name)) if kind is None else kind.when(hit, F.lit(name))
        return kind.when(_described(image) == 0, F.lit("decorative")).otherwise(F.lit("content"))

    return let(known, classify)


def _described(image: Column) -> Column:
    """Characters of descriptive text."""
    return reduce(
        lambda a, b: a + b, [F.length(image[f]) for f in ("alt", "title", "figcaption", "nearby_text")]
    )


def is_useful_image(image: Column) -> Column:
    width, height, kind = image["width"], image["height"], image["image_type"]
    sized = F.coalesce((width > 0) & (height > 0), F.lit(False))
    dot = sized & (width <= 1) & (height <= 1)
    small = sized & ((width <= 64) | (height <= 64))
    described = _described(image)
    source = F.lower(F.concat_ws(" ", image["src"], image["absolute_url"]))
    plain_icon = (kind == "icon") & (
        small | ((image["figcaption"] == "") & (image["nearby_text"] == "")) | (described < 50)
    )
    return (
        (image["absolute_url"] != "")
        & ~dot
        & (described > 0)
        & (kind != "decorative")
        & ~plain_icon
        & ~((kind == "logo") & (image["figcaption"] == ""))
        & ~(small & (described < 25))
        & ~contains_any(source, fixed.IMAGE_SOCIAL_NAMES)
        & ~(contains_any(source, fixed.ICON_IMAGE_PATTERNS) & small)
    )


def _dimension(img: Column, name: str) -> Column:
    own = F.regexp_extract(_attr(img, name), r"\d+", 0).try_cast("int")
    styled = F.regexp_extract(_attr(img, "style"), rf"(?i){name}\s*:\s*(\d+)(?:\.\d+)?px", 1)
    return F.coalesce(own, styled.try_cast("int"))


def _nearby_text(img: Column, ancestors: Column, nodes: Column, texts: Column, limit: int | None) -> Column:
    """Label, texts of up to two siblings on each side of the image, its parent and its
    figure, and the nearest ancestor with a short text; each text once."""
    parent = F.get(nodes, img["parent"])
    figure = F.try_element_at(_tags(ancestors, "figure"), F.lit(-1))
    none = F.array().cast(STRINGS)

    def around(node: Column) -> Column:
        kids = F.when(node["parent"] >= 0, F.get(nodes, node["parent"])["kids"]).otherwise(
            F.array().cast("array<int>")
        )
        at = node["place"]
        before = F.reverse(F.slice(kids, F.greatest(at - 1, F.lit(1)), F.least(at, F.lit(2))))
        picked = _picked(F.concat(before, F.slice(kids, at + 2, F.lit(2))), nodes)
        shown = F.filter(picked, lambda n: ~n["tag"].isin("script", "style", "noscript", "svg"))
        return F.transform(shown, lambda n: _text(n, texts))

    # siblings exist only below the document root
    parent_part = F.when(img["parent"] >= 0, around(parent)).otherwise(none)
    figure_part = F.when(
        figure.isNotNull() & (figure["i"] != img["parent"]), around(figure)
    ).otherwise(none)
    stop = F.coalesce(
        F.array_max(F.transform(_tags(ancestors, "body", "html", "main"), lambda n: n["i"])), F.lit(-1)
    )
    # only texts of up to 500 characters are looked at, however much an ancestor holds
    climb = F.transform(
        F.reverse(F.filter(ancestors, lambda n: (n["i"] > stop) & (n["solid"] <= 500))),
        lambda n: _text(n, texts),
    )
    short = F.slice(
        F.filter(climb, lambda t: (F.length(t) >= 10) & (F.length(t) <= 500)), F.lit(1), F.lit(1)
    )
    parts = F.concat(
        F.array(clean_text(_attr(img, "aria-label"))), around(img), parent_part, figure_part, short
    )
    distinct = let(
        F.filter(parts, lambda t: t != ""), lambda ps: _first_distinct(ps, F.lower)
    )
    return _cut(F.array_join(distinct, " "), limit)


def _images(nodes: Column, texts: Column, page_url: Column, limits: Limits) -> Column:
    """Useful images, best described record per URL, in order of first appearance."""

    def record(img: Column) -> Column:
        def build(ancestors: Column) -> Column:
            none = F.array().cast(f"array<{NODE}>")
            picture = F.try_element_at(_tags(ancestors, "picture"), F.lit(-1))
            offered = F.transform(
                _tags(F.coalesce(_subtree(picture, nodes), none), "source"),
                lambda n: _usable_source(n, fixed.PICTURE_SOURCE_ATTRS),
            )
            figure = F.try_element_at(_tags(ancestors, "figure"), F.lit(-1))
            caption = _first(_tags(F.coalesce(_subtree(figure, nodes), none), "figcaption"))
            src = F.coalesce(
                _usable_source(img, fixed.IMAGE_SOURCE_ATTRS),
                _first(F.filter(offered, lambda s: s.isNotNull())),
                F.lit(""),
            )
            return F.struct(
                strip(src).alias("src"),
                F.coalesce(_text(caption, texts), F.lit("")).alias("figcaption"),
                _nearby_text(img, ancestors, nodes, texts, limits.nearby).alias("nearby_text"),
            )

        return let(
            let(_picked(img["up"], nodes), build),
            lambda d: F.struct(
                d["src"].alias("src"),
                image_url(d["src"], page_url).alias("absolute_url"),
                clean_text(_attr(img, "alt")).alias("alt"),
                clean_text(_attr(img, "title")).alias("title"),
                d["figcaption"].alias("figcaption"),
                d["nearby_text"].alias("nearby_text"),
                _dimension(img, "width").alias("width"),
                _dimension(img, "height").alias("height"),
                clean_text(_attr(img, "loading")).alias("loading"),
                page_url.alias("page_url"),
            ),
        )

    raw = F.transform(_tags(nodes, "img"), record)
    typed = F.transform(
        raw,
        lambda r: F.struct(
            *[r[f].alias(f) for f in (
                "src", "absolute_url", "alt", "title", "figcaption", "nearby_text", "width",
                "height", "loading", "page_url",
            )],
            image_type(r).alias("image_type"),
        ),
    )

    def best(useful: Column) -> Column:
        def url(r: Column) -> Column:
            return r["absolute_url"]

        seen = _first_per_key(useful, url)
        top = _first_per_key(useful, url, lambda r: -_described(r))  # both in the order of URLs
        placed = F.zip_with(seen, top, lambda a, b: F.struct(a["at"].alias("at"), b["item"].alias("item")))
        return F.transform(F.array_sort(placed), lambda r: r["item"])

    return let(F.filter(typed, is_useful_image), best).cast(IMAGES)


def _image_records(df: DataFrame, limits: Limits) -> DataFrame:
    return df.withColumn("images", _over(_images, limits))


# --- after noise removal ----------------------------------------------------
def _drop_noise(df: DataFrame) -> DataFrame:
    """Removed texts become null; nodes know whether they are alive."""
    live = F.transform("texts", lambda t, j: F.when(F.get("live", j), t))
    return df.withColumn("texts", live)


def _following(heading: Column, nodes: Column, texts: Column, stop: str, stop_chars: int | None) -> Column:
    """Joined texts of the siblings after a heading, up to the next heading (`stop` names
    its place) or, with `stop_chars`, until the text has grown beyond that."""
    kids = F.get(nodes, heading["parent"])["kids"]
    between = F.slice(kids, heading["place"] + 2, heading[stop] - heading["place"] - 1)
    siblings = F.filter(_picked(between, nodes), lambda n: n["alive"])
    if stop_chars is None:
        return F.array_join(F.filter(F.transform(siblings, lambda n: _text(n, texts)), lambda t: t != ""), " ")
    return F.aggregate(
        siblings,
        F.lit(""),
        lambda acc, n: F.when(F.length(acc) > stop_chars, acc).otherwise(
            F.trim(F.concat_ws(" ", acc, _text(n, texts)))
        ),
    )


def _headings(nodes: Column, texts: Column, _: Column) -> Column:
    return F.filter(
        F.transform(
            _live_tags(nodes, "h1", "h2", "h3", "h4", "h5", "h6"),
            lambda n: F.struct(
                F.substring(n["tag"], 2, 1).cast("int").alias("level"), _text(n, texts).alias("text")
            ),
        ),
        lambda h: h["text"] != "",
    ).cast(HEADINGS)


def _paragraphs(nodes: Column, texts: Column, _: Column) -> Column:
    return F.array_distinct(
        F.filter(F.transform(_live_tags(nodes, "p"), lambda n: _text(n, texts)), lambda t: t != "")
    )


def _lists(nodes: Column, texts: Column, _: Column) -> Column:
    return F.filter(
        F.transform(
            _live_tags(nodes, "ul", "ol"),
            lambda l: F.struct(
                l["tag"].alias("type"),
                F.filter(
                    F.transform(
                        _live_tags(_picked(l["kids"], nodes), "li"),
                        lambda n: _text(n, texts),
                    ),
                    lambda t: t != "",
                ).alias("items"),
            ),
        ),
        lambda l: F.size(l["items"]) > 0,
    ).cast(LISTS)


def _tables(nodes: Column, texts: Column, _: Column) -> Column:
    def table(t: Column) -> Column:
        def row(tr: Column) -> Column:
            cells = _live_tags(_subtree(tr, nodes), "th", "td")
            return F.struct(
                F.exists(cells, lambda n: n["tag"] == "th").alias("head"),
                F.filter(F.transform(cells, lambda n: _text(n, texts)), lambda v: v != "").alias("cells"),
            )

        rows = F.filter(
            F.transform(_live_tags(_subtree(t, nodes), "tr"), row),
            lambda r: F.size(r["cells"]) > 0,
        )

        def split(rs: Column) -> Column:
            # position of the first row that has header cells
            head = F.coalesce(
                F.array_min(
                    F.filter(
                        F.transform(rs, lambda r, i: F.when(r["head"], i)), lambda i: i.isNotNull()
                    )
                ),
                F.lit(-1),
            )
            empty = F.array().cast(STRINGS)
            return let(
                head,
                lambda h: F.struct(
                    F.coalesce(F.get(rs, h)["cells"], empty).alias("headers"),
                    F.transform(F.filter(rs, lambda r, i: i != h), lambda r: r["cells"]).alias("rows"),
                ),
            )

        return let(rows, split)

    return F.filter(
        F.transform(_live_tags(nodes, "table"), table),
        lambda t: (F.size(t["headers"]) > 0) | (F.size(t["rows"]) > 0),
    ).cast(TABLES)


def _blocks(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "headings": _over(_headings),
            "paragraphs": _over(_paragraphs),
            "lists": _over(_lists),
            "tables": _over(_tables),
        }
    )


def _page_links(nodes: Column, texts: Column, page_url: Column) -> Column:
    """Labelled http(s) links, first per (text, URL)."""
    skipped = "^(" + "|".join(fixed.SKIP_LINK_SCHEMES) + ")"

    def link(a: Column) -> Column:
        own = F.filter(_texts(a, texts), lambda t: t.isNotNull())
        label = F.when(F.size(own) > 0, F.array_join(own, " ")).otherwise(
            F.when(_attr(a, "aria-label") != "", _attr(a, "aria-label")).otherwise(_attr(a, "title"))
        )
        return F.struct(
            clean_text(label).alias("text"),
            urls.resolve(page_url, strip(_attr(a, "href"))).alias("url"),
        )

    anchors = F.filter(
        nodes,
        lambda n: n["alive"]
        & (n["tag"] == "a")
        & (strip(_attr(n, "href")) != "")
        & ~strip(_attr(n, "href")).rlike(skipped),
    )
    found = F.filter(
        F.transform(anchors, link),
        lambda l: (l["text"] != "") & urls.scheme_of(l["url"]).isin("http", "https"),
    )
    host = F.lower(urls.netloc_of(page_url))

    def internal(host_: Column) -> Column:
        return F.transform(
            _first_distinct(found, lambda l: l),  # array_distinct compares structs pair by pair
            lambda l: F.struct(
                l["text"].alias("text"),
                l["url"].alias("url"),
                (F.lower(urls.netloc_of(l["url"])) == host_).alias("is_internal"),
            ),
        )

    return let(host, internal).cast(LINKS)


def _links(df: DataFrame) -> DataFrame:
    return df.withColumn("links", _over(_page_links))


def _faqs(nodes: Column, texts: Column, _: Column, limits: Limits) -> Column:
    """Question and answer pairs: `details` elements, then question-like headings."""

    def from_details(d: Column) -> Column:
        summary = _first(_live_tags(_subtree(d, nodes), "summary"))

        def build(s: Column) -> Column:
            direct = F.coalesce(s["parent"] == d["i"], F.lit(False))
            answer = F.filter(
                F.transform(
                    _texts(d, texts),
                    lambda t, j: F.when(
                        direct & (j + d["t0"] >= s["t0"]) & (j + d["t0"] < s["t1"]), F.lit(None)
                    ).otherwise(t),
                ),
                lambda t: t.isNotNull(),
            )
            return F.struct(
                F.coalesce(_text(s, texts), F.lit("")).alias("question"),
                clean_text(F.array_join(answer, " ")).alias("answer"),
            )

        return let(summary, build)

    def from_heading(h: Column) -> Column:
        answer = _following(h, nodes, texts, "stop4", limits.faq_stop)
        return F.struct(
            _text(h, texts).alias("question"),
            _cut(answer, limits.faq_answer).alias("answer"),
        )

    asked = F.filter(
        _live_tags(nodes, "h2", "h3", "h4"),
        lambda h: _text(h, texts).rlike(fixed.FAQ_QUESTION_PATTERN),
    )
    candidates = F.concat(
        F.transform(_live_tags(nodes, "details"), from_details), F.transform(asked, from_heading)
    )
    complete = F.filter(candidates, lambda q: (q["question"] != "") & (q["answer"] != ""))
    return _first_distinct(complete, lambda q: q["question"]).cast(FAQS)


def _sections(nodes: Column, texts: Column, _: Column, limits: Limits) -> Column:
    def section(h: Column) -> Column:
        content = _following(h, nodes, texts, "stop3", limits.section)
        return F.struct(
            _text(h, texts).alias("heading"),
            F.substring(h["tag"], 2, 1).cast("int").alias("level"),
            _cut(content, limits.section).alias("content"),
        )

    found = F.filter(
        F.transform(_live_tags(nodes, "h1", "h2", "h3"), section),
        lambda s: (s["heading"] != "") & (s["content"] != ""),
    )
    return (found if limits.sections is None else F.slice(found, 1, limits.sections)).cast(SECTIONS)


def _faqs_and_sections(df: DataFrame, limits: Limits) -> DataFrame:
    return df.withColumns({"faqs": _over(_faqs, limits), "sections": _over(_sections, limits)})


def _content(df: DataFrame, limits: Limits) -> DataFrame:
    nodes, texts = F.col("nodes"), F.col("texts")
    roots = [_first(_live_tags(nodes, tag)) for tag in ("main", "article", "body")]
    df = df.withColumn("_root", F.coalesce(*roots))
    whole = F.array_join(texts, " ")
    text = F.when(F.col("_root").isNull(), whole).otherwise(
        F.array_join(_texts(F.col("_root"), texts), " ")
    )
    return df.withColumn("content", _cut(clean_text(text), limits.content)).drop("_root")


def useful_text_score(chars: Column, paragraphs: Column, headings: Column) -> Column:
    total = (
        chars / F.lit(3000.0) * F.lit(0.5)
        + paragraphs / F.lit(12.0) * F.lit(0.3)
        + headings / F.lit(8.0) * F.lit(0.2)
    )
    return round_exact(F.least(F.lit(1.0), total), 3)


def _quality(df: DataFrame) -> DataFrame:
    def optional(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    chars = F.length("content")
    return df.withColumn(
        "quality",
        F.struct(
            optional("status_code", F.lit(200)).cast("int").alias("status_code"),
            chars.alias("content_length"),
            useful_text_score(chars, F.size("paragraphs"), F.size("headings")).alias("useful_text_score"),
            F.size("images").alias("image_count"),
            F.size("links").alias("link_count"),
            optional("scraped_at", F.lit(None)).cast("string").alias("scraped_at"),
            optional("errors", F.array()).cast(STRINGS).alias("errors"),
            optional("render_time_ms", F.lit(None)).cast("int").alias("render_time_ms"),
            optional("final_url", F.lit(None)).cast("string").alias("final_url"),
        ),
    )


def extract_pages(pages: DataFrame, html: str = "html", limits: Limits = WHOLE) -> DataFrame:
    """Page table from fetched HTML. Input: page_url, the HTML column, and any key columns.
    Every step takes time in proportion to the page. Nothing is cut unless `limits` says so.

    Optional inputs page_type, extraction_method, status_code, errors, scraped_at,
    render_time_ms and final_url are carried into the record.
    """
    keep = [c for c in pages.columns if c != html]
    df = whole_texts(pages).withColumn("_dom", dom(F.col(html)))  # declared non-deterministic: runs once
    facts = {"html_empty": F.coalesce(F.col(html), F.lit("")) == "",
             "has_hydration": F.coalesce(contains_any(F.col(html), fixed.HYDRATION_MARKERS), F.lit(False))}
    df = df.select(
        *keep, *(v.alias(k) for k, v in facts.items()),
        F.col("_dom.nodes").alias("nodes"), F.col("_dom.texts").alias("texts"), F.col("_dom.live").alias("live"),
    )
    # what the render decision needs to know about the page as delivered
    nodes = F.col("nodes")
    df = df.withColumns(
        {
            "script_count": F.size(_tags(nodes, "script")),
            "has_spa_root": F.exists(
                nodes,
                lambda n: _attr(n, "id").isin(fixed.SPA_ROOT_IDS)
                | F.map_contains_key(n["attrs"], "data-reactroot"),
            ),
            "body_chars": F.coalesce(
                F.length(_text(_first(_tags(nodes, "body")), F.col("texts"))), F.lit(0)
            ),
        }
    )
    df = df.withColumn("anchors", _over(_anchors))
    df = _drop_noise(_image_records(_page_metadata(df), limits))
    df = _faqs_and_sections(_links(_blocks(df)), limits)
    df = _quality(_content(df, limits)).drop("nodes", "texts", "live")
    extra = {"normalized_page_url": urls.cache_url(F.col("page_url"))}
    if "page_type" not in keep:
        extra["page_type"] = F.lit("other")
    if "extraction_method" not in keep:
        extra["extraction_method"] = F.lit("static")
    return df.withColumns(extra)


def needs_browser(
    html_empty: Column, has_hydration: Column, content_length: Column, paragraph_count: Column,
    title: Column, has_spa_root: Column, script_count: Column, body_chars: Column,
) -> Column:
    """Does static HTML look too thin to be the real page? Inputs are columns of the page table."""
    app = has_spa_root | has_hydration
    return (
        F.when(html_empty, True)
        .when((content_length >= 800) & (paragraph_count >= 2), False)
        .when(content_length < 500, True)
        .when((paragraph_count == 0) & (title != "") & (content_length < 1200), True)
        .when(app & (content_length < 1500), True)
        .when((script_count >= 8) & (body_chars < 800), True)
        .otherwise(False)
    )


def choose_render(
    df: DataFrame, mode: Column, static_html: Column, rendered_html: Column, weak: Column
) -> DataFrame:
    """Which fetch a page uses and how the choice is recorded.

    `mode` is static, auto or browser; `weak` is `needs_browser` on the static page.
    Adds chosen_html (null: page failed) and extraction_method.
    """
    has_static = F.coalesce(static_html, F.lit("")) != ""
    rendered = rendered_html.isNotNull()
    fallback = F.when(has_static, static_html)
    wants = (mode == "browser") | ((mode == "auto") & (~has_static | weak))
    method = (
        F.when(wants & rendered, F.lit("playwright"))
        .when((mode == "browser") & has_static, F.lit("static_after_playwright_failed"))
        .when((mode == "auto") & has_static & weak, F.lit("static_with_playwright_failed"))
        .when(has_static, F.lit("static"))
    )
    return df.withColumns(
        {
            "chosen_html": F.when(wants & rendered, rendered_html).otherwise(fallback),
            "extraction_method": method,
        }
    )
