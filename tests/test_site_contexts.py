"""Contexts of whole sites hold whole texts."""

import hashlib

from sitelore import fixed
from sitelore.plans.queries import site_contexts

WORDS = " ".join(f"word{i}" for i in range(900))


def test_contexts_hold_whole_texts_and_all_sections(spark, tmp_path):
    home = f"<html><body><main><h1>Home</h1><p>{WORDS} ends here</p></main></body></html>"
    heads = "".join(f"<h2>Head {i}</h2><p>{WORDS} part {i}</p>" for i in range(6))
    rows = [
        (1, "https://tea.example/", home), (2, "https://tea.example/about", f"<html><body><main>{heads}</main></body></html>"),
        (3, "https://tea.example/contact", f"<html><body><main><p>{WORDS} last</p></main></body></html>"),
    ]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = site_contexts(spark, str(tmp_path)).collect()
    text = "\n".join([
        fixed.CONTEXT_SITE_HEADER, "Name: https://tea.example", "URL: https://tea.example", "Pages analyzed: 3", "", fixed.CONTEXT_PRIMARY_HEADER,
        fixed.CONTEXT_PRIMARY_NOTE, "", fixed.CONTEXT_HOMEPAGE_HEADER, "Title: Home", "\n### Home", f"{WORDS} ends here", f"\nMain content: Home {WORDS} ends here",
        fixed.CONTEXT_RULE, *[line for i in range(6) for line in (f"\n### Head {i}", f"{WORDS} part {i}")], fixed.CONTEXT_RULE, f"{WORDS} last",
        fixed.CONTEXT_RULE,
    ])
    assert [(r.chars, r.context_md5) for r in found] == [(len(text), hashlib.md5(text.encode()).hexdigest())]
