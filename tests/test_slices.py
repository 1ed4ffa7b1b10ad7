"""Whole pages go through Python in small slices, whatever size of batch Spark sends."""

import pyarrow as pa
from pyspark.sql import functions as F

from sitelore.functions import html
from sitelore.functions.jsonld import urls_in_json
from sitelore.functions.slices import BYTES, ROWS, by_slices, cut


def test_slices_are_bounded_in_rows_and_bytes():
    texts = ["x" * n for n in [10] * 200 + [BYTES // 3] * 7 + [BYTES * 3, 5]] + [None, ""]
    parts = [p.to_pylist() for p in cut(pa.array(texts))]
    assert sum(parts, []) == texts
    assert max(map(len, parts)) <= ROWS
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= BYTES for p in parts)
    assert [p.to_pylist() for p in cut(pa.array([], pa.string()))] == []
    lists = [["a", "b"], None, []] * 100
    assert sum((p.to_pylist() for p in cut(pa.array(lists, pa.list_(pa.string())))), []) == lists


def test_page_parser_holds_a_slice_of_a_large_batch(spark):
    """The whole batch was once parsed before any of it left the worker."""
    held = by_slices(lambda values: pa.array([len(values)] * len(values), pa.int32()), "int")
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, "10000")
    try:
        pages = spark.range(0, 1000, 1, 1).select(
            "id",
            F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
                F.format_string("<p class='c%d'>text %d</p><script type='application/ld+json'>{\"u\": \"https://a.example/%d\"}</script>", "id", "id", "id")
            ).alias("h"),
        )
        assert pages.select(held(F.col("h")).alias("n")).agg(F.max("n")).first()[0] <= ROWS
        rows = pages.select("id", "h", html.dom(F.col("h")).alias("d")).select("id", "h", "d", urls_in_json(F.expr("filter(transform(d.nodes, n -> n.json), j -> j is not null)")).alias("u"))
        for r in rows.collect():
            parsed = html.parse_html(r["h"])
            assert r["d"]["texts"] == parsed["texts"] and r["d"]["live"] == parsed["live"]
            assert [n.asDict() for n in r["d"]["nodes"]] == [dict(n, attrs=n["attrs"]) for n in parsed["nodes"]]
            assert r["u"] == ([] if r["h"] is None else [f"https://a.example/{r['id']}"])
    finally:
        conf.set(key, before)
