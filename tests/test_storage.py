"""Store batches and versions, site documents, SQL table functions, event-time streams, chat payloads."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sitelore.functions.sql import register_chunk_functions
from sitelore.functions.text import clean_text
from sitelore.operators import chunks as chunking
from sitelore.operators import prompt, store
from sitelore.operators.store import ChunkStore
from sitelore.sources import files, site_files
from sitelore.streaming.event_time import windowed_counts

CHUNKS = "chunk_id string, website_id string, chunk_index int, text string, chunk_type string"


def chunks(spark, ids, site="s", text="t"):
    return spark.createDataFrame([(i, site, n, f"{text} {i}", "section") for n, i in enumerate(ids)], CHUNKS)


def rows(s):
    return sorted((r.website_id, r.chunk_id, r.text) for r in s.read().collect())


def test_batches_equal_a_dictionary(spark, tmp_path, monkeypatch):
    """Random changes; the store holds what a dictionary holds, before and after compaction."""
    monkeypatch.setattr(store, "COMPACT_SHARE", 1e9)
    monkeypatch.setattr(store, "COMPACT_BATCHES", 5)
    rng = random.Random(2)
    s, held = ChunkStore(spark, str(tmp_path / "store")), {}
    assert not s.exists() and s.delete_sites(spark.createDataFrame([("a",)], "website_id string")) == 0
    for step in range(9):
        site = rng.choice("abc")
        if step % 4 == 3:
            gone = [i for i, (w, _) in held.items() if w == site]
            assert s.delete_sites(spark.createDataFrame([(site,), ("",)], "website_id string")) == len(gone)
            held = {i: v for i, v in held.items() if v[0] != site}
        else:
            ids = [f"{site}{rng.randrange(8)}" for _ in range(4)]
            replace = rng.random() < 0.4
            done = s.upsert(chunks(spark, ids, site, f"v{step}"), replace, {"sections": F.count_if(F.col("chunk_type") == "section")})
            before = [i for i, (w, _) in held.items() if w == site]
            assert done == {"upserted": len(set(ids)), "deleted": len(before) if replace else 0, "sections": len(set(ids))}
            if replace:
                held = {i: v for i, v in held.items() if v[0] != site}
            held |= {i: (site, f"v{step} {i}") for i in ids}
        assert rows(s) == sorted((w, i, t) for i, (w, t) in held.items())
    _, batches = s.version()
    assert 1 <= len(batches) <= 5
    s.compact()
    s.vacuum()
    assert len(s.version()[1]) == 1 and rows(s) == sorted((w, i, t) for i, (w, t) in held.items())
    assert len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("batch-")]) == 1


def test_a_failed_write_changes_nothing(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "store"))
    s.upsert(chunks(spark, ["x", "y"]))
    before = s.version()
    with pytest.raises(Exception, match="missing text"):
        s.upsert(spark.createDataFrame([("z", "s", 0, " ", "section")], CHUNKS))
    assert s.version() == before and len(rows(s)) == 2
    assert s.upsert(chunks(spark, ["x"]).limit(0))["upserted"] == 0 and s.version() == before
    with pytest.raises(RuntimeError, match="another writer"):
        s._switch(before[0] - 1, [])
    assert s.site("s", {"chunk_type": "section"}).count() == 2 and s.site("t").count() == 0


def page_rows(spark):
    pages = spark.createDataFrame(
        [("w1", i, f"https://a.com/{i}", f'Title "{i}"', f"Line\nbreak, {{\"page_ord\":{i}}} ü") for i in range(30)]
        + [("w2", 0, "https://www.b.com/x", "B", "")],
        "website_id string, page_ord bigint, page_url string, title string, content string",
    )
    sites = spark.createDataFrame(
        [("w1", "https://a.com", "A"), ("w2", "https://www.b.com", None), ("w3", "https://c.com", "C")], "website_id string, url string, name string"
    )
    return sites, pages


def test_site_documents_round_trip(spark, tmp_path):
    sites, pages = page_rows(spark)
    folder = str(tmp_path / "sites")
    made = {r.name: r for r in site_files.write_site_files(sites, pages, folder).collect()}
    assert sorted(r.pages for r in made.values()) == [0, 1, 30]
    for name, r in made.items():
        text = (tmp_path / "sites" / name).read_bytes()
        doc = json.loads(text)
        assert len(text) == r.bytes and len(doc["pages"]) == len(doc["primary_content"]["pages"]) == r.pages == doc["metadata"]["pages_scraped"]
    # the reader of whole documents and the one by line agree
    whole = files.read_knowledge(spark, folder).select(F.explode("pages").alias("p")).select("p.page_url", "p.title", "p.content")
    found, stored = site_files.cached_pages(spark, spark.createDataFrame([("http://www.a.com/",), ("https://c.com",), ("https://no.com",)], "url string"), folder)
    assert {r.url: r.cached_name in made for r in found.collect()} == {"http://www.a.com/": False, "https://c.com": True, "https://no.com": False}
    every = site_files.read_site_pages(spark, folder)
    assert sorted(map(tuple, every.select("page_url", "title", "content").collect())) == sorted(map(tuple, whole.collect()))
    want = sorted(map(tuple, pages.select("website_id", "page_ord", "page_url", "title", "content").collect()))
    assert sorted(map(tuple, every.select("website_id", "page_ord", "page_url", "title", "content").collect())) == want
    assert stored.count() == 0 and site_files.catalog(spark, folder).count() == 3


def test_sql_windows_equal_the_column_function(spark):
    texts = ["", "a b c", "a b c d", " ".join(map(str, range(1000))), " ".join(map(str, range(1001))), " x \ty  " * 1500, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    register_chunk_functions(spark)
    df.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT t.id, w.piece, w.text FROM sql_texts t, LATERAL text_windows(t.body) w").collect()
    want = df.select("id", F.posexplode(chunking.split_words(clean_text(F.col("body")))).alias("piece", "text")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    pieces = spark.sql("SELECT t.id, p.* FROM sql_texts t, LATERAL page_pieces('A title here', t.body) p WHERE t.id = 2 ORDER BY type_ord").collect()
    assert [(r.chunk_type, r.heading, r.text) for r in pieces] == [
        ("page_summary", "A title here", "Page title: A title here"), ("paragraph_group", "", "a b c d"),
    ]


def test_hours_go_on_where_they_stopped(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "event_id bigint, ts timestamp, kind string, value double"

    def arrive(name, ids):
        data = [(i, start + timedelta(minutes=7 * i), "ab"[i % 2], 1.0) for i in ids]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def hours():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        metrics = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]
        found = windowed_counts(stream, ["event_id"], ["kind"], "ts", metrics, delay="10 days", folder=str(tmp_path / "state"))
        return {(r.starts, r.kind): (r.n, r.total) for r in found.collect()}

    def by_hand(ids):
        out = {}
        for i in set(ids):
            at = (start + timedelta(minutes=7 * i)).replace(minute=0, second=0)
            n, total = out.get((at, "ab"[i % 2]), (0, 0.0))
            out[at, "ab"[i % 2]] = (n + 1, total + 1.0)
        return out

    arrive("one", [*range(40), 3, 3, 17])
    assert hours() == by_hand(range(40))
    arrive("two", [*range(30, 60), 5])  # repeats and late rows of the first files
    assert hours() == by_hand(range(60))


def test_chat_payload(spark):
    messages = F.array(F.struct(F.lit("user").alias("role"), F.lit('Say "hi"').alias("content")))
    df = spark.range(1).select(prompt.chat_payload(messages, "m", 0.2).alias("a"), prompt.chat_payload(messages, "m", max_tokens=9).alias("b"))
    r = df.first()
    assert json.loads(r.a) == {"model": "m", "messages": [{"role": "user", "content": 'Say "hi"'}], "temperature": 0.2}
    assert json.loads(r.b)["max_tokens"] == 9 and "temperature" not in json.loads(r.b)


def test_nothing_is_cut_unless_asked(spark):
    found = spark.createDataFrame(
        [("q", i, f"c{i}", "word " * 1000, "", "", "section", 0.5, None) for i in range(1, 12)],
        "qid string, rank int, chunk_id string, text string, source_url string, page_title string, chunk_type string, score double, distance double",
    )
    whole = prompt.rag_context(found, prompt.Sizes()).first().context
    assert whole.count("[Source ") == 11 and whole.count("word") == 11000
    cut = prompt.rag_context(found, prompt.Sizes(chunks=2, chunk_chars=9)).first().context
    assert cut.count("[Source ") == 2 and cut.count("word") == 4
    assert prompt.format_sources(found, prompt.Sizes()).count() == 11 and prompt.format_sources(found, prompt.Sizes(sources=3)).count() == 3
    long = F.array(*[F.struct(F.lit("user").alias("role"), F.lit(f"m{i}").alias("content")) for i in range(12)])
    sizes = spark.range(1).select(F.size(prompt.prior_messages(long, F.lit("x"), prompt.Sizes())), F.size(prompt.prior_messages(long, F.lit("x"), prompt.Sizes(messages=6))))
    assert tuple(sizes.first()) == (12, 6)
    text = spark.range(1).select(prompt.site_system_prompt(F.lit("n"), F.lit("u"), F.repeat(F.lit("y"), 20000), prompt.Sizes()).alias("t")).first().t
    assert text.count("y") > 20000 - 1


def test_histories_across_blocks(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["", " ", f"m{t}", f"n{t}"])) for c, n in ((1, 50), (2, 3)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    want = {}
    for c in (1, 2):
        used = [(t, r, x) for k, t, r, x in rows if k == c and r != "system" and x.strip()]
        for i, (t, _, _) in enumerate(used):
            want[c, t] = [(r, x) for _, r, x in used[max(0, i - 4) : i + 1]]
    for block in (5, 7, 1 << 16):
        got = {(r.conv_id, r.turn): [tuple(m) for m in r.history] for r in prompt.histories(turns, 4, block).collect()}
        assert got == want
