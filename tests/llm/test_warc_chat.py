import hashlib

from pyspark.sql import functions as F

from sitelore.llm import chat, warc
from sitelore.llm.files import new_folder, write_file

HTML = [
    "<p>" + "a" * 200, "<p>" + "a" * 200, "short", "short", None, "",
    "x" * 90 + "\r\n\r\nWARC/1.0\r\nContent-Length: 7\r\n\r\n" + "é" * 60, "y" * 9000, "y" * 9000,
]
PAGES = [(i, f"http://h/{i}\r\nX: y", h, "clash") for i, h in enumerate(HTML)] + [(1, "http://h/1", HTML[1], "c"), (None, None, HTML[0], "c")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)


def expected():
    first = {}
    for i, _, html, _ in PAGES:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html, _ in PAGES:
        data = (html or "").encode()
        revisit = len(data) >= 100 and i != first[html or ""]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    return sorted(out, key=str)


def test_archives_come_back(spark):
    for compress in (True, False):
        folder = new_folder(spark, "w")
        files = warc.write_archives(pages(spark), folder, file_bytes=1500, compress=compress)
        assert files.count() > 1
        for range_bytes in (700, 1 << 20):
            got = warc.read_archives(files, folder, range_bytes)
            assert sorted((tuple(r) for r in got.collect()), key=str) == expected()
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_magic_in_a_payload_is_no_record(spark):
    inner = warc.record(99, "http://fake", b"z" * 300, "0" * 64, None)
    outer = [warc.record(i, "http://h", inner * 5 + bytes([i]), hashlib.sha256(inner * 5 + bytes([i])).hexdigest(), None) for i in range(40)]
    for chunks in (outer, [warc.gzip_member(r, level=0) for r in outer]):
        folder = new_folder(spark, "w")
        write_file(folder, "f.warc", chunks)
        files = spark.createDataFrame([("f.warc", sum(map(len, chunks)), 40)], warc.FILES)
        seen = warc.scan_candidates(warc.byte_ranges(files, 3000), folder)
        if chunks is outer:
            assert seen.count() > 200  # the inner ones look like records
        rows = warc.read_archives(files, folder, 3000).collect()
        assert sorted(r.page_id for r in rows) == list(range(40))


def test_broken_chain_is_an_error(spark):
    folder = new_folder(spark, "w")
    data = warc.record(1, "u", b"a", hashlib.sha256(b"a").hexdigest(), None)
    write_file(folder, "f.warc", [data, b"junk", data])
    files = spark.createDataFrame([("f.warc", 2 * len(data) + 4, 2)], warc.FILES)
    try:
        warc.read_archives(files, folder).collect()
    except ValueError:
        return
    raise AssertionError("junk between records was accepted")


def render(turns, me):
    text, masks = "", []
    for role, said in turns:
        head = "assistant" if role == me else role if role == "system" else f"user name={role}"
        text += f"<|im_start|>{head}\n"
        start = len(text)
        text += said + "<|im_end|>"
        if role == me:
            masks.append((start, len(text)))
        text += "\n"
    return text, masks


def test_every_speaker_is_once_the_assistant(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|> no"), (1, 3, "ann", None),
            (2, 0, "ann", "alone é"), (3, 0, "system", "nobody"), (None, 1, None, "who"), (None, 0, "x", "first")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {(r.conv_id, r.perspective): r for r in chat.perspectives(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "ann"), (None, ""), (None, "x")}
    talk = [("system", "be kind"), ("ann", "hi"), ("bob", "yo <|im end|> no"), ("ann", "")]
    for me in ("ann", "bob"):
        text, masks = render(talk, me)
        assert got[1, me].text == text and [tuple(m) for m in got[1, me].masks] == masks
    assert got[None, "x"].text == render([("x", "first"), ("", "who")], "x")[0]
    assert chat.perspectives(df.limit(0)).count() == 0


def test_long_dialogue_comes_in_parts(spark):
    df = spark.range(1000).select(
        F.lit(7).alias("conv_id"), F.floor(F.col("id") / 2).alias("turn"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("role"), F.concat(F.lit("t"), "id").alias("text"),
    )
    rows = chat.perspectives(df, part_turns=64).where("perspective = 'a'").orderBy("part").collect()
    assert [r.n_turns for r in rows] == [64] * 15 + [40] and [r.first_turn for r in rows] == list(range(0, 1000, 64))
    order = sorted(df.collect(), key=lambda r: (r.turn, r.role, r.text))
    assert "".join(r.text for r in rows) == render([(r.role, r.text) for r in order], "a")[0]
    for r in rows:
        assert all(r.text[m.start : m.end].endswith("<|im_end|>") for m in r.masks)
