"""Table functions called laterally are made row by row; `chunks_by_sql` keeps no texts."""

from pyspark.sql import functions as F

from sitelore.functions.sql import register_chunk_functions
from sitelore.functions.text import clean_text
from sitelore.operators import chunks as chunking
from sitelore.plans import queries


def test_lateral_calls_join_nothing(spark):
    long = " ".join(f"w{i}" for i in range(2500))
    rows = [(0, "A  title here", long), (0, "A  title here", long), (1, None, "one two three four"), (2, "Shop", None), (None, "", "a b c")]
    spark.createDataFrame(rows, "id int, title string, body string").createOrReplaceTempView("lateral_pages")
    register_chunk_functions(spark)
    found = spark.sql("SELECT t.id, c.type_ord, c.piece, c.text FROM lateral_pages t, LATERAL page_pieces(t.title, t.body) c")
    windows = spark.sql("SELECT t.id, w.* FROM lateral_pages t, LATERAL text_windows(t.body) w")
    for df in (found, windows):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    pages = spark.table("lateral_pages")
    pieces = [
        pages.select("id", F.lit(k).alias("type_ord"), F.posexplode(chunking.split_words(clean_text(text))).alias("piece", "text"))
        for k, text in ((0, F.concat(F.lit("Page title: "), F.coalesce("title", F.lit("")))), (2, F.col("body")))
    ]
    want = pieces[0].unionByName(pieces[1])
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect())) and found.count() == 9
    assert sorted(r.words for r in windows.collect()) == [4, 740, 740, 1000, 1000, 1000, 1000]


def test_chunks_by_sql_writes_hashes_not_texts(spark, tmp_path, monkeypatch):
    word = " ".join(f"word{i}" for i in range(1500))
    rows = [(i, f"{word} {i}", "en", "src1", 9) for i in range(4)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    written = {}
    real = queries.materialize
    monkeypatch.setattr(queries, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    by_sql = queries.chunks_by_sql(spark, str(tmp_path)).collect()
    longest = [F.max(F.length(F.col(c).cast("string"))) for c in written["sql-pieces"].columns]
    assert max(written["sql-pieces"].agg(*longest).collect()[0]) < 100
    assert sorted(map(tuple, by_sql)) == sorted(map(tuple, queries.chunk_records(spark, str(tmp_path)).collect())) and by_sql
