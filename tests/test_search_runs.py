"""Runs of several slices of chunks, and slices of queries that take turns."""

import time

import pandas as pd
import pytest

from sitelore.operators import rank, retrieve
from sitelore.operators.embed import embed, hash_embedder
from sitelore.session import materialize_alone

from test_search_block import _frames


@pytest.mark.parametrize("size", [1, 7, 60])
def test_slices_of_a_run_give_what_one_block_gives(size):
    queries, chunks = _frames(30, 150)
    whole = pd.concat(retrieve._search_block(queries, chunks))
    found = None
    for at in range(0, len(chunks), size):
        new = pd.concat(retrieve._search_block(queries, chunks.iloc[at : at + size]))
        found = new if found is None else retrieve._best_found(pd.concat([found, new], ignore_index=True))
    shown = ["near", "similarity", "rerank_score", "intent_match", "keyword_overlap", "penalty", "vector_score"]
    rows = lambda df: sorted((r.qid, r.chunk_id, r.text_key, list(r.at), *map(str, (getattr(r, c) for c in shown))) for r in df.itertuples())
    assert rows(found) == rows(whole)


def _tables(spark, n_queries: int, n_chunks: int):
    chunks = spark.createDataFrame(
        [(f"s{i % 3 and 1}", f"c{i:04d}", f"call or write to shop {i % 90} about tea number {i % 17}", "section", i) for i in range(n_chunks)],
        "website_id string, chunk_id string, text string, chunk_type string, chunk_index int",
    ).selectExpr("*", "'Tea' AS page_title", "concat('https://e.com/', chunk_index) AS source_url")
    asked = spark.createDataFrame([(f"q{i}", f"s{i % 2}", f"where is shop {i} with tea {i % 5}") for i in range(n_queries)], "qid string, website_id string, query string")
    return retrieve.prepare_queries(asked, hash_embedder(8)), rank.add_features(embed(chunks, "text", hash_embedder(8)))


def _searched(spark, monkeypatch, sizes, runs):
    monkeypatch.setattr(retrieve, "CHUNK_SLICE", sizes[0])
    monkeypatch.setattr(retrieve, "QUERY_SLICE", sizes[1])
    monkeypatch.setattr(retrieve, "RUNS", runs)
    written = []
    monkeypatch.setattr(retrieve, "materialize_alone", lambda df, name: written.append(materialize_alone(df, name)) or written[-1])
    asked, features = _tables(spark, 40, 300)
    results, counts = retrieve.hybrid_search(asked, features, ["chunk_index"])
    near = retrieve.vector_candidates(asked, features)
    return [sorted(map(str, df.collect())) for df in (results, counts, near)], written


def test_turns_and_runs_change_no_result(spark, monkeypatch):
    want, once = _searched(spark, monkeypatch, (10_000, 500), 4)
    got, turns = _searched(spark, monkeypatch, (20, 4), 1)
    assert got == want and want[0] and len(once) == 2 and len(turns) > 4
    # every slice of queries meets each chunk in one turn only, and a task gives a query's best rows once for its whole run
    found = [t for t in turns if "near" in t.columns]
    asked = [{r.qid for r in t.select("qid").distinct().collect()} for t in found]
    assert sum(map(len, asked)) == 40 == len(set().union(*asked))
    rows = sum(t.count() for t in found)
    assert rows <= 40 * (20 + 25) * (4 + 1)  # four cores; slices of 20 chunks once gave this much for each of 15


def test_exchange_files_go_with_the_write(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()

    def exchanged() -> int:
        return sum(1 for b in manager.diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in b)

    df = spark.range(1000).repartition(3, "id")
    before = exchanged()
    table = materialize_alone(df, "exchanged")
    until = time.time() + 20
    while exchanged() > before and time.time() < until:
        time.sleep(0.2)
    assert exchanged() <= before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
