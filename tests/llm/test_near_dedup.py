import random

import numpy as np
import pytest

from sitelore.llm import components, darts, near_dedup

SCHEMA = "doc_id long, text string, class_id string"


def jaccard(a, b):
    x, y = (
        {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (near_dedup.words_of(a), near_dedup.words_of(b))
    )
    return len(x & y) / len(x | y)


def classes_by_brute_force(rows):
    """Smallest doc_id reachable over all pairs of documents with words."""
    name = {i: i for i, _ in rows}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    worded = [(i, t) for i, t in rows if near_dedup.words_of(t)]
    for k, (i, a) in enumerate(worded):
        for j, b in worded[:k]:
            if jaccard(a, b) >= 0.8:
                x, y = find(i), find(j)
                name[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    shared = " ".join(word() for _ in range(40))  # a passage that many clean documents hold
    rows = [None, "", " \n", "One two.", "one, TWO", "!!", "!!", "a b c d e", "a b c d f"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(5, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [shared + " " + " ".join(word() for _ in range(60)) for _ in range(20)]
    chain = [word() for _ in range(100)]  # neighbours are alike, the ends are not
    for _ in range(12):
        rows.append(" ".join(chain))
        at = rng.randrange(95)
        chain[at : at + 4] = [word() for _ in range(4)]
    rows.append("long " * 30_000)
    rng.shuffle(rows)
    return list(enumerate(rows, start=10))


def test_classes_are_those_of_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(5)
    got = near_dedup.near_duplicate_classes(df).collect()
    assert {r.doc_id: r.class_id for r in got} == classes_by_brute_force(rows)
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_kept_rows(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "A B c d e f g!", "y"), (3, None, "z"),
            (4, "", "z"), (None, "a b c d e f g", "n"), (5, "other words are here now", "o"), (5, "a second text under the id", "p")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.dropDuplicates().where("doc_id <> 2").collect()))
    assert near_dedup.keep_first(df.limit(0)).count() == 0
    weighted = near_dedup.near_duplicate_classes(df, weighted=True)
    assert weighted.where("doc_id = 2").first().class_id == 1


def test_buckets_are_finished_beyond_their_first_document(spark):
    """A bucket whose first document is unlike two alike ones: the leader alone finds nothing."""
    words = [f"w{i}" for i in range(200)]
    texts = {1: " ".join(words[:100]), 2: " ".join(words[100:]), 3: " ".join([*words[100:199], "new"])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    signed = near_dedup.sign_documents(df, False).selectExpr("doc_id as uid", "signature", "shingles").cache()
    buckets = spark.createDataFrame([(0, 0, i, 1, 400) for i in texts], "bucket long, band int, uid long, a long, size int")
    groups = spark.createDataFrame([], "id long, component long")
    links = near_dedup.bucket_links(buckets, groups, signed, 0.8)
    assert [tuple(sorted(r)) for r in links.collect()] == [(2, 3)]


def test_blocks_take_bands_instead_of_signatures(spark):
    """Only the bands before a bucket's own travel with the sets; a pair of an earlier band is left to that band."""
    words = [f"w{i}" for i in range(200)]
    texts = {1: " ".join(words[:100]), 2: " ".join(words[100:]), 3: " ".join([*words[100:199], "new"])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    signed = near_dedup.sign_documents(df, False).selectExpr("doc_id as uid", "bands", "shingles").cache()
    groups = spark.createDataFrame([], "id long, component long")
    for band, expected in ((0, [(2, 3)]), (31, [])):
        buckets = spark.createDataFrame([(0, band, i, 1, 400) for i in texts], "bucket long, band int, uid long, a long, size int")
        links = near_dedup.bucket_links(buckets, groups, signed, 0.8)
        assert [tuple(sorted(r)) for r in links.collect()] == expected


def test_low_estimates_do_not_lose_links_of_a_bucket(spark):
    """Two documents at exactly 0.8 whose signatures agree in less than 0.68 of their coordinates."""
    rng = random.Random(104)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(139)]
    other = words[:-15] + ["".join(rng.choices("abcdefgh", k=5)) for _ in range(15)]
    texts = {1: "a b c d e f g", 2: " ".join(words), 3: " ".join(other)}
    assert jaccard(texts[2], texts[3]) == 0.8
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    signed = near_dedup.sign_documents(df, False).selectExpr("doc_id as uid", "signature", "shingles").cache()
    a, b = (np.frombuffer(r.signature, "uint32") for r in signed.where("uid > 1").collect())
    assert (a == b).mean() < 0.68
    buckets = spark.createDataFrame([(0, 0, i, 1, 400) for i in texts], "bucket long, band int, uid long, a long, size int")
    groups = spark.createDataFrame([], "id long, component long")
    links = near_dedup.bucket_links(buckets, groups, signed, 0.8)
    assert [tuple(sorted(r)) for r in links.collect()] == [(2, 3)]


@pytest.mark.parametrize("bounds", [{"BLOCK": 3, "COLUMNS": 4}, {"BLOCK_BYTES": 1500, "COLUMN_BYTES": 2500}, {"INDEX_BYTES": 900}])
def test_large_buckets_are_cut_into_blocks(spark, monkeypatch, bounds):
    for name, most in bounds.items():
        monkeypatch.setattr(near_dedup, name, most)
    rows = corpus(seed=8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicate_classes(df).collect()
    assert {r.doc_id: r.class_id for r in got} == classes_by_brute_force(rows)


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_weighted_jaccard(weighted):
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 4000).astype("uint64")
    errors = []
    for n in (1, 3, 40, 600, 4000):
        for keep in (1.0, 0.9, 0.6):
            weights = rng.gamma(2.0, 3.0, n) if weighted else np.ones(n)
            other = np.where(rng.random(n) < keep, weights, weights * (0.4 if weighted else 0.0))
            a = darts.signature(pool[:n], weights, 512)
            on = other > 0
            if not on.any():
                continue
            b = darts.signature(pool[:n][on], other[on], 512)
            errors.append((a == b).mean() - np.minimum(weights, other).sum() / np.maximum(weights, other).sum())
    assert np.abs(errors).max() < 0.1 and abs(np.mean(errors)) < 0.02


def test_names_and_sets_are_exchanged_once(spark, monkeypatch):
    """Plans without broadcasts: one exchange of bucket names feeds both sides of their join, and sets
    are found by uid where they lie; what moves is the narrow side, then the sets to their comparison."""
    plans, write = {}, near_dedup.materialize

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(near_dedup, "materialize", seen)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words[:100])), (2, " ".join([*words[:99], "new"])), (3, " ".join(words[200:])), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = near_dedup.near_duplicate_classes(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.class_id for r in got} == classes_by_brute_force(rows)
    named = [p for p in plans.get("shared", plans["buckets"]) if "explode" in p]
    assert [p.count("- Exchange hashpartitioning(bucket") for p in named] == [1]
    assert [p.count("- Exchange hashpartitioning(") for p in plans["links"]] == [2, 2]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("near_dedup")]


def test_bucket_names_tell_their_band():
    names = np.random.default_rng(2).integers(0, 2**32, (50, near_dedup.BANDS * near_dedup.ROWS)).astype("uint32")
    keys = near_dedup.band_keys(names)
    assert (keys % near_dedup.BANDS == np.arange(near_dedup.BANDS)).all() and len(np.unique(keys)) == keys.size


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    name = {i: i for e in edges for i in e}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        name[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {i: find(i) for a, b in edges if a != b for i in (a, b)}
    assert len(got) == len({r.id for r in got})
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plans_of_many_rounds_stay_narrow(spark, monkeypatch):
    """The driver holds the plans, their broadcasts and a thread for each: a round of components has one
    join and broadcasts nothing, and what is read several times is read from files."""
    plans, write = {}, near_dedup.materialize

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(near_dedup, "materialize", seen)
    monkeypatch.setattr(components, "materialize", seen)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.keep_first(df)
    plans["kept"] = [kept._jdf.queryExecution().executedPlan().toString()]
    assert {r.doc_id for r in kept.collect() if r.text and near_dedup.words_of(r.text)} == {
        i for i, least in classes_by_brute_force(rows).items() if i == least and near_dedup.words_of(dict(rows)[i])
    }
    assert len(plans["edges"]) > 4
    assert max(p.count("Join") for p in plans["edges"]) == 1 and not any("Broadcast" in p for p in plans["edges"])
    reads = {name: max(p.count("FileScan") for p in plans[name]) for name in ("edges", "dealt", "kept")}
    assert reads["edges"] <= 2 and reads["dealt"] <= 5 and reads["kept"] <= 4, reads
