import random
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from sitelore.llm import mixing, near_dedup, toxicity
from sitelore.session import materialize

BAD = ["grobble", "grobbling", "snarf", "vexo"]


def corpus(n=1500, seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.choice([3, 30, 60, 60, 1500]))]
        toxic = rng.random() < 0.12
        if toxic:
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words), rng.choice(["en", None]), rng.choice(["s1", "s2", None]), 1))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    docs += [(n, None, "en", "s1", 0), (n + 1, "", "en", "s1", 0), (None, "plain text", "en", "s1", 0), (3, docs[3][1], "en", "s1", 0)]
    labels += [(3, 0, None), (None, 1, 1)]
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(spark):
    docs, labels = frames(spark)
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == 1504 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    known = {i: t for i, _, t in corpus()[1] if t is not None}
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    counts = Counter(held)
    assert counts[1, 1] >= 0.9 * (counts[1, 1] + counts[0, 1]) and counts[1, 0] <= 0.02 * (counts[1, 0] + counts[0, 0])


def test_labels_of_the_held_out_third_are_not_used(spark):
    docs, labels = frames(spark)
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) as toxic")
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_the_sample_is_bounded_when_an_id_repeats(spark, monkeypatch):
    docs = spark.createDataFrame([(7, f"text {'ab'[i % 2] * (i + 1)}", "en", "s1", 1) for i in range(60)], DOCS)
    docs = docs.unionByName(docs.limit(10))
    seen = []
    trained = toxicity.nn_pu
    monkeypatch.setattr(toxicity, "nn_pu", lambda *a: seen.append(a[2]) or trained(*a))
    toxicity.train(docs, spark.createDataFrame([(7, 1, 1)], LABELS), toxicity.Fit(positives=10, unlabelled=20, steps=2))
    assert (seen[0].sum(), (~seen[0]).sum()) == (10, 20)


def test_stages_keep_columns_named_like_their_helpers(spark):
    names = ["_id", "_hash", "_row", "_kept", "_wordless", "_pattern", "_takes", "_rows", "_mine", "_at", "_copy", "score", "predicted", "c0"]
    docs = spark.createDataFrame([(i, f"some text of number {i}", "s1") for i in range(8)] + [(0, "some text of number 0", "s1"), (9, None, "s1")], "doc_id long, text string, source string")
    docs = docs.select("*", *(F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(n) for n in names))
    rows = Counter(docs.collect())
    clean = toxicity.keep_clean(docs, spark.createDataFrame([(0, 1, 0)], LABELS))
    assert clean.columns == docs.columns and Counter(clean.collect()) == rows
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and Counter(kept.collect()) == Counter(set(rows))
    mixed = mixing.repeat_documents(docs, F.array("source"))
    assert mixed.columns == docs.columns and 0 < mixed.count() and set(mixed.collect()) <= set(rows)


def test_no_labels_and_no_documents(spark):
    docs, labels = frames(spark)
    none = toxicity.toxicity_scores(docs, labels.limit(0)).collect()
    assert len(none) == 1504 and not any(r.predicted for r in none)
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 1250 < kept.count() < 1400


def test_the_negative_part_of_the_risk_stays_positive():
    """Flexible features on few rows: without the correction the unlabelled risk turns negative."""
    rng = np.random.default_rng(0)
    n, width = 300, 400
    positive = np.arange(n) < 60
    rows, cols = np.nonzero(rng.random((n, width)) < 0.1)
    weights, bias = toxicity.nn_pu(rows, cols, positive, width, 0.3, toxicity.Fit(steps=600, decay=0.0))
    z = np.bincount(rows, weights=weights[cols], minlength=n) + bias
    loss = np.logaddexp(0, z)
    assert loss[~positive].mean() - 0.3 * loss[positive].mean() > -0.05


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs, labels = frames(spark)
    extra = docs.where("doc_id < 200 and length(text) > 150").selectExpr(
        "doc_id + 5000 as doc_id", "concat(text, ' tail') as text", "lang", "source", "n_chars"
    )
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = now.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = seen[name] = materialize(stage(spark, now, str(tmp_path)), f"test-{name}")
        assert name == "packing" or now.columns == names
    clean = [r for r in seen["toxicity"].collect()]
    assert not any(set((r.text or "").split()) & set(BAD) and len((r.text or "").split()) < 100 for r in clean)
    # near copies: brute force over the rows that the stage got
    texts = {}
    for r in clean:
        words = near_dedup.words_of(r.text)
        texts[r.doc_id, r.text] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    kept = {(r.doc_id, r.text) for r in seen["near_dedup"].collect()}
    rows = sorted(texts, key=lambda k: (k[0] is None, k))
    inverted, gone = {}, set()
    for k in rows:
        near = Counter(o for s in texts[k] for o in inverted.get(s, ()))
        if any(c / (len(texts[k]) + len(texts[o]) - c) >= 0.8 for o, c in near.items()):
            gone.add(k)
        for s in texts[k]:
            inverted.setdefault(s, []).append(k)
    assert kept == set(rows) - gone and gone
    mixed = Counter(r.doc_id for r in seen["mixing"].collect())
    assert max(mixed.values()) <= 3 and set(mixed) <= {i for i, _ in kept}
    packed = seen["packing"].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    cols = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(str([r[c] for c in cols]) for r in whole) == sorted(str([r[c] for c in cols]) for r in packed)
