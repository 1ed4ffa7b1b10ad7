from collections import Counter
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sitelore.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, lang string, size long, uid string"


def documents(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["b", "a", "a", "a", "a", None, "ü"])
        text = rng.choice([None, "", "word " * rng.randint(1, 60), "x  y\tz " * 3, "long " * 900])
        rows.append((None if i == 5 else i % (n - 10), text, source, rng.choice(["en", "de", None]), 1, "u"))
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_stop_at_their_most():
    sizes = {"a": 100, "b": 1000, None: 1000}
    weights = mixing.cyclic_weights(sizes)
    assert weights == {"a": 5.0, "b": 2.0, None: 1.0}
    targets = mixing.quota_targets(sizes, weights)
    assert targets["a"] == 300 and targets["b"] == pytest.approx(1200) and sum(targets.values()) == pytest.approx(2100)


def test_flow_is_cheapest():
    """Against all ways to send small amounts."""
    supply, members = {"p": 2, "q": 2}, {"p": ["x"], "q": ["x", "y"]}
    quota, costs = {"x": 4, "y": 2}, [1, 4, 9]
    flow = mixing.min_cost_flow(supply, members, quota, costs)

    def cost(per_pattern):
        return sum(sum(costs[w // supply[p]] for w in range(n)) for p, n in per_pattern.items())

    best = min(
        (-(a + b + c), cost({"p": a, "q": b + c}))
        for a, b, c in itertools.product(range(7), repeat=3)
        if a <= 6 and b + c <= 6 and a + b <= 4 and c <= 2
    )
    sent = {p: sum(v for (q, _), v in flow.items() if q == p) for p in supply}
    assert (-sum(flow.values()), cost(sent)) == best


def test_overlapping_sources_meet_their_quotas(spark):
    rows = [(i, "w " * (10 + i % 7), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, member array<string>")
    mixed = mixing.mix_sources(docs, F.col("member")).collect()
    sent = {}
    for pieces in {r.sources[0] + r.sources[-1]: r.pieces for r in mixed}.values():
        for p in pieces:
            sent[p.source] = sent.get(p.source, 0) + p.end - p.first
    targets = {s: t for r in mixed for s, t in zip(r.sources, r.targets)}
    for s, t in targets.items():
        assert abs(sent[s] - t) <= 1
    taken = sum(r["size"] * r.repeats for r in mixed)
    assert abs(taken - sum(targets.values())) <= 0.02 * sum(targets.values())


def test_mix_of_odd_documents(spark):
    docs = documents(spark)
    rows = mixing.mix_sources(docs, F.array("source")).collect()
    assert len(rows) == 400
    texts = docs.collect()
    by_source = {}
    for r in texts:
        by_source[r.source] = by_source.get(r.source, 0) + len((r.text or "").split())
    for source, words in by_source.items():
        mine = [r for r in rows if r.sources[0] == source]
        assert {r.source_sizes[0] for r in mine} == {words}
        target, taken = mine[0].targets[0], sum(r["size"] * r.repeats for r in mine)
        # what is missing is small, or less than any document that was left out
        worded = [r for r in mine if r["size"]]
        left_out = [r["size"] for r in worded if r.repeats == min(q.repeats for q in worded)]
        assert -1 <= target - taken < max(0.003 * target, min(left_out))
    assert all(0 <= r.repeats <= 3 and (r["size"] or not r.repeats) for r in rows)
    again = mixing.mix_sources(docs.repartition(7), F.array("source")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text_hash or 0, r.repeats)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    kept = mixing.repeat_documents(docs, F.array("source"))
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.repeats for r in rows)
    assert mixing.mix_sources(docs.limit(0), F.array("source")).count() == 0


def test_hilbert_curve_visits_neighbours(spark):
    """Along the curve, one coordinate changes by one at each step; every cell once."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = spark.range(side**dims)
        axes = [F.pmod(F.floor(F.col("id") / side**i), F.lit(side)).cast("int") for i in range(dims)]
        rows = cells.select(*[a.alias(f"x{i}") for i, a in enumerate(axes)]).withColumn(
            "h", sharding.hilbert_index([F.col(f"x{i}") for i in range(dims)], bits)
        ).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(side**dims))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(a[i] - b[i]) for i in range(dims)) == 1


def test_shards_have_near_equal_bytes(spark):
    docs = documents(spark, 500).cache()
    rows = sharding.hilbert_shards(docs, 8).collect()
    assert len(rows) == 500
    expected = sorted((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((r["size"], r.text_crc32) for r in rows) == expected
    total, longest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for shard in range(8):
        mine = [r for r in rows if r.shard == shard]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 8) <= longest
    last = {}
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        assert r.hilbert >= last.get("h", 0)
        last["h"] = r.hilbert
    assert sharding.hilbert_shards(docs.limit(0), 8).count() == 0
    assert sharding.shard_ranges(sharding.hilbert_shards(docs, 8)).count() == 8


def test_shards_equal_plain_lists(spark):
    """Size, checksum, shard and slot recomputed in Python along the curve's order."""
    rng = random.Random(12)
    texts = [None, "", "ü" * 40, *("x" * rng.randrange(400) for _ in range(300))]
    rows = [(rng.choice([None, *range(250)]), rng.choice([None, "a", "b", "c"]), rng.choice(["en", "de", None]), rng.choice(texts), 1) for _ in range(500)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, slot int").repartition(4)
    got = sharding.hilbert_shards(docs, shards=7).collect()
    plain = lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or "", len((r[3] or "").encode()) + 16, zlib.crc32((r[3] or "").encode()))
    assert Counter((r.doc_id is not None, r.doc_id or 0, r.source or "", r.lang or "", r.size, r.text_crc32) for r in got) == Counter(map(plain, rows))
    order = sorted(got, key=lambda r: (r.hilbert, r.text_crc32, r.doc_id is not None, r.doc_id or 0))
    total, before, slots = sum(r.size for r in got), 0, Counter()
    want = []
    for r in order:
        shard = (2 * before + r.size) * 7 // (2 * total)
        want.append((r.hilbert, r.text_crc32, r.doc_id, r.size, shard, slots[shard]))
        before, slots[shard] = before + r.size, slots[shard] + 1
    # rows that tie in the whole order may swap their places
    key = lambda w: tuple((x is not None, x or 0) for x in w)
    assert sorted(((r.hilbert, r.text_crc32, r.doc_id, r.size, r.shard, r.slot) for r in got), key=key) == sorted(want, key=key)
