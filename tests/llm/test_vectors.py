import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelore.llm import lattice, routing

SCHEMA = "vec_id long, embedding array<float>, label int, score double, part int"
ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, 2.0]]


def rows(seed=4, n=400, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims))
    x = centres[rng.integers(0, 30, n)] + 0.12 * rng.normal(size=(n, dims))
    x[50:80] = x[50]  # copies
    x[80] = x[50] * 3
    out = [(i, [float(np.float32(v)) for v in x[i]], int(rng.integers(0, 3)) if i % 17 else None, 0.5, 1) for i in range(n)]
    return out + [(n + i, v, 1, 0.5, 1) for i, v in enumerate(ODD)]


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.asarray(a), np.asarray(b)
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def test_lattice_points_are_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.nearest_e8(x)
    roots = lattice._roots()
    assert roots.shape == (240, 8) and np.allclose((roots**2).sum(axis=1), 2)
    d = ((x - p) ** 2).sum(axis=1)
    for r in roots:  # no neighbour is nearer, so the point is the nearest
        assert (((x - p - r) ** 2).sum(axis=1) >= d - 1e-9).all()


def test_links_are_those_of_all_pairs(spark):
    data = rows()
    links, name = {r[0]: 0 for r in data}, {r[0]: r[0] for r in data}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in itertools.combinations([r for r in data if usable(r[1]) and r[2] is not None], 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.93:
            links[a[0]] += 1
            links[b[0]] += 1
            x, y = find(a[0]), find(b[0])
            name[max(x, y)] = min(x, y)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    for block in (1500, 8):
        got = {r.vec_id: r for r in lattice.near_duplicates(df, block=block).collect()}
        assert len(got) == len(data)
        found, true = sum(r.n_links for r in got.values()), sum(links.values())
        assert true > 1000 and all(got[i].n_links <= links[i] for i in links)
        assert found >= 0.995 * true
        if found == true:
            assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in name}
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def nearest_by_brute_force(data, queries, top):
    fit = [r for r in data if usable(r[1]) and len(r[1]) == 8]
    out = {}
    for q in (r for r in fit if r[0] in queries):
        best = sorted((-cosine(q[1], r[1]), r[0]) for r in fit if r[0] != q[0])[:top]
        out[q[0]] = [(i, -s) for s, i in best]
    return out


def test_neighbours_against_brute_force(spark):
    data = rows(n=2000)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    queries = {i for i, *_ in data if i % 10 == 0}
    truth = nearest_by_brute_force(data, queries, 5)
    fit = routing.Fit(sample=600, held_out=100)
    found = {}
    for r in routing.search(df, F.col("vec_id") % 10 == 0, 5, fit, slice_rows=100, block_queries=40).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(truth)
    hits = sum(len({i for i, _ in truth[q]} & {v for _, v, _ in found[q]}) for q in truth)
    assert hits >= 0.9 * sum(len(t) for t in truth.values())
    by_id = {r[0]: r[1] for r in data}
    for q, mine in found.items():
        mine.sort()
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - cosine(by_id[q], by_id[v])) < 1e-12 for _, v, s in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
    # copies tie exactly: the smaller ids come first
    assert [v for _, v, _ in sorted(found[50])] == [51, 52, 53, 54, 55]


def test_few_rows_and_none(spark):
    data = [(0, [1.0, 0.0], 1, 0.0, 0), (50, [1.0, 1.0], 1, 0.0, 0), (51, [0.0, 2.0], 1, 0.0, 0)]
    df = spark.createDataFrame(data, SCHEMA)
    got = routing.search(df, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 50), (0, 2, 51), (50, 1, 0), (50, 2, 51)]
    assert routing.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert routing.search(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_every_length_is_indexed_and_asked(spark):
    rng = np.random.default_rng(9)
    data = [(i, rng.normal(size=4 if i % 3 else 6).tolist(), 1, 0.0, 0) for i in range(90)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, score double, part int")
    got = routing.search(df, F.col("vec_id") < 30, 3, slice_rows=20, block_queries=8).collect()
    wanted = set()
    for q, x, *_ in data[:30]:
        near = sorted((-cosine(x, y), i) for i, y, *_ in data if i != q and len(y) == len(x))[:3]
        wanted |= {(q, rank, i) for rank, (_, i) in enumerate(near, 1)}
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == sorted(wanted)


def test_parts_are_balanced():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = routing.nearest_rows(x, x, 8, same=True)
    part = routing.balanced_parts(x, graph, 7)
    sizes = np.bincount(part, minlength=7)
    assert sizes.max() <= np.ceil(1000 / 7 * 1.05) + 1 and sizes.min() > 0
    assert (part[graph] == part[:, None]).mean() > 1.5 / 7  # far fewer neighbours are cut than by chance


@pytest.mark.parametrize("n, parts", [(500, 20), (2000, 40)])
def test_small_tables_go_through_their_parts(spark, n, parts):
    """Vectors without clusters, as many as the small tables hold: parts, recall and exact scores."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 32)).astype("float32").astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    router = routing.routers_of(df, 5, routing.Fit())[32]
    order, before = router.ranked(x / np.linalg.norm(x, axis=1)[:, None])
    assert router.parts == parts and np.bincount(order[:, 0], minlength=parts).max() < n / 4
    assert router.visits(before).mean() < 0.75 * parts
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits, got = 0, {}
    for r in routing.search(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, n, 50):
        s = u @ u[q]
        s[q] = -2
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5] and len({v for _, v, _ in mine}) == 5
        assert all(abs(s[v] - c) < 1e-12 for _, v, c in mine)
        hits += len(set(np.argsort(-s)[:5]) & {v for _, v, _ in mine})
    assert hits >= 0.9 * 5 * len(range(0, n, 50))


def test_repeated_ids_are_one_neighbour(spark):
    data = [(0, [1.0, 0.1]), (0, [1.0, 0.2]), (1, [1.0, 0.15]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = routing.search(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 3), (3, 2)]
    got = routing.search(df, F.col("vec_id") == 1, 3).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 0), (2, 3), (3, 2)]
