import math
import random

import numpy as np

from usagelens.llm import mtree


def brute(rows, queries, k):
    good = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    asked = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in queries if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in asked:
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def vectors(seed, n=400, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(60)]  # one vector in many rows
    rows += [(900, None), (901, [None] * dim), (902, [float("nan")] * dim), (903, [float("inf")] * dim), (None, rows[0][1]), rows[5], (904, []), (905, [0.0] * dim)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<float>, id int, shard string").repartition(3)


def as_float(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_equals_brute_force(spark):
    rows = vectors(1)
    df = frame(spark, rows)
    for shard in (10**6, 60):
        got = mtree.top_k(df, df.filter("vec_id % 20 = 0 OR vec_id > 895"), k=5, block=7, rows_per_shard=shard)
        want = brute(as_float(rows), as_float([r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] > 895)]), 5)
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()} == want


def test_bounds_spare_products():
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, (40, 8))
    x = np.unique(centres[rng.integers(0, 40, 4000)] + rng.integers(-6, 6, (4000, 8)), axis=0)
    root = mtree.build(x)
    ids = [np.array([i]) for i in range(len(x))]
    spent = 0
    for q in range(0, len(x), 97):
        got, computed = mtree.search(root, x, ids, x[q], q, 5)
        s = x @ x[q]
        want = sorted((-int(v), i) for i, v in enumerate(s) if i != q)[:5]
        assert [(-a, b) for a, b in got] == want
        spent += computed
    assert spent < 0.3 * len(range(0, len(x), 97)) * len(x)


def test_pages_keep_the_tree_rules():
    x = np.unique(np.random.default_rng(3).integers(-50, 50, (1500, 4)), axis=0)

    def check(page):
        rows = page.rows if page.children is None else np.concatenate([check(c) for c in page.children])
        assert (np.sqrt(((x[rows] - page.pivot) ** 2).sum(axis=1)) <= page.radius + 1e-9).all()
        assert page.children is not None or len(page.rows) <= mtree.PAGE
        return rows

    assert sorted(check(mtree.build(x))) == list(range(len(x)))


def test_few_rows_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (50, [2.0, 1.0])]
    df = frame(spark, rows)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_k(df, df).collect()} == brute(rows, rows, 5)
    assert mtree.top_k(df.limit(0), df.limit(0)).collect() == []
    assert mtree.top_k(df, df.limit(0)).collect() == []


def searched(x, q, own, k):
    """search_block against all products as Python integers; also the products it computed."""
    u, where = np.unique(x, axis=0, return_inverse=True)
    ids = [np.flatnonzero(where == i) for i in range(len(u))]
    found = mtree.search_block(mtree.Tree(mtree.build(u), u, ids), q, own, k, together=50)
    for n in range(len(q)):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(q[n], v)), i) for i, v in enumerate(x) if i != own[n])[:k]
        got = found[found["query"] == n]
        assert list(zip((-got.score).tolist(), got.id.tolist(), strict=True)) == want
    return found.computed.mean() / len(u)


def test_blocks_of_queries_equal_all_products():
    rng = np.random.default_rng(4)
    flat = rng.integers(-3, 4, (900, 3))  # many ties and equal vectors
    searched(flat, flat[:120], np.arange(120), 5)
    wide = rng.integers(-9, 10, (700, 12)) * rng.integers(0, 60, (700, 1))  # norms that differ, zero vectors
    searched(wide, wide[100:220], np.arange(100, 220), 7)
    searched(wide[:4], wide[:4], np.arange(4), 5)


def test_products_beyond_doubles_are_exact():
    x = np.random.default_rng(5).integers(-(2**29), 2**29, (400, 4)) + 0
    x[200:] = x[:200] + np.array([0, 0, 0, 1])  # scores that differ in their last digits
    searched(x, x[:60], np.arange(60), 5)


def test_metric_bound_spares_products_where_norms_agree():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 6000)] + rng.normal(scale=0.03, size=(6000, 16))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    assert searched(x, x[:100], np.arange(100), 5) < 0.3
