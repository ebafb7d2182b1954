import math
import random

import numpy as np

from usagelens.llm import pca_tiles

SCHEMA = "vec_id long, embedding array<double>, label string, n_links string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def brute(rows, least=0.93):
    d = max((len(v) for _, v, _ in rows if v is not None), default=0)

    def usable(i, v, label):
        return i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    full = [np.array([*v, *[0.0] * (d - len(v))]) if usable(i, v, label) else None for i, v, label in rows]
    full = [v if v is None else v / np.abs(v).max() for v in full]
    links = {r: set() for r in range(len(rows))}
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and full[a] is not None and full[b] is not None and rows[a][2] == rows[b][2]:
                if full[a] @ full[b] / math.sqrt(full[a] @ full[a]) / math.sqrt(full[b] @ full[b]) >= least:
                    links[a].add(b)
    same = {}
    for r, (i, _, _) in enumerate(rows):
        if full[r] is not None:
            same.setdefault(i, []).append(r)
    out = []
    for r, (i, _, _) in enumerate(rows):
        seen, todo = {r}, [r]
        while todo:
            x = todo.pop()
            for y in links[x] | set(same.get(rows[x][0], []) if full[x] is not None else []):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        c = min(ids) if ids else None
        out.append((str(i), len(links[r]), c, i is not None and i == c))
    return sorted(out, key=str)


def result(df):
    return sorted([(str(r[0]), *r[1:]) for r in df.collect()], key=str)


def vectors(seed, n, d, noise):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(12)]
    return [(i, [c + rng.gauss(0, noise) for c in rng.choice(centres)], rng.choice("aab")) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(1, 260, 10, 0.25)
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(130)]  # copies
    rows += [(i, [2 * x for x in rows[i][1]], rows[i][2]) for i in (2000, 5)[1:]]  # another length, and an id that stands twice
    rows += [(3000 - i, [1.0 + 0.01 * ((i * 7 + j) % 5) for j in range(10)], "a") for i in range(80)]  # all near each other
    rows += [(4000, None, "a"), (4001, [None] * 10, "a"), (4002, [float("nan")] * 10, "a"), (4003, [float("inf")] * 10, "b"), (4004, [0.0] * 10, "a"), (4005, [], "a"), (4006, rows[0][1], None), (4007, rows[0][1], None)]
    rows += [(None, rows[0][1], rows[0][2]), (4008, rows[7][1][:4], "b"), rows[9], (4009, [1e-200 * x for x in rows[4][1]], rows[4][2]), (4010, [1e200 * x for x in rows[4][1]], rows[4][2])]
    for tile in (2048, 16):
        assert result(pca_tiles.linked_vectors(frame(spark, rows), tile=tile)) == brute(rows)


def test_chain_across_tiles(spark):
    """Neighbours on a circle link, others do not: one component reaches over all tiles."""
    rows = [(999 - i, [math.cos(i * 0.3), math.sin(i * 0.3)], "a") for i in range(18)]
    assert result(pca_tiles.linked_vectors(frame(spark, rows), tile=2)) == brute(rows)


def test_bounds_spare_products_and_lose_nothing():
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 64):
        x = rng.standard_normal((500, d)) * np.linspace(1, 0.1, d)
        y = x[:300] + rng.standard_normal((300, d)) * 0.05
        a, b = pca_tiles.units(x), pca_tiles.units(y)
        turn = np.linalg.eigh(a.T @ a)[1][:, ::-1]
        near, spent = pca_tiles.reached(a @ turn, b @ turn, 0.93)
        cos = a @ b.T
        assert (near == (cos >= 0.93))[np.abs(cos - 0.93) > 1e-9].all()
        if d == 64:
            assert spent < 0.5 * len(a) * len(b) * d


def test_pairs_at_the_threshold_are_decided_by_the_given_vectors():
    x, y = np.array([[1.0, 0.0]]), np.array([[3.0, 4.0], [0.0, 1.0]])
    for least, want in ((0.6, True), (0.6000000000000001, False)):
        near = np.array([[True, False]])
        pca_tiles.exact(x, y, near, pca_tiles.units(x), pca_tiles.units(y), least)
        assert near.tolist() == [[want, False]]


def test_forest_parts():
    near = np.zeros((6, 6), bool)
    for i, j in ((0, 1), (2, 1), (2, 5), (4, 4)):
        near[i, j] = True
    assert [(r.tolist(), c.tolist()) for r, c in pca_tiles.forest(near)] == [([0, 2], [1, 5]), ([4], [4])]


def test_empty(spark):
    assert pca_tiles.linked_vectors(frame(spark, [(1, [1.0], "a")]).limit(0)).collect() == []
    assert result(pca_tiles.linked_vectors(frame(spark, [(1, None, "a"), (None, [1.0], "a"), (2, [1.0], "a")]))) == [("1", 0, 1, True), ("2", 0, 2, True), ("None", 0, None, False)]
