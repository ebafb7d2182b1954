import hashlib
import math
import random

import numpy as np

from usagelens.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain Lloyd rounds in Python integers."""
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, label, [max(-(2**24), min(2**24, math.floor(256 * float(np.float32(x))))) for x in v], [float(np.float32(x)) for x in v]) for i, v, label in rows if good(v)]
    width = -(-max((len(v) for _, v, _ in rows if v is not None), default=0) // parts)
    kept = sorted(((i, label, x + [0] * (width * parts - len(x)), v) for i, label, x, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, _, x, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [c[p] for c, g in zip(cut, got, strict=True) if g[p][1] == j]
                if own:
                    books[p][j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    got = assign()
    errors = [sum(d for d, _ in g) for g in got]
    by_label = {}
    for (_, label, _, _), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{j:02x}" for _, j in g), e, by_label[label], digest) for (i, label, _, _), g, e in zip(kept, got, errors, strict=True))


def result(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def vectors(seed, n, d, spread=0.2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(n)]


def test_equals_plain_lloyd(spark):
    rows = vectors(1, 150, 32)
    rows += [(1000 + i, rows[3][1], 1) for i in range(80)]  # a third of the rows hold one vector
    rows += [(7, rows[0][1], 1), rows[5], rows[5], (None, rows[1][1], 2), (None, rows[2][1], None)]
    rows += [(2000, None, 1), (2001, [None] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [float("-inf")] + [0.0] * 31, 2), (2004, [], 1), (2005, [0.5] * 7, 9)]
    assert result(codebooks.compress(frame(spark, rows))) == brute(rows)


def test_other_sizes_and_far_values(spark):
    rows = vectors(2, 40, 6)
    rows += [(50, [1e30, -1e30, 65536.0, -65536.1, 3e-40, 0.0], 1)]
    got = codebooks.compress(frame(spark, rows), parts=4, entries=3, rounds=5)
    assert result(got) == brute(rows, 4, 3, 5)


def test_labels_joined_by_a_shuffle(spark, monkeypatch):
    rows = vectors(3, 60, 4)
    monkeypatch.setattr(codebooks, "BROADCAST_LABELS", 0)
    assert result(codebooks.compress(frame(spark, rows), parts=2, entries=5)) == brute(rows, 2, 5)


def test_moved_entries_alone_decide():
    """Assignments after some entries moved equal a complete scan, ties included, and take fewer distances."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        x, e = rng.integers(-3, 4, (200, 3)), rng.integers(-3, 4, (12, 3))
        code, dist = codebooks.nearest(x, e)
        moved = rng.random(12) < 0.3
        new = np.where(moved[:, None], e + rng.integers(-2, 3, e.shape), e)
        c, d, spent = codebooks.reassigned(x, new, (new != e).any(axis=1), code, dist)
        want = codebooks.nearest(x, new)
        assert (c == want[0]).all() and (d == want[1]).all()
        assert spent == sum(12 if (new != e).any(axis=1)[k] else (new != e).any(axis=1).sum() for k in code)


def test_distances_are_exact_beyond_doubles():
    x, e = np.array([[1 << 24, -(1 << 24)] * 8]), np.array([[-(1 << 24), (1 << 24) - 1] * 8])
    assert codebooks.distances(x, e).tolist() == [[8 * ((1 << 25) ** 2 + ((1 << 25) - 1) ** 2)]]


def test_empty(spark):
    assert codebooks.compress(frame(spark, [(1, [1.0], 1)]).limit(0)).collect() == []
    assert codebooks.compress(frame(spark, [(1, None, 1)])).collect() == []
    assert result(codebooks.compress(frame(spark, [(4, [], 1)]))) == brute([(4, [], 1)])
