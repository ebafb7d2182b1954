import math

import numpy as np
import pytest

from usagelens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)


def expected(rows, k):
    """Exact integers, and numpy's dense eigenvectors of the centred covariance."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in kept)
    kept = [(i, x + [1_000_000] * (d - len(x))) for i, x in kept]
    n, sums = len(kept), [sum(c) for c in zip(*[x for _, x in kept], strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in kept]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for _, x in kept])
    e, v = np.linalg.eigh(z.T @ z / n)
    return [i for i, _ in kept], deviation, z, e[::-1][:k], v[:, ::-1][:, :k], e.sum()


def check(spark, rows, k=32, **kw):
    ids, deviation, z, e, v, trace = expected(rows, k)
    got = whitening.whiten(frame(spark, rows), k=k, **kw).collect()
    used = int((e > 1e-9 * e[0]).sum())
    assert len(got) == len(ids) * len(e)
    assert {r.n for r in got} == {len(ids)} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-10
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
    assert sorted((str(i), d) for i, d in zip(ids, deviation, strict=True) for _ in e) == sorted((str(r.vec_id), r.deviation) for r in got)
    w = np.full((len(ids), len(e)), np.nan)
    for row, (i, d) in enumerate(zip(ids, deviation, strict=True)):
        for r in by[i, d][: len(e)] if len(by[i, d]) == len(e) else by[i, d]:
            if r.whitened is not None:
                w[row, r.component - 1] = r.whitened
            assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9, abs=1e-12)
    assert np.isnan(w[:, used:]).all()
    want = z @ v[:, :used] / np.sqrt(e[:used])
    sign = np.sign((want * w[:, :used]).sum(axis=0))
    assert np.abs(want * sign - w[:, :used]).max() < 1e-7
    return got


def test_equals_dense_eigenvectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 40)) * np.linspace(0.2, 2, 40)
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    rows += [(400 + i, rows[0][1]) for i in range(120)]
    rows += [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, [0.25] * 7), (905, []), (None, rows[9][1])]
    check(spark, rows)


def test_fewer_dimensions_and_directions_without_variance(spark):
    rng = np.random.default_rng(2)
    flat = np.round(2 * rng.standard_normal((90, 2))) @ np.array([[1, 0, 2, 0, 1], [0, 1, 1, 0, 3]])
    got = check(spark, [(i, [*r.tolist(), 1.0]) for i, r in enumerate(flat)])
    assert {r.component for r in got if r.whitened is not None} == {1, 2}


def test_few_rows(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0])]).limit(0)).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(i, c, 2, 0, None, None, 0.0) for i in (1, 2) for c in (1, 2)}


@pytest.mark.parametrize("d, spectrum", [(64, "flat"), (200, "random"), (300, "falling"), (80, "repeated"), (40, "identity"), (3, "random"), (60, "thin")])
def test_solver(d, spectrum):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = {
        "flat": np.linspace(2, 1, d), "random": rng.gamma(1, 1, d), "falling": np.exp(-np.arange(d) / 9.0),
        "repeated": np.repeat([3.0, 2.0, 1.0, 0.5], d // 4), "identity": np.ones(d), "thin": np.r_[[5.0, 1.0], np.zeros(d - 2)],
    }[spectrum]
    a = (q * e) @ q.T
    passes = []

    def apply(x):
        passes.append(x.shape[1])
        return a @ x

    got = whitening.leading_eigenvectors(apply, d, 32)
    k = min(32, d)
    assert np.abs(got.values - np.sort(e)[::-1][:k]).max() < 1e-11 * e.max()
    assert np.linalg.norm(a @ got.vectors - got.vectors * got.values, axis=0).max() < 1e-12 * e.max()
    assert np.abs(got.vectors.T @ got.vectors - np.eye(k)).max() < 1e-12
    assert max(passes) <= 16


def test_minres_solves_shifted_systems():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    b, shift = rng.standard_normal((20, 3)), np.array([0.3, -2.0, 11.0])
    x = whitening.minres(lambda v: a @ v, b, shift, lambda v: v, 40, 1e-13)
    assert np.abs(a @ x - x * shift - b).max() < 1e-8


def test_deviations_beyond_64_bits():
    y, sums = np.array([[2**31 - 1, -(2**31) + 1]]), np.array([5, 7])
    assert whitening.deviations(y, sums, 10**6) == [sum((10**6 * int(a) - s) ** 2 for a, s in zip(y[0], (5, 7), strict=True))]
