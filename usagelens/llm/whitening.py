"""Whitening of vectors by leading principal components, found with a block Jacobi-Davidson method.

The covariance is never formed: Spark multiplies the centred vectors with a thin block of directions and back, and
sums the results of the tasks.  The driver holds only blocks of as many rows as the vectors have dimensions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.llm import vectors as vx
from usagelens.llm.store import written

SCALE = 64
OFFSET = 1_000_000
#: floor(64 c) beyond this is held at it.
LIMIT = (1 << 31) - 1
BLOCK = 2048
EPS = float(np.finfo(float).eps)


def minres(apply: Callable, rhs: np.ndarray, shift: np.ndarray, project: Callable, steps: int, target: float) -> np.ndarray:
    """Solves (A - shift) t = rhs in the projected space for each column, by MINRES on all columns at once.

    Ends after ``steps`` products, or when every residual is ``target`` times its right-hand side.
    """
    beta = np.linalg.norm(rhs, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v, v_old = rhs / first, np.zeros_like(rhs)
    x, w0, w1 = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    eta, link = beta.copy(), np.zeros_like(beta)
    c0, c1, s0, s1 = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        p = project(apply(v) - v * shift)
        alpha = (v * p).sum(axis=0)
        p -= v * alpha + v_old * link
        after = np.linalg.norm(p, axis=0)
        delta = c1 * alpha - c0 * s1 * link
        rho1 = np.hypot(delta, after)
        rho2, rho3 = s1 * alpha + c0 * c1 * link, s0 * link
        safe = np.where(rho1 > 0, rho1, 1.0)
        c0, c1, s0, s1 = c1, delta / safe, s1, after / safe
        w0, w1 = w1, np.where(rho1 > 0, (v - w0 * rho3 - w1 * rho2) / safe, 0.0)
        x += w1 * (c1 * eta)
        eta = -s1 * eta
        v_old, v, link = v, p / np.where(after > 0, after, 1.0), after
        if (np.abs(eta) <= target * beta).all():
            break
    return x


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The part of the columns that is new to the bases, orthonormal; columns that are not new are left out."""
    out = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            for b in (*bases, out):
                column = column - b @ (b.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        if size >= 1e-10:
            out = np.column_stack([out, column])
    return out


@dataclass
class Eigen:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def leading_eigenvectors(apply: Callable, d: int, k: int, block: int = 16, inner: int = 6, limit: int = 200, seed: int = 7) -> Eigen:
    """The ``k`` largest eigenvalues of the symmetric operator ``apply`` (d rows in, d rows out) and unit eigenvectors.

    Up to ``block`` leading Ritz pairs of the search space are corrected together: MINRES solves (I - QQ')(A - theta)(I - QQ') t = -r,
    Q being the locked vectors and the Ritz vectors, and t widens the space.  A leading pair is locked when its residual is
    within rounding of doubles, 100 eps of the largest eigenvalue (d eps beyond 100 dimensions); beyond 4 blocks the space
    restarts from its leading Ritz vectors.  Ends with ``k`` locked pairs of which none is below what the space still holds.
    """
    k = min(k, d)
    locked, values, residuals = np.zeros((d, 0)), [], []
    products = 0

    def times(x: np.ndarray) -> np.ndarray:
        nonlocal products
        products += 1
        return apply(x)

    basis = _orthonormal(np.random.default_rng(seed).standard_normal((d, min(d, block))))
    image = times(basis)
    for _ in range(limit):
        theta, s = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        basis, image = basis @ s, image @ s
        top = max([abs(t) for t in values] + [abs(theta[0]) if len(theta) else 0.0])
        close = max(100, d) * EPS * top
        # Residuals against the locked vectors are rounding, and belong to those.
        r = image - basis * theta
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        done = 0
        while done < len(theta) and size[done] <= close and (len(values) + done < k or theta[done] > sorted(values + theta[:done].tolist())[-k] + close):
            done += 1
        if done:
            locked = np.column_stack([locked, basis[:, :done]])
            values += theta[:done].tolist()
            residuals += size[:done].tolist()
            basis, image, theta, r, size = basis[:, done:], image[:, done:], theta[done:], r[:, done:], size[done:]
        if len(values) >= k and (not len(theta) or theta[0] <= sorted(values)[-k] + close):
            break
        if locked.shape[1] + basis.shape[1] == d and not done and len(values) >= k:
            break
        if basis.shape[1] > 4 * block:
            basis, image, theta, r, size = basis[:, : 2 * block], image[:, : 2 * block], theta[: 2 * block], r[:, : 2 * block], size[: 2 * block]
        want = min(block, max(1, k - len(values)), len(theta))
        ritz = basis[:, :want]

        def project(x: np.ndarray, q: np.ndarray = np.column_stack([locked, ritz])) -> np.ndarray:
            x = x - q @ (q.T @ x)
            return x - q @ (q.T @ x)

        if want:
            t = minres(times, project(-r[:, :want]), theta[:want], project, inner, 1e-3)
            # The residuals too: they keep the space growing where a correction adds nothing.
            new = _orthonormal(np.column_stack([t, r[:, :want]])[:, : 2 * want], locked, basis)[:, :block]
        else:
            new = np.zeros((d, 0))
        if not new.shape[1]:
            # The space is closed under the operator: go on from a fresh direction, or polish what there is.
            new = _orthonormal(np.random.default_rng(seed + products).standard_normal((d, min(block, d))), locked, basis)[:, : max(0, d - locked.shape[1] - basis.shape[1])]
        if new.shape[1]:
            basis, image = np.column_stack([basis, new]), np.column_stack([image, times(new)])
        else:
            basis = _orthonormal(basis, locked)
            image = times(basis)
    else:
        raise ArithmeticError(f"{len(values)} of {k} eigenvectors converged in {limit} rounds")
    order = np.argsort(values, kind="stable")[::-1][:k]
    vectors = locked[:, order]
    return Eigen(np.array(values)[order], vectors, np.array(residuals)[order], products)


@dataclass
class Whitening:
    """A fitted transform: ``n`` vectors with sums ``sums`` of floor(64 c), the components and what they explain."""

    n: int
    sums: np.ndarray
    trace: float
    eigen: Eigen

    @property
    def used(self) -> int:
        """Components that have variance: the others are no directions of the vectors."""
        if not len(self.eigen.values):
            return 0
        return int((self.eigen.values > max(100, len(self.sums)) * EPS * max(self.eigen.values[0], 0.0)).sum())

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y - self.sums / self.n) @ self.eigen.vectors[:, : self.used] / np.sqrt(self.eigen.values[: self.used])


def _blocks(vectors: DataFrame, key: str, vector: str, d: int) -> DataFrame:
    """(ids, n, y): floor(64 c) of each vector in packed blocks; x = y + 1000000 differs by a constant, which centring takes away exactly."""
    rows = vectors.filter(vx.finite(vector)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                y = vx.grid(vx.matrix(part.column("v"), d), SCALE, LIMIT)
                yield pa.RecordBatch.from_pydict({"ids": vx.listed(part.column("id"), [0, len(y)]), "n": pa.array([len(y)], pa.int32()), "y": pa.array([vx.pack(y)], pa.binary())})

    shape = vx.shape(ids=T.ArrayType(rows.schema["id"].dataType), n="int", y="binary")
    return written(rows.mapInArrow(cut, shape), "blocks")


def _each(batches, d: int):
    for b in batches:
        for n, y in zip(b.column("n").to_pylist(), b.column("y").to_pylist(), strict=True):
            yield vx.unpack(y, n, d)


def _fit(blocks: DataFrame, d: int, k: int) -> Whitening:
    thin = blocks.select("n", "y")

    def count(batches):
        n, s = 0, np.zeros(d, np.int64)
        for y in _each(batches, d):
            n, s = n + len(y), s + y.sum(axis=0)
        return [np.array([n]), s]

    (n,), sums = vx.summed(thin, count, [(np.int64, (1,)), (np.int64, (d,))])
    if not n:
        return Whitening(0, sums, 0.0, Eigen(np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0))
    mean = sums / n

    def spread(batches):
        return [np.array([sum(float(((y - mean) ** 2).sum()) for y in _each(batches, d))])]

    ((trace,),) = vx.summed(thin, spread, [(np.float64, (1,))])

    def apply(x: np.ndarray) -> np.ndarray:
        """The covariance times ``x``: one pass over the vectors."""

        def product(batches):
            out = np.zeros(x.shape)
            for y in _each(batches, d):
                z = y - mean
                out += z.T @ (z @ x)
            return [out]

        (total,) = vx.summed(thin, product, [(np.float64, x.shape)])
        return total / n

    return Whitening(int(n), sums, float(trace / n), leading_eigenvectors(apply, d, k) if d and trace > 0 else Eigen(np.zeros(min(k, d)), np.zeros((d, min(k, d))), np.zeros(min(k, d)), 0))


def _identity_error(blocks: DataFrame, model: Whitening, d: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, in two passes: mean, then centred products."""
    used = model.used
    if not used:
        return 0.0
    thin = blocks.select("n", "y")

    def add(batches):
        return [sum((model.project(y).sum(axis=0) for y in _each(batches, d)), np.zeros(used))]

    (total,) = vx.summed(thin, add, [(np.float64, (used,))])
    mean = total / model.n

    def products(batches):
        out = np.zeros((used, used))
        for y in _each(batches, d):
            z = model.project(y) - mean
            out += z.T @ z
        return [out]

    (cov,) = vx.summed(thin, products, [(np.float64, (used, used))])
    return float(np.abs(cov / model.n - np.eye(used)).max())


def deviations(y: np.ndarray, sums: np.ndarray, n: int) -> list[int]:
    """The exact sum over dimensions of (n x - S)^2 of each row; the offset of x cancels."""
    top = n * int(np.abs(y).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if top * top * max(1, y.shape[1]) < 1 << 63:
        return ((y * n - sums) ** 2).sum(axis=1).tolist()
    return [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in y]


def fit(vectors: DataFrame, vector: str = "embedding", k: int = 32) -> Whitening:
    """The transform fitted on all vectors that are free of nulls and non-finite entries."""
    d = vx.width(vectors.select(vector), vector)
    return _fit(_blocks(vectors, vector, vector, d), d, k)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 32) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): each vector on each of ``k`` leading components.

    Entries c become x = floor(64 c) + 1000000, exact integers.  ``deviation`` is the vector's sum of (n x - S)^2, S the sums over the
    n vectors; ``whitened`` is x - S/n on the component over the root of its eigenvalue, ``explained`` the share of
    the trace, ``identity_error`` how far the covariance of all whitened values is from the identity.

    Vectors that are null or hold null or non-finite entries are dropped.  Repeated rows, and rows without a key, are rows of their
    own; shorter vectors are filled with zero entries; entries beyond 2^31 after scaling are held at it; a deviation beyond 64 bits is null.
    Components without variance have null for ``whitened`` and no part in ``identity_error``; if no vector differs, ``explained``
    is null too.  An empty table gives an empty result; other columns take no part.
    """
    d = vx.width(vectors.select(vector), vector)
    blocks = _blocks(vectors, key, vector, d)
    model = _fit(blocks, d, k)
    error = _identity_error(blocks, model, d)
    shape = vx.shape(**{key: vectors.schema[key].dataType, "component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"})
    names = [f.name for f in shape]
    c = len(model.eigen.values)
    share = (model.eigen.values / model.trace).tolist() if model.trace > 0 else [None] * c

    def project(batches):
        for b in batches:
            for i, (m, data) in enumerate(zip(b.column("n").to_pylist(), b.column("y").to_pylist(), strict=True)):
                y = vx.unpack(data, m, d)
                out = np.full((m, c), np.nan)
                out[:, : model.used] = model.project(y)
                own = pa.array([v if v < 1 << 63 else None for v in deviations(y, model.sums, model.n)], pa.int64())
                rows = pa.array(np.repeat(np.arange(m), c))
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids").slice(i, 1).flatten().take(rows), pa.array(np.tile(np.arange(1, c + 1), m), pa.int32()), pa.array(np.full(m * c, model.n), pa.int64()), own.take(rows),
                     pa.array(out.ravel(), pa.float64(), mask=np.isnan(out.ravel())), pa.array(share * m, pa.float64()), pa.array(np.full(m * c, error), pa.float64())],
                    names=names,
                )

    return blocks.mapInArrow(project, shape)
