"""Near duplicates among vectors of one label: tiles in the order of leading principal components, compared a few dimensions at a time.

Unit vectors are turned into their principal axes, so that the first dimensions hold most of a product.  A tile of them
meets another if their boxes come near enough; within the pair a product grows by groups of dimensions, and
what is left of it is at most the product of the norms of the rest.  A pair of vectors that cannot reach the threshold
any more is not looked at again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.llm import vectors as vx
from usagelens.llm.components import components
from usagelens.llm.store import written

TILE = 2048
STRIP = 256
LEAD = 4
#: Leading axes that order the vectors, and the width of their cells.
CELLS, CELL = 3, 0.25
#: Products of doubles in different orders differ by less; bounds are widened by it, results this near to the threshold are computed anew.
SLACK = 1e-10


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is divided out first, so that no square leaves the range of doubles."""
    top = np.abs(x).max(axis=1, initial=0)
    y = x / np.where(top > 0, top, 1)[:, None]
    return y / np.maximum(np.sqrt((y * y).sum(axis=1)), 1)[:, None]


def steps(d: int) -> list[int]:
    """Where the groups of dimensions end: an eighth, a quarter, a half, all."""
    return sorted({min(d, max(1, -(-d // s))) for s in (8, 4, 2, 1)})


def reached(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """Which rows of ``a`` and ``b``, unit vectors in their principal axes, have a cosine of ``least`` or more; and multiplications spent.

    The first group of dimensions is one matrix product.  Pairs that survive the bound are taken one by one, or
    the whole tile again where many do.
    """
    d = a.shape[1]
    out = np.zeros((len(a), len(b)), bool)
    if not out.size or not d:
        return out, 0
    ends = steps(d)
    rest_a = np.sqrt(np.maximum(0, np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1]))
    rest_b = np.sqrt(np.maximum(0, np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1]))
    rest_a, rest_b = np.column_stack([rest_a, np.zeros(len(a))]), np.column_stack([rest_b, np.zeros(len(b))])
    spent = 0
    for at in range(0, len(a), STRIP):
        sa, ra = a[at : at + STRIP], rest_a[at : at + STRIP]
        e = ends[0]
        got = sa[:, :e] @ b[:, :e].T
        spent += got.size * e
        i, j = np.nonzero(got + np.outer(ra[:, e], rest_b[:, e]) >= least - SLACK)
        sums = got[i, j]
        for begin, e in zip(ends, ends[1:], strict=False):
            if not len(i):
                break
            if len(i) * 8 > got.size:
                sums = sums + (sa[:, begin:e] @ b[:, begin:e].T)[i, j]
                spent += got.size * (e - begin)
            else:
                sums = sums + np.concatenate([np.einsum("ij,ij->i", sa[i[c : c + 65536], begin:e], b[j[c : c + 65536], begin:e]) for c in range(0, len(i), 65536)])
                spent += len(i) * (e - begin)
            keep = sums + ra[i, e] * rest_b[j, e] >= least - SLACK
            i, j, sums = i[keep], j[keep], sums[keep]
        out[at + i, j] = True
    return out, spent


def exact(x: np.ndarray, y: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> None:
    """Decides pairs that stand at the threshold by the cosine of the given vectors."""
    for r in np.flatnonzero(near.any(axis=1)):
        c = np.flatnonzero(near[r])
        close = c[np.abs(b[c] @ a[r] - least) <= 2 * SLACK]
        for j in close:
            near[r, j] = float(x[r] @ y[j]) / (float(np.sqrt(x[r] @ x[r])) * float(np.sqrt(y[j] @ y[j]))) >= least


def forest(near: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The connected parts of a table of links: (rows, columns) of each, without those that have no link."""
    out = []
    left = near.any(axis=1)
    while left.any():
        rows = np.zeros(len(near), bool)
        rows[left.argmax()] = True
        new, cols = rows.copy(), np.zeros(near.shape[1], bool)
        while new.any():
            more = near[new].any(axis=0) & ~cols
            cols |= more
            new = near[:, more].any(axis=1) & ~rows
            rows |= new
        left &= ~rows
        out.append((np.flatnonzero(rows), np.flatnonzero(cols)))
    return out


def _prepared(vectors: DataFrame, key: str, vector: str, label: str, d: int) -> DataFrame:
    """(id, label, at, digest, x): a row for each row, with a number in its task; digest and vector are null where it takes no part."""
    rows = vectors.select(
        F.col(key).alias("id"), F.col(label).alias("label"),
        F.when(vx.finite(vector) & F.col(label).isNotNull() & F.col(key).isNotNull(), F.col(vector).cast("array<double>")).alias("v"),
    )
    shape = vx.shape(id=rows.schema["id"].dataType, label=rows.schema["label"].dataType, at="long", digest="binary", x="binary")

    def work(batches):
        at = 0
        for b in batches:
            v = b.column("v")
            some = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            x = vx.matrix(v.drop_null(), d) + 0.0
            digests, packed = [None] * b.num_rows, [None] * b.num_rows
            for i, row in zip(some.tolist(), x, strict=True):
                if row.any():
                    packed[i] = vx.pack(row)
                    digests[i] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array(np.arange(at, at + b.num_rows), pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["id", "label", "at", "digest", "x"]
            )
            at += b.num_rows

    return written(rows.mapInArrow(work, shape), "vectors")


def _stack(column: pa.Array, d: int) -> np.ndarray:
    return np.stack([vx.unpack(v, d) for v in column.to_pylist()]) if len(column) else np.zeros((0, d))


def axes(classes: DataFrame, d: int) -> np.ndarray:
    """The principal axes of the unit vectors as columns, leading ones first: a sum of d x d numbers over all of them."""

    def gram(batches):
        out = np.zeros((d, d))
        for b in batches:
            u = units(_stack(b.column("x"), d))
            out += u.T @ u
        return [out]

    (g,) = vx.summed(classes.select("x"), gram, [(np.float64, (d, d))])
    return np.linalg.eigh((g + g.T) / 2)[1][:, ::-1]


def _tiles(classes: DataFrame, turn: np.ndarray, tile: int) -> DataFrame:
    """(tile, label, n, x, digests, ids, sizes, low, high): runs of vectors of one label in the order of their leading axes."""
    d = len(turn)
    cells = [f"c{i}" for i in range(CELLS)]
    kinds = {f.name: f.dataType for f in classes.schema}
    placed = T.StructType([*classes.schema.fields, *[T.StructField(c, T.IntegerType()) for c in cells]])

    def place(batches):
        for b in batches:
            u = units(_stack(b.column("x"), d)) @ turn[:, :CELLS]
            u = np.column_stack([u, np.zeros((len(u), CELLS - u.shape[1]))])
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(np.floor(u[:, i] / CELL).astype(np.int32)) for i in range(CELLS)]], names=[*b.schema.names, *cells])

    shape = vx.shape(tile="long", label=kinds["label"], n="int", x="binary", digests="array<binary>", ids=T.ArrayType(kinds["id"]), sizes="array<long>", low="array<double>", high="array<double>")

    def cut(batches):
        from pyspark import TaskContext

        number, held, rows = TaskContext.get().partitionId() << 24, [], 0

        def tiles(last: bool):
            nonlocal number, held, rows
            names = held[0].schema.names
            all_ = pa.RecordBatch.from_arrays([vx.joined([h.column(c) for h in held]) for c in names], names=names)
            labels = all_.column("label")
            # Runs of one label: sorted, so a new one starts where the value differs from the one before.
            fresh = [0] + [i + 1 for i, same in enumerate(pa.compute.equal(labels[1:], labels[:-1]).to_pylist()) if not same] + [len(labels)]
            done = 0
            for a, z in zip(fresh, fresh[1:], strict=False):
                for s in range(a, z, tile):
                    e = min(z, s + tile)
                    if e == len(labels) and not last:
                        break
                    part = all_.slice(s, e - s)
                    x = _stack(part.column("x"), d)
                    u = units(x) @ turn[:, :LEAD]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int64()), labels.slice(s, 1), pa.array([e - s], pa.int32()), pa.array([vx.pack(x)], pa.binary()), vx.listed(part.column("digest"), [0, e - s]),
                         vx.listed(part.column("id"), [0, e - s]), vx.listed(part.column("n"), [0, e - s]), pa.array([u.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([u.max(axis=0).tolist()], pa.list_(pa.float64()))],
                        names=[f.name for f in shape],
                    )
                    number, done = number + 1, e
            held = [all_.slice(done)] if done < len(labels) else []
            rows = len(labels) - done

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows > tile:
                yield from tiles(False)
        if held:
            yield from tiles(True)

    order = ["label", *cells, "digest"]
    return written(classes.mapInArrow(place, placed).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, shape), "tiles")


def _links(tiles: DataFrame, turn: np.ndarray, least: float) -> DataFrame:
    """(tile, row, linked, root): for vectors with links to a tile, how many rows they are linked with there, and a vector of the same connected part.

    A pair of tiles gives at most two rows a vector, however many links it holds.
    """
    d = len(turn)
    radius = 2 - 2 * least + 1e-6
    box = tiles.select("tile", "label", "low", "high", "n")
    salts = 16
    left = box.withColumn("_salt", F.pmod(F.xxhash64("tile"), F.lit(salts)).cast("int"))
    right = box.toDF("tile2", "label", "low2", "high2", "n2").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gap = F.aggregate(
        F.zip_with(F.zip_with("low", "high2", lambda x, y: x - y), F.zip_with("low2", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))),
        F.lit(0.0), lambda s, x: s + x * x,
    )
    pairs = left.join(right, ["label", "_salt"]).filter((F.col("tile") <= F.col("tile2")) & (gap <= radius)).select("tile", "tile2")
    heavy = tiles.select("tile", "n", "x", "sizes", "ids")
    # The second tile of a pair with itself is not sent.
    other = heavy.toDF("tile2", "n2", "x2", "sizes2", "ids2")
    both = pairs.join(heavy, "tile").join(other, "tile2")
    alone = tiles.select(F.col("tile").alias("tile2"), "tile", "n", "x", "sizes", "ids", F.col("n").alias("n2"), F.lit(None).cast("binary").alias("x2"), F.col("sizes").alias("sizes2"), F.col("ids").alias("ids2"))
    work = both.filter("tile <> tile2").unionByName(alone)
    id_type = tiles.schema["ids"].dataType.elementType
    shape = vx.shape(tile="long", row="int", linked="long", id=id_type, root=id_type)

    def compare(batches):
        for b in batches:
            for i, r in enumerate(b.select(["tile", "tile2", "n", "n2", "x", "x2", "sizes", "sizes2"]).to_pylist()):
                x = vx.unpack(r["x"], r["n"], d)
                a = units(x) @ turn
                same = r["x2"] is None
                y = x if same else vx.unpack(r["x2"], r["n2"], d)
                c = a if same else units(y) @ turn
                near, _ = reached(a, c, least)
                exact(x, y, near, a, c, least)
                m, n = np.array(r["sizes"], float), np.array(r["sizes2"], float)
                if same:
                    np.fill_diagonal(near, False)
                    near |= near.T
                # Sums of whole numbers below 2^53.
                linked = [(r["tile"], near @ n, b.column("ids").slice(i, 1).flatten())]
                if not same:
                    linked.append((r["tile2"], m @ near, b.column("ids2").slice(i, 1).flatten()))
                roots = [np.full(len(x), -1), np.full(len(y), -1)]
                if same:
                    np.fill_diagonal(near, near.any(axis=1))
                for rows, cols in forest(near):
                    roots[0][rows], roots[1][cols] = rows[0], rows[0]
                for (tile, sums, ids), root in zip(linked, roots, strict=False):
                    some = np.flatnonzero(root >= 0)
                    if len(some):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(some), tile), pa.int64()), pa.array(some, pa.int32()), pa.array(sums[some].astype(np.int64)), ids.take(pa.array(some)), linked[0][2].take(pa.array(root[some]))],
                            names=[f.name for f in shape],
                        )

    return written(work.repartition("tile", "tile2").mapInArrow(compare, shape), "links")


def linked_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept) of each row: linked vectors, the smallest key reachable by links, and whether it is the own.

    Two vectors of one label link when their cosine, in doubles, is ``least`` or more.

    1. Equal vectors of a label become one class with a count, before the shuffle; so copies are never compared with each other.
    2. The principal axes of all classes turn the vectors; classes in the order of their cells on three leading axes
       are cut into tiles of at most ``tile`` vectors of one label.
    3. Tiles whose boxes on four leading axes are near enough meet in a task of their own, group of dimensions by group.
    4. A pair of tiles returns counts and one link to each connected part for a vector, not its links; components follow.
    5. Results go to classes, then to rows, under a salt: as many salts as the root of the number of rows.

    Rows whose vector is null, zero or holds null or non-finite components, or whose label or key is null, link with nothing:
    they have 0 links and stand for themselves (``kept`` is false without a key).  Repeated rows are vectors of their own and link with
    each other; rows of one key share their component.  Shorter vectors are filled with zero components; an empty table gives an empty result; other columns
    take no part.
    """
    d = vx.width(vectors.select(vector), vector)
    rows = _prepared(vectors, key, vector, label, d)
    valid = rows.filter("digest IS NOT NULL")
    classes = written(valid.groupBy("label", "digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.max("x").alias("x")), "classes")
    turn = axes(classes, d)
    tiles = _tiles(classes, turn, tile)
    links = _links(tiles, turn, least)
    parts = components(links.select("id", "root"), "id", "root")
    named = tiles.select("tile", "label", F.posexplode(F.arrays_zip("digests", "ids", "sizes")).alias("row", "e")).select("tile", "label", "row", F.col("e.digests").alias("digest"), F.col("e.ids").alias("id"), F.col("e.sizes").alias("n"))
    counts = links.groupBy("tile", "row").agg(F.sum("linked").alias("linked"))
    decided = named.join(counts, ["tile", "row"], "left").join(parts, "id", "left")
    decided = decided.select("label", "digest", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # A vector that a third of all rows hold is spread over salts before its rows meet the result.
    salts = max(1, int(rows.count() ** 0.5))
    dealt = rows.select("id", "label", "digest", F.pmod(F.xxhash64("at", "id"), F.lit(salts)).alias("salt"))
    kinds = dealt.filter("digest IS NOT NULL").select("label", "digest", "salt").distinct().join(decided, ["label", "digest"])
    joined = dealt.join(kinds, ["label", "digest", "salt"], "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
