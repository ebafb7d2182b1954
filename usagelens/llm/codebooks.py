"""Compression of vectors to codes of their parts, with codebooks refined by active-entry Lloyd rounds.

Only entries that moved can have come nearer to a part, or gone away from it.  A part whose own entry stayed
where it was keeps its exact distance and compares only the entries that moved; other parts rescan the codebook.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.llm import vectors as vx
from usagelens.llm.store import discard, written

#: Integer components beyond this are held at it, so that squared distances of 1,000 dimensions fit in 62 bits.
LIMIT = 1 << 24
BLOCK = 2048
#: Labels are broadcast with their sums up to this number, and joined by a shuffle beyond.
BROADCAST_LABELS = 100_000
SALTS = 64


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (n, entries) of integer rows; by a product of doubles where 53 bits hold every term."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, e in enumerate(entries):
        out[:, j] = ((x - e) ** 2).sum(1)
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lowest of several, and its squared distance: a complete scan."""
    d = distances(x, entries)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def reassigned(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """What nearest() gives, from the assignment to the codebook before ``moved`` entries moved; and how many distances it took.

    An entry that stayed is no nearer than before, so a part that keeps its own entry has to fear only moved ones: nearer
    ones, or equally near ones of lower index.
    """
    code, dist = code.copy(), dist.copy()
    lost = moved[code]
    some = np.flatnonzero(moved)
    spent = int(lost.sum()) * len(entries)
    if lost.any():
        code[lost], dist[lost] = nearest(x[lost], entries)
    stay = np.flatnonzero(~lost)
    if len(some) and len(stay):
        c, d = nearest(x[stay], entries[some])
        spent += len(stay) * len(some)
        c = some[c]
        better = (d < dist[stay]) | ((d == dist[stay]) & (c < code[stay]))
        code[stay[better]], dist[stay[better]] = c[better], d[better]
    return code, dist, spent


def _blocks(vectors: DataFrame, key: str, vector: str, label: str, scale: int, d: int) -> DataFrame:
    """(ids, labels, n, x): integer vectors in packed blocks; vectors that are null or hold null or non-finite components are left out."""
    rows = vectors.filter(vx.finite(vector)).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kinds = {c: rows.schema[c].dataType for c in ("id", "label")}

    def cut(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                x = vx.grid(vx.matrix(part.column("v"), d), scale, LIMIT)
                yield pa.RecordBatch.from_pydict({
                    "ids": vx.listed(part.column("id"), [0, len(x)]), "labels": vx.listed(part.column("label"), [0, len(x)]),
                    "n": pa.array([len(x)], pa.int32()), "x": pa.array([vx.pack(x)], pa.binary()),
                })

    return rows.mapInArrow(cut, _shape(kinds))


def _shape(kinds: dict, state: bool = False) -> T.StructType:
    more = {"codes": "binary", "dist": "binary", "sums": "binary"} if state else {}
    return vx.shape(ids=T.ArrayType(kinds["id"]), labels=T.ArrayType(kinds["label"]), n="int", x="binary", **more)


class Codebooks:
    """Entries (parts, entries, width) after each round, and which entries the last update moved."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.moved, self.rounds = entries, None, 0

    def update(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """Each used entry becomes the floor of its parts' mean."""
        used = counts > 0
        new = self.entries.copy()
        new[used] = sums[used] // counts[used][:, None]
        self.moved = (new != self.entries).any(axis=2)
        self.entries = new
        self.rounds += 1

    def digest(self) -> str:
        """SHA-256 of the decimal components in the order of part, entry, place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _assigned(row: dict, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, codes, dist) of a block (parts, n, width), (parts, n), (parts, n) under the present codebooks."""
    parts, k, w = books.entries.shape
    x = vx.unpack(row["x"], row["n"], parts * w).reshape(row["n"], parts, w).transpose(1, 0, 2)
    codes, dist = np.empty((parts, row["n"]), np.int64), np.empty((parts, row["n"]), np.int64)
    before = books.moved is not None
    if before:
        old, far = vx.unpack(row["codes"], parts, row["n"]), vx.unpack(row["dist"], parts, row["n"])
    for p in range(parts):
        if before:
            codes[p], dist[p], _ = reassigned(x[p], books.entries[p], books.moved[p], old[p], far[p])
        else:
            codes[p], dist[p] = nearest(x[p], books.entries[p])
    return x, codes, dist


def _round(table: DataFrame, books: Codebooks, kinds: dict) -> DataFrame:
    """The blocks with new codes and distances; the last row of a task holds the sums and counts of its parts by entry."""
    shape = _shape(kinds, state=True)
    parts, k, w = books.entries.shape

    def work(batches):
        sums, counts, names = np.zeros((parts, k, w), np.int64), np.zeros((parts, k), np.int64), None
        for b in batches:
            names = b.schema
            for i, row in enumerate(b.select([c for c in b.schema.names if c not in ("ids", "labels")]).to_pylist()):
                if row["x"] is None:
                    continue
                x, codes, dist = _assigned(row, books)
                for p in range(parts):
                    counts[p] += np.bincount(codes[p], minlength=k)
                    order = np.argsort(codes[p], kind="stable")
                    used, first = np.unique(codes[p][order], return_index=True)
                    sums[p, used] += np.add.reduceat(x[p][order], first, axis=0)
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_pydict({
                    "ids": one.column("ids"), "labels": one.column("labels"), "n": one.column("n"), "x": one.column("x"),
                    "codes": pa.array([vx.pack(codes)], pa.binary()), "dist": pa.array([vx.pack(dist)], pa.binary()), "sums": pa.array([None], pa.binary()),
                })
        if names is not None:
            both = np.concatenate([sums, counts[:, :, None]], axis=2)
            none = {c: pa.nulls(1, names.field(c).type) for c in ("ids", "labels", "n", "x")}
            yield pa.RecordBatch.from_pydict(none | {"codes": pa.nulls(1, pa.binary()), "dist": pa.nulls(1, pa.binary()), "sums": pa.array([both.tobytes()], pa.binary())})

    return table.mapInArrow(work, shape)


def _totals(table: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    parts, k, w = books.entries.shape

    def work(batches):
        total = np.zeros((parts, k, w + 1), np.int64)
        for b in batches:
            for data in b.column("sums").to_pylist():
                total += np.frombuffer(data, np.int64).reshape(total.shape)
        return [total]

    (total,) = vx.summed(table.filter("sums IS NOT NULL").select("sums"), work, [(np.int64, (parts, k, w + 1))])
    return total[:, :, :w], total[:, :, w]


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of each vector: see the module for the method.

    Components become floor(scale * x); vectors are cut into ``parts`` equal parts, each with a codebook of ``entries``
    entries (256 at most) that starts with the parts of the smallest keys.  A round assigns every part to the nearest entry
    (ties to the lower) and moves each used entry to the floor of its parts' mean; a last assignment gives the code,
    two hex digits a part, and the error, the sum of the squared distances.  ``label_error`` sums errors over
    equal labels, null labels together.

    Vectors stand in packed blocks with their codes and exact distances, rewritten once a round; the table before is
    removed.  Sums are integers, so the result does not depend on how Spark deals the work.

    Vectors that are null or hold null or non-finite components are dropped.  Rows of one key, or without one, are rows of their own
    (without one last, equal keys by vector); shorter vectors, and lengths that do not divide, are filled with zero
    components; empty vectors have error 0; components beyond 2^24 after scaling are held at it; with fewer rows than
    entries the codebooks are smaller; an empty table gives an empty result; other columns take no part.
    """
    spark = vectors.sparkSession
    w = -(-vx.width(vectors.select(vector), vector) // parts)
    d = w * parts
    kept = vectors.filter(vx.finite(vector)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.zeros((len(first), d), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r["v"])] = vx.grid(np.array(r["v"]), scale, LIMIT)
    books = Codebooks(start.reshape(len(first), parts, w).transpose(1, 0, 2))
    kinds = {"id": vectors.schema[key].dataType, "label": vectors.schema[label].dataType}
    shape = vx.shape(**{key: kinds["id"], "_label": kinds["label"], "code": "string", "error": "long"})
    if not first:
        return spark.createDataFrame([], shape).select(key, "code", "error", F.col("error").alias("label_error"), F.col("code").alias("codebooks_sha256"))
    table = written(_blocks(vectors, key, vector, label, scale, d), "blocks")
    for _ in range(rounds):
        before, table = table, written(_round(table, books, kinds), "codes")
        discard(before)
        books.update(*_totals(table, books))

    def finish(batches):
        for b in batches:
            for i, row in enumerate(b.select([c for c in b.schema.names if c not in ("ids", "labels")]).to_pylist()):
                if row["x"] is None:
                    continue
                _, codes, dist = _assigned(row, books)
                text = codes.T.astype(np.uint8).tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids").slice(i, 1).flatten(), b.column("labels").slice(i, 1).flatten(),
                     pa.array([text[j : j + 2 * parts] for j in range(0, len(text), 2 * parts)], pa.string()), pa.array(dist.sum(axis=0), pa.int64())],
                    names=[key, "_label", "code", "error"],
                )

    coded = written(table.mapInArrow(finish, shape), "coded")
    discard(table)
    sums = written(coded.groupBy("_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "labels")
    if sums.count() <= BROADCAST_LABELS:
        both = coded.join(F.broadcast(sums), coded["_label"].eqNullSafe(sums["_label"]), "left")
    else:
        # A label may hold a third of all rows: its sum stands once for each salt.
        many = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("code", "error"), F.lit(SALTS)).cast("int"))
        both = dealt.join(many, dealt["_label"].eqNullSafe(many["_label"]) & (dealt["_salt"] == many["_salt"]), "left")
    return both.select(key, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
