"""Vectors as matrices inside tasks, and sums of the arrays that tasks return."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrays of tasks are added up in so many groups before the driver adds those.
GROUPS = 16


def shape(**fields: str | T.DataType) -> T.StructType:
    """A row's fields by name; types are Spark's, or written as in SQL."""
    return T.StructType([T.StructField(n, t if isinstance(t, T.DataType) else T.StructType.fromDDL(f"x {t}")["x"].dataType) for n, t in fields.items()])


def finite(vector: str) -> Column:
    """Is the vector there, without null, NaN or infinite components?"""
    v = F.col(vector).cast("array<double>")
    return v.isNotNull() & F.forall(F.coalesce(v, F.array().cast("array<double>")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def width(df: DataFrame, vector: str) -> int:
    """The length of the longest vector; 0 without any."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a list column without nulls as rows of doubles; shorter ones end in zeros."""
    offs = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offs)
    if len(sizes) and (sizes == d).all():
        return flat[offs[0] : offs[-1]].reshape(len(sizes), d)
    out = np.zeros((len(sizes), d))
    for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def grid(x: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as integers; those beyond ``limit`` are held at it."""
    return np.clip(np.floor(x * float(scale)), -limit, limit).astype(np.int64)


def pack(x: np.ndarray) -> bytes:
    """The array in the narrowest integers that hold it, led by their width in bytes; floats as float32 where that is exact."""
    if x.dtype.kind == "f":
        with np.errstate(over="ignore"):
            narrow = x.astype(np.float32)
        return b"f" + narrow.tobytes() if np.array_equal(narrow.astype(np.float64), x) else b"d" + x.tobytes()
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    for code, kind in ((b"b", np.int8), (b"h", np.int16), (b"i", np.int32)):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return code + x.astype(kind).tobytes()
    return b"q" + x.astype(np.int64).tobytes()


def unpack(data: bytes, *shape: int) -> np.ndarray:
    """The array that pack() has packed, as int64 or float64."""
    x = np.frombuffer(data, np.dtype(data[:1].decode()), offset=1)
    return x.astype(np.float64 if x.dtype.kind == "f" else np.int64).reshape(shape)


def listed(values: pa.Array, cuts: list[int]) -> pa.Array:
    """The runs between the cuts as lists, of any type."""
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)


def joined(parts: list) -> pa.Array:
    """Pieces of a column as one array."""
    return pa.concat_arrays([p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p for p in parts])


def summed(blocks: DataFrame, work: Callable, shapes: list[tuple]) -> list[np.ndarray]:
    """The sums, over all tasks, of the arrays that ``work(batches)`` returns for a task's record batches.

    ``shapes`` has (dtype, shape) of each array.  A task gives one row; these are added in groups, in the order
    of the tasks, and the driver adds one row of each group, whose size is that of the arrays.
    """
    sizes = [(np.dtype(t), s, int(np.prod(s))) for t, s in shapes]

    def split(data: bytes) -> list[np.ndarray]:
        out, at = [], 0
        for t, s, n in sizes:
            out.append(np.frombuffer(data, t, n, at).reshape(s))
            at += n * t.itemsize
        return out

    def whole(arrays) -> bytes:
        return b"".join(np.ascontiguousarray(a, t).tobytes() for a, (t, _, _) in zip(arrays, sizes, strict=True))

    def task(batches):
        from pyspark import TaskContext

        arrays = work(batches)
        if arrays is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "data": pa.array([whole(arrays)], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("part").data
        total = [sum(xs) for xs in zip(*map(split, rows), strict=True)]
        return pd.DataFrame({"part": pdf.part[:1] % GROUPS, "data": [whole(total)]})

    partial = blocks.mapInArrow(task, "part long, data binary").groupBy(F.col("part") % GROUPS).applyInPandas(add, "part long, data binary")
    rows = sorted(partial.collect())
    total = [np.zeros(s, t) for t, s, _ in sizes]
    for r in rows:
        total = [a + b for a, b in zip(total, split(r["data"]), strict=True)]
    return total
