"""Document classifier on learned vectors of hashed words and character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from usagelens.llm import text as tx
from usagelens.llm.sample import labelled

BITS = 17
GRAMS = (3, 4)
#: Bytes of texts whose features are found at once: arrays of some hundred bytes for each stand beside what a worker holds already.
CHUNK = 1 << 17
#: The bucket of the mark for a repeated word.
AGAIN = 0
_VALUES = tx.byte_values(5)


def features(raw: np.ndarray, offs: np.ndarray, bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, first byte) of all words, of a mark for each word that repeats the one before, and of all n-grams.

    A word is a run without white space.  An n-gram lies within one word, or begins or ends with the one
    character of white space beside it.
    """
    shift = np.uint64(64 - bits)
    starts, ends, text = tx.word_spans(raw, offs, tx.NOT_SPACE)
    words = tx.span_hashes(raw, starts, ends, _VALUES)
    yield (words >> shift).astype(np.int64), starts
    again = np.flatnonzero((words[1:] == words[:-1]) & (text[1:] == text[:-1])) + 1
    yield np.full(len(again), AGAIN), starts[again]
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    bounds = np.append(chars, len(raw))
    owner = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))[chars]
    space = ~tx.NOT_SPACE[raw[chars]]
    for n in grams:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        good = owner[:m] == owner[n - 1 :]
        for j in range(1, n - 1):
            good &= ~space[j : j + m]
        at = np.flatnonzero(good)
        yield (tx.span_hashes(raw, bounds[at], bounds[at + n], _VALUES) >> shift).astype(np.int64), bounds[at]


@dataclass
class SubwordModel:
    """Vectors of the buckets, and weights and bias of the softmax over the classes."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def bucket_scores(self) -> np.ndarray:
        """What each bucket adds to the classes' scores: the output is linear in the average vector."""
        return self.vectors @ self.weights.T


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def packed(ids: np.ndarray, n: np.ndarray) -> bytes:
    """Rising buckets and their counts in little more than a byte each: steps and counts by byte planes, compressed."""
    both = np.stack([np.diff(ids, prepend=0), n]).astype("<u4")
    return zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    steps, n = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int64), n.astype(np.int32)


class PackedRows(Sequence):
    """Rows for :func:`fit` that stay packed: one is opened when its turn comes."""

    def __init__(self, data: list[bytes], labels: list[int]):
        self.data, self.labels = data, labels

    def __len__(self) -> int:
        return len(self.data)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray, int]:
        return *unpacked(self.data[i]), self.labels[i]


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], n_classes: int = 2, dim: int = 8, bits: int = BITS, epochs: int = 8, rate: float = 0.5, seed: int = 1) -> SubwordModel:
    """Stochastic gradient descent, one document a step, with a rate that falls to zero.

    ``rows``: (buckets, their counts, class).  Documents without features move the bias alone.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    weights, bias = np.zeros((n_classes, dim), np.float32), np.zeros(n_classes, np.float32)
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, counts, label = rows[i]
            ids, counts = np.asarray(ids), np.asarray(counts)
            lr = rate * (1 - step / steps)
            step += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            mean = share @ vectors[ids]
            error = softmax(weights @ mean + bias).astype(np.float32)
            error[label] -= 1
            back = error @ weights
            weights -= lr * np.outer(error, mean)
            bias -= 0.1 * lr * error
            vectors[ids] -= (lr * share)[:, None] * back
    return SubwordModel(vectors, weights, bias)


def train(docs: DataFrame, labels: DataFrame, target: Column, key: str = "doc_id", text: str = "text", bound: int = 4000, use: Column | None = None, bits: int = BITS, grams: tuple[int, ...] = GRAMS, **options) -> SubwordModel | None:
    """Fit on at most ``bound`` labelled documents; tasks count the features, the driver gets the counts, packed.

    None where there is no labelled document.
    """
    sample = labelled(docs, labels, key, text, {"y": target}, bound, use)

    def counted(batches):
        for b in batches:
            out = []
            for _, raw, offs in tx.chunks(b.column("_text"), CHUNK):
                parts = list(features(raw, offs, bits, grams))
                edges = [np.searchsorted(at, offs) for _, at in parts]
                for i in range(len(offs) - 1):
                    ids, n = np.unique(np.concatenate([f[e[i] : e[i + 1]] for (f, _), e in zip(parts, edges, strict=True)]), return_counts=True)
                    out.append(packed(ids, n))
            yield pa.RecordBatch.from_pydict({"k": b.column(key).cast(pa.string()), "y": b.column("_y_y").cast(pa.int32()), "counts": pa.array(out, pa.binary())})

    got = sample.mapInArrow(counted, "k string, y int, counts binary").toArrow().sort_by("k")
    if not got.num_rows:
        return None
    return fit(PackedRows(got.column("counts").to_pylist(), got.column("y").to_pylist()), bits=bits, **options)


def batch_scores(texts: pa.Array, table: np.ndarray, bias: float, bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> np.ndarray:
    """The probability of class 1 of each text, from what each bucket adds and the bias."""
    found = np.zeros(len(texts))
    for first, raw, offs in tx.chunks(texts, CHUNK):
        total, n = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
        for ids, at in features(raw, offs, bits, grams):
            edges = np.searchsorted(at, offs)
            sums = np.concatenate([[0.0], np.cumsum(table[ids], dtype=np.float64)])
            total += sums[edges[1:]] - sums[edges[:-1]]
            n += np.diff(edges)
        logit = total / np.maximum(n, 1) + bias
        found[first : first + len(n)] = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return found


def score(docs: DataFrame, model: SubwordModel | None, text: str = "text", out: str = "score", bits: int = BITS, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """Add the probability of class 1 of each whole text.

    A batch of texts costs a few passes over its bytes; memory is bounded by a chunk of about 128 KB or the
    longest text.  Null and empty texts have no features and get what the bias says; without a model
    every score is 0.5.  Other columns and repeated rows stay as they are; an empty table stays empty.
    """
    spark = docs.sparkSession
    if model is None:
        from pyspark.sql import functions as F

        return docs.withColumn(out, F.lit(0.5))
    s = model.bucket_scores()
    shared = spark.sparkContext.broadcast(((s[:, 1] - s[:, 0]).astype(np.float32), float(model.bias[1] - model.bias[0])))
    kept = [c for c in docs.columns if c != out]

    def scored(batches):
        table, bias = shared.value
        for b in batches:
            found = batch_scores(b.column(text), table, bias, bits, grams)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(found)], names=[*kept, out])

    schema = docs.select(*kept).schema.add(out, "double")
    return docs.select(*kept).mapInArrow(scored, schema)
