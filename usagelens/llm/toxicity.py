"""Toxicity categories from a chain of linear classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm import text as tx
from usagelens.llm.sample import labelled

BITS = 20
PREFIXES = (4, 5, 6)
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
_VALUES = tx.byte_values(1)[tx.LOWER]


def present(raw: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket), each once: the words in lower case, and the first 4, 5 and 6 bytes of longer words."""
    starts, ends, owner = tx.word_spans(raw, offs, WORD_BYTES)
    found = []
    for n in (None, *PREFIXES):
        at = np.arange(len(starts)) if n is None else np.flatnonzero(ends - starts > n)
        stop = ends[at] if n is None else starts[at] + n
        h = tx.span_hashes(raw, starts[at], stop, _VALUES)
        if n is not None:
            h = tx.mixed(h + np.uint64(n))
        found.append((owner[at].astype(np.int64) << bits) | (h >> np.uint64(64 - bits)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class Link:
    """A linear model: weights of the buckets that count, of the earlier categories' probabilities, and the bias."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _dot(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


class Presence:
    """Which document holds which bucket, laid out both ways so that sums are runs of one array."""

    def __init__(self, doc: np.ndarray, col: np.ndarray, n: int, width: int):
        self.shape = (n, width)
        self.col_of, self.doc_at = col, np.unique(doc, return_index=True)
        order = np.argsort(col, kind="stable")
        self.doc_of, self.col_at = doc[order], np.unique(col[order], return_index=True)

    @staticmethod
    def _sums(values: np.ndarray, at: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        out = np.zeros(n)
        if len(values):
            out[at[0]] = np.add.reduceat(values, at[1])
        return out

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """For each document the sum over its buckets."""
        return self._sums(weights[self.col_of], self.doc_at, self.shape[0])

    def gradient(self, error: np.ndarray) -> np.ndarray:
        """For each bucket the sum over its documents."""
        return self._sums(error[self.doc_of], self.col_at, self.shape[1])


def fit_link(held: Presence, extra: np.ndarray, y: np.ndarray, rounds: int = 150, l1: float = 2.0, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on presence with an L1 penalty, by proximal gradient steps of adapted length."""
    n, width = held.shape
    w, e, b = np.zeros(width), np.zeros(extra.shape[1]), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    gw, ge, gb = np.full(width, 1e-3), np.full(extra.shape[1], 1e-3), 1e-3
    for _ in range(rounds):
        error = _sigmoid(held.scores(w) + extra @ e + b) - y
        g = held.gradient(error)
        gw += g * g
        step = rate / np.sqrt(gw)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        g = extra.T @ error
        ge += g * g
        e = e - rate * g / np.sqrt(ge)
        gb += error.sum() ** 2
        b -= rate * error.sum() / np.sqrt(gb)
    return w, e, b


def fit_chain(doc: np.ndarray, buckets: np.ndarray, targets: np.ndarray, folds: int = 4, least: int = 8, seed: int = 1) -> list[Link]:
    """One link for each column of ``targets``, in order.

    ``doc`` and ``buckets`` say which document (row of ``targets``) holds which bucket, each once.

    A link is trained on the probabilities that earlier links give documents they were *not* trained on: of
    ``folds`` parts each is predicted by a model of the others.  The link that is kept is fitted on all.
    Buckets of fewer than ``least`` documents take no part.
    """
    n = len(targets)
    keep = np.bincount(buckets, minlength=1 << BITS) >= least
    number = (np.cumsum(keep) - 1).astype(np.int32)
    used = keep[buckets]
    doc, col, names = doc[used], number[buckets[used]], np.flatnonzero(keep)
    part = np.random.default_rng(seed).integers(0, folds, n)
    every = Presence(doc, col, n, len(names))
    others = []
    for f in range(folds):
        inside = part != f
        own, new = inside[doc], np.cumsum(inside, dtype=np.int32) - 1
        others.append(Presence(new[doc[own]], col[own], int(inside.sum()), len(names)))
    extra, links = np.zeros((n, 0)), []
    for j in range(targets.shape[1]):
        y = targets[:, j].astype(float)
        unseen = np.zeros(n)
        for f, held in enumerate(others):
            inside = part != f
            w, e, b = fit_link(held, extra[inside], y[inside])
            unseen[~inside] = (every.scores(w) + extra @ e + b)[~inside]
        w, e, b = fit_link(every, extra, y)
        some = w != 0
        links.append(Link(names[some], w[some], e, b))
        extra = np.column_stack([extra, _sigmoid(unseen)])
    return links


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text", bound: int = 8000, use: Column | None = None, **options) -> list[Link]:
    """Fit the chain over ``categories`` (name to a 0/1 column of ``labels``, in the chain's order) on at most ``bound`` labelled documents.

    Tasks find the words; the driver gets bucket numbers.  Without labelled documents the chain is empty.
    """
    sample = labelled(docs, labels, key, text, categories, bound, use)
    targets = [f"_y_{c}" for c in categories]

    def found(batches):
        for b in batches:
            out = []
            for _, raw, offs in tx.chunks(b.column("_text")):
                row, bucket = present(raw, offs)
                out += np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, len(offs) - 1)))
            ys = pa.array(np.column_stack([b.column(t).to_numpy() for t in targets]).astype(np.int32).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"k": b.column(key).cast(pa.string()), "y": ys, "ids": pa.array(out, pa.list_(pa.int32()))})

    got = sample.mapInArrow(found, "k string, y array<int>, ids array<int>").toArrow().sort_by("k").combine_chunks()
    if not got.num_rows:
        return []
    ids = got.column("ids").combine_chunks()
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ids.offsets.to_numpy()))
    return fit_chain(doc, ids.flatten().to_numpy(), np.array(got.column("y").to_pylist()), **options)


def score(docs: DataFrame, chain: list[Link], categories: list[str], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add ``p_<category>`` for each link of the chain, and ``toxic``: whether the last category reaches ``threshold``.

    Whole texts are read in chunks of about 1 MB.  Null and empty texts hold no words and get what
    the biases say; without a chain (no labels) all probabilities are 0.  Columns that have these names are
    replaced, other columns and repeated rows stay; an empty table stays empty.
    """
    names = [f"p_{c}" for c in categories]
    kept = [c for c in docs.columns if c not in (*names, "toxic")]
    width = 1 << BITS
    tables = []
    for link in chain:
        w = np.zeros(width, np.float32)
        w[link.buckets] = link.weights
        tables.append((w, link.earlier, link.bias))
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def scored(batches):
        for b in batches:
            p = np.zeros((b.num_rows, len(names)))
            for first, raw, offs in tx.chunks(b.column(text)):
                row, bucket = present(raw, offs)
                n = len(offs) - 1
                for j, (w, earlier, bias) in enumerate(shared.value):
                    p[first : first + n, j] = _sigmoid(_dot(row, w[bucket].astype(float), n) + p[first : first + n, :j] @ earlier + bias)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(p[:, j]) for j in range(len(names))]], names=[*kept, *names])

    schema = docs.select(*kept).schema
    for x in names:
        schema = schema.add(x, "double")
    return docs.select(*kept).mapInArrow(scored, schema).withColumn("toxic", F.col(names[-1]) >= threshold)
