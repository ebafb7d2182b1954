"""Repeated passages of a corpus from merged Burrows-Wheeler transforms.

Windows of ``length`` bytes are brought together by their minimizer, the place of the least hash in them:
equal windows have equal minimizers.  A run of windows with one minimizer is a piece.  Pieces that meet in
a task are dealt to shards; each shard's transform is built alone, the transforms are merged by refining
their interleave, and runs of the merged order with a common prefix of ``length`` bytes are the repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm import text as tx
from usagelens.llm.store import written

LENGTH = 50
K = 20
SHARDS = 4
BATCH_BYTES = 1 << 18
#: A minimizer with more distinct pieces than this is taken apart into windows.
PIECES = 4096
_VALUES, _WHOLE = tx.byte_values(3), tx.byte_values(4)


def minimizers(raw: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer) of the pieces of one text, which together hold all its windows.

    The least hash of the ``length - k + 1`` runs of ``k`` bytes in a window, at its first place.
    """
    n = len(raw) - length + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64)
    at = np.arange(len(raw) - k + 1)
    h = tx.span_hashes(raw, at, at + k, _VALUES)
    # Minimum over w places by doubling: spans of 1, 2, 4, ... and one overlap.
    w, span, least = length - k + 1, 1, h
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: n], least[w - span : w - span + n])
    place = np.zeros(n, dtype=bool)
    place[0] = True
    # The place changes when the value does, and when it stays but the old place has left the window.
    place[1:] = (least[1:] != least[:-1]) | (h[: n - 1] == least[:-1])
    first = np.flatnonzero(place)
    return first, np.diff(np.append(first, n)), least[first]


class Shard:
    """The rotations of a shard's pieces in order: the place each starts at, the symbol before it, and its first symbols as a number.

    Sorted by their first 8 symbols as numbers, then by twice as many each time, where rotations are still equal; up to ``depth``.
    """

    def __init__(self, symbols: np.ndarray, before: np.ndarray, after: np.ndarray, depth: int = 512):
        code, jump = symbols.astype(np.uint64), after
        for bits in (8, 16, 32):
            code, jump = code << np.uint64(bits) | code[jump], jump[jump]
        n, reach = len(code), 8
        order = np.argsort(code)
        self.codes = code[order]
        at = np.arange(n)
        head = np.ones(n + 1, dtype=bool)
        head[1:-1] = self.codes[1:] != self.codes[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head[:-1], at, 0))
        while reach < depth:
            tied = np.flatnonzero(~(head[:-1] & head[1:]))
            if not len(tied):
                break
            own = order[tied]
            key = rank[own] * n + rank[jump[own]]
            by_key = np.argsort(key, kind="stable")
            own, key = own[by_key], key[by_key]
            first = np.ones(len(own), dtype=bool)
            first[1:] = key[1:] != key[:-1]
            order[tied], head[tied] = own, first
            rank[own] = tied[np.maximum.accumulate(np.where(first, at[: len(tied)], 0))]
            jump, reach = jump[jump], reach * 2
        self.start = order
        self.last = symbols[before[order]]


def runs_before(shards: list[Shard], befores: list[np.ndarray], length: int) -> tuple[list[np.ndarray], int]:
    """Transforms whose symbols are the ``step`` symbols before each rotation, numbered in order over all shards; and ``step``.

    ``step`` divides ``length``, is 5 at most, and such that 16 bits hold the numbers.
    """
    for step in range(5, 0, -1):
        if length % step == 0:
            runs = [s.codes >> np.uint64(64 - 8 * step) for s in shards]
            heads = [np.concatenate([[True], r[1:] != r[:-1]]) for r in runs]
            distinct = np.unique(np.concatenate([r[h] for r, h in zip(runs, heads, strict=True)]))
            if len(distinct) <= 1 << 16:
                break
    lasts = []
    for s, r, h, before in zip(shards, runs, heads, befores, strict=True):
        number = np.empty(len(r), np.uint16)
        number[s.start] = np.searchsorted(distinct, r[h]).astype(np.uint16)[np.cumsum(h) - 1]
        at = s.start
        for _ in range(step):
            at = before[at]
        lasts.append(number[at])
    return lasts, step


def joined(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, previous place, next place, piece, offset): pieces one after the other, each closed by symbol 0."""
    sizes = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.zeros(int(starts[-1]), dtype=np.uint8)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    at = np.arange(len(symbols))
    ends = starts[1:] - 1
    body = np.ones(len(symbols), dtype=bool)
    body[ends] = False
    symbols[body] = np.frombuffer(b"".join(pieces), np.uint8) + np.uint8(1)
    before, after = at - 1, at + 1
    before[starts[:-1]] = ends
    after[ends] = starts[:-1]
    return symbols, before, after, owner, at - starts[owner]


def interleaved(lasts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each place of the merged order, common prefix with the place before, up to ``depth``).

    Merges transforms without looking at the texts: the interleave starts as one shard after the other; each
    round deals its places to the buckets of their last symbols, in order, after which it is sorted by one
    symbol more.  A boundary between two places is drawn in the round in which they first fall apart; that
    round tells their common prefix.  Ends after ``depth`` rounds, or when all places are apart.  A symbol may stand for
    a run of them, see :func:`runs_before`; prefixes count in symbols.
    """
    shard = np.repeat(np.arange(len(lasts), dtype=np.uint8), [len(x) for x in lasts])
    every = np.concatenate(lasts)
    n = len(shard)
    block = np.zeros(n, np.int32)
    common = np.full(n, depth, np.int16)
    if n:
        common[0] = 0
    symbol = np.empty(n, every.dtype)
    for round_ in range(depth):
        symbol[np.argsort(shard, kind="stable")] = every
        order = np.argsort(symbol, kind="stable")
        shard, s, b = shard[order], symbol[order], block[order]
        apart = np.ones(n, dtype=bool)
        apart[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        block = np.cumsum(apart, dtype=np.int32)
        common[apart & (common == depth)] = round_
        if n == 0 or block[-1] == n:
            break
    return shard, common


def least_owners(pieces: list[bytes], owners: np.ndarray, length: int = LENGTH, n_shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each piece, one piece after the other, the least owner of a piece that holds it; and where each piece's windows begin.

    Shards are sorted by the first ``length`` symbols, which is as far as the merge reads.
    """
    dealt = [np.arange(i, len(pieces), n_shards) for i in range(min(n_shards, len(pieces)))]
    parts = [joined(pieces[i::n_shards]) for i in range(len(dealt))]
    shards = [Shard(*p[:3], depth=length) for p in parts]
    lasts, step = runs_before(shards, [p[1] for p in parts], length)
    merged, common = interleaved(lasts, length // step)
    # The n-th place that belongs to a shard is the n-th rotation of that shard.
    order = np.argsort(merged, kind="stable")
    piece, offset = np.empty(len(merged), np.int64), np.empty(len(merged), np.int64)
    piece[order] = np.concatenate([d[p[3][s.start]] for d, p, s in zip(dealt, parts, shards, strict=True)])
    offset[order] = np.concatenate([p[4][s.start] for p, s in zip(parts, shards, strict=True)])
    heads = np.flatnonzero(common < length // step)
    least = np.repeat(np.minimum.reduceat(owners[piece], heads), np.diff(np.append(heads, len(merged))))
    windows = np.array([len(p) - length + 1 for p in pieces])
    starts = np.concatenate([[0], np.cumsum(windows)])
    flat = np.empty(int(starts[-1]), np.int64)
    good = offset < windows[piece]
    flat[starts[piece[good]] + offset[good]] = least[good]
    return flat, starts


def least_owner(pieces: list[bytes], owners: np.ndarray, length: int = LENGTH, n_shards: int = SHARDS) -> list[np.ndarray]:
    """For each window of each piece, the least owner of a piece that holds the same window."""
    flat, starts = least_owners(pieces, owners, length, n_shards)
    return np.split(flat, starts[1:-1])


_RUNS = "mark long, p long, runs array<struct<first:int,end:int>>"


def _flush(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Of the pieces that have windows with a smaller owner than their own: the bytes that these cover, as (first, end) in the piece."""
    owners = np.array([r[3] for r in rows], np.int64)
    flat, starts = least_owners([r[2] for r in rows], owners, length)
    piece = np.repeat(np.arange(len(rows)), np.diff(starts))
    gone = flat < owners[piece]
    begins, ends = gone.copy(), gone.copy()
    joins = gone[1:] & gone[:-1] & (piece[1:] == piece[:-1])
    begins[1:] &= ~joins
    ends[:-1] &= ~joins
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    of = piece[begins]
    some, first = np.unique(of, return_index=True)
    runs = pa.StructArray.from_arrays([pa.array(begins - starts[of], pa.int32()), pa.array(ends - starts[of] + length, pa.int32())], names=["first", "end"])
    return pa.RecordBatch.from_pydict({
        "mark": pa.array([rows[i][0] for i in some], pa.int64()), "p": pa.array([rows[i][1] for i in some], pa.int64()),
        "runs": pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), runs),
    })


def _of_two(batches):
    """Of rows sorted by ``mark`` those whose mark two documents have.  Only rows of a mark that has one document so far are held back."""
    held: list[pa.RecordBatch] = []
    alone = shared = None
    for b in batches:
        if not b.num_rows:
            continue
        ends = [(b.column("mark")[i].as_py(), b.column("doc")[i].as_py()) for i in (0, -1)]
        docs = b.column("doc").to_numpy()
        if held and ends[0] == ends[1] == alone and (docs == docs[0]).all():
            held.append(b)
            continue
        if held:
            b = pa.concat_batches([*held, b])
            docs, held = b.column("doc").to_numpy(), []
        marks = b.column("mark").to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
        two = np.minimum.reduceat(docs, heads) < np.maximum.reduceat(docs, heads)
        two[0] |= marks[0] == shared
        shared, alone = (int(marks[-1]), None) if two[-1] else (None, ends[1])
        if not two[-1]:
            held = [b.slice(heads[-1])]
        kept = np.repeat(two, np.diff(np.append(heads, len(marks))))
        if kept.any():
            yield b.filter(pa.array(kept))


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, pieces: int = PIECES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, kept_sha256, spans) of each row.

    Removed is every byte that a window of ``length`` bytes covers which also starts in a document with a
    smaller key; windows are judged on the input.  ``spans`` are the removed (first, end), ``kept`` the remaining bytes.

    1. Texts that equal a text of a smaller key are removed whole by rule (if they have a window) and end here.  Every other
       text is cut into pieces, once, and only pieces whose minimizer two documents have go on.
    2. The places of such pieces are written, with a hash of the piece beside its minimizer.  Equal pieces become one, with
       its least key and a place there, before the shuffle: a passage in a third of all documents is a few rows.
    3. A piece whose least key is smaller than the document's goes whole, as all its windows stand there.  What else goes are
       windows of the piece at its least key which other pieces of the minimizer hold with a smaller one.  So where a minimizer has
       several pieces, the bytes of one of each kind are read.  In each task they come in order of their minimizer, about 256 kB
       at a time, are dealt to four shards, and merged; the repeats of the merged order give each window its least key, and the
       runs of windows with a smaller key than the piece's are written.  A minimizer with more than ``pieces`` distinct pieces is
       not merged in one task: its windows are grouped as rows instead.
    4. A document's windows whose least key is smaller than its own are removed.

    Texts count as UTF-8; null and empty texts have no bytes, and texts below ``length`` bytes keep everything.
    Rows with a null key lose nothing and are no source.  Repeated rows give equal results and do not remove one another.
    A key is taken to name one text.  Other columns take no part; an empty table gives an empty result.
    """
    source = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = source.filter(F.col("doc").isNotNull() & (F.octet_length("text") >= length))
    digest = known.select("doc", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h1"), F.sha2("text", 256).alias("h2"))
    least = digest.groupBy("n", "h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").drop("most")
    copies = written(digest.join(least, ["n", "h1", "h2"]).filter("doc > least").select("doc").distinct(), "copies")

    def cut(batches):
        for b in batches:
            found = []
            ids = np.asarray(b.column("doc").to_pylist())
            for first, raw, offs in tx.chunks(b.column("text")):
                for i in range(len(offs) - 1):
                    own = raw[offs[i] : offs[i + 1]]
                    at, n, mark = minimizers(own, length, k)
                    found.append((np.full(len(at), ids[first + i]), at, n, mark.astype(np.int64), tx.span_hashes(own, at, at + n + length - 1, _WHOLE).astype(np.int64)))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            cols = [pa.array(np.concatenate([f[j] for f in found] or [np.zeros(0, np.int64)]), t) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "at", "n", "mark", "p"])

    # Dealt out by minimizer once: what two documents have and the rows that have it are found in one pass.
    every = known.join(copies, "doc", "left_anti").mapInArrow(cut, "doc long, at int, n int, mark long, p long")
    every = every.repartition("mark").sortWithinPartitions("mark")
    cuts = written(every.mapInArrow(_of_two, every.schema), "cuts", records=20_000)
    kinds = cuts.groupBy("mark", "p").agg(F.min(F.struct("doc", "at", "n")).alias("o")).select("mark", "p", "o.*")
    counts = kinds.groupBy("mark").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = written(kinds.join(counts, "mark"), "kinds")
    several = kinds.filter("kinds > 1")

    def read(batches):
        for b in batches:
            out = []
            ids, wanted = b.column("doc").to_pylist(), b.column("wanted").to_pylist()
            for first, raw, offs in tx.chunks(b.column("text")):
                for i in range(len(offs) - 1):
                    body = raw[offs[i] : offs[i + 1]].tobytes()
                    out += [(w["mark"], w["p"], body[w["at"] : w["at"] + w["n"] + length - 1], ids[first + i], w["kinds"]) for w in wanted[first + i]]
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=["mark", "p", "piece", "owner", "kinds"])

    wanted = several.groupBy("doc").agg(F.collect_list(F.struct("mark", "p", "at", "n", "kinds")).alias("wanted"))
    bytes_ = written(known.join(wanted, "doc").mapInArrow(read, "mark long, p long, piece binary, owner long, kinds long"), "bytes")

    def merge(batches):
        rows: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("mark", "p", "piece", "owner")), strict=True):
                if row[:2] == last:  # a repeated row of the owner
                    continue
                if size >= BATCH_BYTES and row[0] != last[0]:
                    yield _flush(rows, length)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
                last = row[:2]
        if rows:
            yield _flush(rows, length)

    normal = bytes_.filter(F.col("kinds") <= pieces).drop("kinds").repartition("mark").sortWithinPartitions("mark", "p")
    lows = normal.mapInArrow(merge, _RUNS)
    hot = several.filter(F.col("kinds") > pieces)
    if not hot.isEmpty():
        windows = bytes_.filter(F.col("kinds") > pieces).select("mark", "p", "owner", "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - length + 1)).alias("i"))
        windows = windows.withColumn("window", F.expr(f"substring(piece, i, {length})")).drop("piece")
        by_window = windows.groupBy("window").agg(F.min("owner").alias("low"))
        of_hot = windows.join(by_window, "window").filter("low < owner").groupBy("mark", "p").agg(F.collect_set("i").alias("all"))
        spans = F.transform("all", lambda i: F.struct((i - 1).cast("int").alias("first"), (i - 1 + length).cast("int").alias("end")))
        lows = lows.unionByName(of_hot.select("mark", "p", spans.alias("runs")))
    lows = written(lows, "runs")

    solved = kinds.select("mark", "p", F.col("doc").alias("owner")).join(lows, ["mark", "p"], "left")
    met = cuts.join(solved, ["mark", "p"]).filter((F.col("owner") < F.col("doc")) | F.col("runs").isNotNull())
    moved = F.transform("runs", lambda r: F.struct((F.col("at") + r["first"]).alias("first"), (F.col("at") + r["end"]).alias("end")))
    whole = F.array(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("n") + (length - 1)).alias("end")))
    hit = F.when(F.col("owner") < F.col("doc"), whole).otherwise(moved)
    gone = met.select("doc", hit.alias("hit")).groupBy("doc").agg(F.flatten(F.collect_list("hit")).alias("hits"))
    gone = written(gone.withColumn("whole", F.lit(False)).unionByName(copies.select("doc", F.array().cast("array<struct<first:int,end:int>>").alias("hits"), F.lit(True).alias("whole"))), "gone")

    def remove(batches):
        for b in batches:
            out = []
            hits, whole = b.column("hits"), b.column("whole").to_pylist()
            for first, raw, offs in tx.chunks(b.column("text")):
                for i in range(len(offs) - 1):
                    own = raw[offs[i] : offs[i + 1]]
                    depth = np.zeros(len(own) + 1, np.int32)
                    if whole[first + i]:
                        depth[0], depth[-1] = 1, -1
                    elif hits[first + i].is_valid:
                        span = hits[first + i].values
                        np.add.at(depth, span.field("first").to_numpy(), 1)
                        np.add.at(depth, span.field("end").to_numpy(), -1)
                    inside = np.cumsum(depth)[:-1] > 0
                    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
                    spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
                    kept = own[~inside].tobytes()
                    out.append((len(own), int(inside.sum()), len(spans), kept, hashlib.sha256(kept).hexdigest(), [{"first": a, "end": e} for a, e in spans]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            names = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *[pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)]], names=["doc", *names])

    out = source.join(gone, "doc", "left").withColumn("whole", F.coalesce("whole", F.lit(False))).select("doc", "text", "hits", "whole")
    shape = "doc long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<first:long,end:long>>"
    return out.mapInArrow(remove, shape).withColumnRenamed("doc", key)
