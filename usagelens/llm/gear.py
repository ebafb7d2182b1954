"""Removal of repeated passages by content-defined chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm import text as tx
from usagelens.llm.store import written

SHORTEST, MEAN_BITS, LONGEST = 32, 5, 192
REACH = 32
_GEAR = tx.byte_values(11)
_START = bytes(16)


def cuts(raw: np.ndarray, shortest: int = SHORTEST, bits: int = MEAN_BITS, longest: int = LONGEST) -> np.ndarray:
    """Ends of the chunks of one text.

    Gear hash: h = 2 h + value of the byte; after 32 bytes older ones have left the upper half of the word that is looked
    at, so a boundary depends on the 32 bytes before it and not on what was inserted earlier.  A chunk ends
    where ``bits`` bits are 0, at least ``shortest`` and at most ``longest`` bytes long.
    """
    n = len(raw)
    h = _GEAR[raw]
    span = 1
    while span < REACH:  # sums of 2, 4, 8, ... shifted values
        h[span:] = h[span:] + (h[:-span] << np.uint64(span))
        span *= 2
    # The top bits of the lower half hold all 32 bytes.
    ends = (np.flatnonzero(((h >> np.uint64(32 - bits)) & np.uint64((1 << bits) - 1)) == 0) + 1).tolist()
    out, last = [], 0
    for e in ends:
        while e - last > longest:
            last += longest
            out.append(last)
        if e - last >= shortest:
            out.append(e)
            last = e
    while n - last > longest:
        last += longest
        out.append(last)
    if last < n:
        out.append(n)
    return np.asarray(out, dtype=np.int64)


def _chunk_rows(batches, shortest, bits, longest):
    for b in batches:
        ids = b.column("doc").to_pylist()
        docs, digests, firsts, sizes = [], [], [], []
        for first, raw, offs in tx.chunks(b.column("text")):
            for i in range(len(offs) - 1):
                own = raw[offs[i] : offs[i + 1]]
                body, at, digest = own.tobytes(), 0, _START
                for e in cuts(own, shortest, bits, longest).tolist():
                    docs.append(ids[first + i])
                    if e - at < shortest:  # the end of the text, known with what stands before it
                        digest = hashlib.blake2b(digest + body[at:e], digest_size=16, person=b"end").digest()
                    else:
                        digest = hashlib.blake2b(body[at:e], digest_size=16).digest()
                    digests.append(digest)
                    firsts.append(at)
                    sizes.append(e - at)
                    at = e
        two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        cols = [pa.array(docs, pa.int64()), pa.array(np.ascontiguousarray(two[:, 0])), pa.array(np.ascontiguousarray(two[:, 1])), pa.array(firsts, pa.int32()), pa.array(sizes, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc", "d1", "d2", "at", "size"])


def chunk_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, bits: int = MEAN_BITS, longest: int = LONGEST, ends: bool = False) -> DataFrame:
    """(key, n_bytes, n_chunks, n_removed_chunks, n_removed, spans, kept) of each row.

    A chunk of at least ``shortest`` bytes is removed if an equal chunk stands earlier: in a document with a smaller key, or
    further up in the same one.  Only the last chunk of a text can be shorter.  With ``ends`` it is removed if an earlier
    text ends in the same chunk after an equal chunk, or is nothing but that chunk as this text is: so copies and copied
    endings go whole, while a short ending that texts share by chance stays.  Without it short ends always stay.
    ``spans`` are the removed (first, end), ``kept`` the remaining bytes.

    Digests are summed to their first place with a map-side combine, and only digests that stand twice meet the
    chunks again, in a join that Spark may split; so a chunk that every document holds is no hot group.
    Chunks have 128-bit digests.  A copied passage is found from its second chunk boundary on, where both sides cut alike
    again.

    Texts count as UTF-8; null and empty texts have no chunks.  Rows with a null key keep everything and are no source;
    repeated rows of one key get equal results: the rows of a key are taken to be one document.  Other columns take
    no part; an empty table gives an empty result.
    """
    source = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = source.mapInArrow(lambda b: _chunk_rows(b, shortest, bits, longest), "doc long, d1 long, d2 long, at int, size int")
    judged = chunks.filter(F.col("doc").isNotNull() & (F.lit(ends) | (F.col("size") >= shortest)))
    place = F.struct("doc", "at")
    first = judged.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").drop("last")
    # Written, so that both sides of the next join are shuffled for it and Spark can split a hot digest.
    first = written(first, "digests")
    gone = judged.join(first, ["d1", "d2"]).filter(place > F.col("first")).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("gone"))
    gone = written(gone, "gone")

    def remove(batches):
        for b in batches:
            out = []
            lists = b.column("gone")
            for first, raw, offs in tx.chunks(b.column("text")):
                for i in range(len(offs) - 1):
                    own = raw[offs[i] : offs[i + 1]]
                    spans: list[list[int]] = []
                    chunks = lists[first + i].as_py() or []
                    for c in chunks:
                        if spans and spans[-1][1] == c["at"]:
                            spans[-1][1] += c["size"]
                        else:
                            spans.append([c["at"], c["at"] + c["size"]])
                    body, at, kept = own.tobytes(), 0, []
                    for a, e in spans:
                        kept.append(body[at:a])
                        at = e
                    kept.append(body[at:])
                    out.append((len(own), len(cuts(own, shortest, bits, longest)), len(chunks), sum(e - a for a, e in spans), [{"first": a, "end": e} for a, e in spans], b"".join(kept)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.binary())
            names = ["n_bytes", "n_chunks", "n_removed_chunks", "n_removed", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *[pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)]], names=["doc", *names])

    shape = "doc long, n_bytes long, n_chunks long, n_removed_chunks long, n_removed long, spans array<struct<first:long,end:long>>, kept binary"
    return source.join(gone, "doc", "left").select("doc", "text", "gone").mapInArrow(remove, shape).withColumnRenamed("doc", key)
