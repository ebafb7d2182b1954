"""Near-duplicate documents by a token-group matrix: groups of similar sets with the union of their tokens.

A document's set holds the hashes of its runs of ``k`` words.  Groups gather sets that are known to be linked;
a group's row of the matrix is the union of its members' tokens.  A set can be linked with a member only if
it shares enough tokens with the row, so other groups are never opened.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm import text as tx
from usagelens.llm.components import components
from usagelens.llm.store import written

SKETCH_BITS = 18
SKETCH_PARTS = 16
GROUP = 64
MINS = 4
_VALUES = tx.byte_values(7)[tx.LOWER]


def token_sets(raw: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct tokens of each text; a text of fewer than ``k`` words has one token, without words none."""
    starts, ends, owner = tx.word_spans(raw, offs, tx.NOT_SPACE)
    words = tx.span_hashes(raw, starts, ends, _VALUES)
    grams, at = tx.gram_hashes(words, owner, k)
    edges = np.searchsorted(owner[at], np.arange(len(offs)))
    counts = np.searchsorted(owner, np.arange(len(offs)))
    out = []
    for i in range(len(offs) - 1):
        own = grams[edges[i] : edges[i + 1]]
        n = counts[i + 1] - counts[i]
        if 0 < n < k:
            own = tx.gram_hashes(words[counts[i] : counts[i + 1]], np.zeros(n, int), int(n))[0]
        out.append(np.unique(own))
    return out


def _needed(n: int, percent: int) -> int:
    """Tokens of a set of ``n`` that any linked set holds."""
    return -(-percent * n // 100)


def _batches(batches, key: str, text: str, k: int):
    for b in batches:
        ids = b.column(key).to_pylist()
        for first, raw, offs in tx.chunks(b.column(text)):
            yield ids[first : first + len(offs) - 1], token_sets(raw, offs, k)


def frequency_sketch(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """How many documents hold the tokens of each of 2^18 classes, over all documents: 2 MB whatever their number.

    It only orders tokens, frequent ones last, so that prefixes hold few of them; any order gives the same links.
    """
    size = 1 << SKETCH_BITS
    part = size // SKETCH_PARTS

    def count(batches):
        total = np.zeros(size, np.int64)
        seen = False
        for _, sets in _batches(batches, "_i", "_t", k):
            seen = True
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        if seen:
            salt = int(total.sum()) % 64
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(range(SKETCH_PARTS), pa.int32()), "salt": pa.array([salt] * SKETCH_PARTS, pa.int32()),
                "n": pa.array([total[i * part : (i + 1) * part].tobytes() for i in range(SKETCH_PARTS)], pa.binary()),
            })

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf.n)
        return pd.DataFrame({"part": pdf.part[:1], "salt": pdf.salt[:1], "n": [total.tobytes()]})

    shape = "part int, salt int, n binary"
    counts = docs.select(F.lit(0).alias("_i"), F.col(text).alias("_t")).mapInArrow(count, shape).groupBy("part", "salt").applyInPandas(add, shape)
    counts = counts.withColumn("salt", F.lit(0)).groupBy("part").applyInPandas(add, shape)
    out = np.zeros(size, np.int64)
    for r in counts.collect():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["n"], np.int64)
    return out


def _sets(docs: DataFrame, k: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(id, n, d1, d2, prefix, mins, bits): size, digest, rarest tokens, minima under a few hashes, and bitmap of each set.

    A bitmap has between two and four bits for a token, in a number of words that is a power of two.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def describe(batches):
        order = shared.value
        for ids, sets in _batches(batches, "id", "text", k):
            rows = []
            for i, s in zip(ids, sets, strict=True):
                n = len(s)
                d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                rank = np.lexsort((s, order[s >> np.uint64(64 - SKETCH_BITS)]))[: n - _needed(n, percent) + 1 if n else 0]
                mins = [int(tx.mixed(s + np.uint64(j)).min().astype(np.int64)) for j in range(MINS)] if n else []
                words = 1 << max(0, int(np.ceil(np.log2(max(n, 1) / 32))))
                flags = np.zeros(64 * words, bool)
                flags[(s & np.uint64(64 * words - 1)).astype(np.int64)] = True
                rows.append((i, n, int(d[0]), int(d[1]), s[rank].astype(np.int64), mins, np.packbits(flags, bitorder="little").view(np.int64)))
            kinds = [("id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("mins", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])

    return docs.mapInArrow(describe, "id long, n int, d1 long, d2 long, prefix array<long>, mins array<long>, bits array<long>")


def _tokens_of(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(id, tokens) of the documents named in ``needed`` (id)."""

    def tokens(batches):
        for ids, sets in _batches(batches, "id", "text", k):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "tokens"])

    return written(docs.join(needed.distinct(), "id", "left_semi").mapInArrow(tokens, "id long, tokens array<long>"), "tokens")


def _folded(bits: Column, words: Column) -> Column:
    """A bitmap brought down to ``words`` words: halves are laid over each other."""

    def half(b: Column, _: Column) -> Column:
        n = (F.size(b) / 2).cast("int")
        return F.zip_with(F.slice(b, F.lit(1), n), F.slice(b, n + 1, n), lambda x, y: x.bitwiseOR(y))

    folds = F.round(F.log2(F.size(bits) / words)).cast("int")
    return F.when(folds > 0, F.aggregate(F.sequence(F.lit(1), folds), bits, half)).otherwise(bits)


def _may_hold(q: Column, n: Column, union: Column, percent: int) -> Column:
    """Can a union with this bitmap hold ``percent`` of the ``n`` tokens with bitmap ``q``?

    A token whose bit is not in the union's bitmap is not in the union; a bit of ``q`` stands for one token at least.
    """
    words = F.least(F.size(q), F.size(union))
    lost = F.zip_with(_folded(q, words), _folded(union, words), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return (n - F.aggregate(lost, F.lit(0), lambda a, x: a + x)) * 100 >= n * percent


def _linked(a: Column, b: Column, percent: int) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common * 100 >= (F.size(a) + F.size(b) - common) * percent


def _bounded(pairs: DataFrame, own: DataFrame, left: str, right: str, percent: int) -> DataFrame:
    """The pairs that the bitmaps do not rule out."""
    ids = pairs.select(F.col(left).alias("rep")).union(pairs.select(right)).distinct()
    bits = written(own.select("rep", "n", "bits").join(ids, "rep", "left_semi"), "bits")
    both = pairs.join(bits.toDF(left, "n1", "b1"), left).join(bits.toDF(right, "n2", "b2"), right)
    kept = both.filter(_may_hold(F.col("b1"), F.col("n1"), F.col("b2"), percent) & _may_hold(F.col("b2"), F.col("n2"), F.col("b1"), percent))
    return written(kept.select(left, right).distinct(), "pairs")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of each row: the size of its set, and the smallest key reachable by links.

    Two documents link when 100 times their common tokens reach ``percent`` times the tokens of both.

    1. Equal sets are one set from here on, named by their smallest key.
    2. Sets that share a minimum under one of four hashes are compared with the smallest of them, and the links
       found are followed: these are the first groups, of at most 64 sets each (a component of more sets has
       several groups).  A thousand near copies become a few groups without a thousand squared comparisons.
    3. Every other link joins two components.  Then the rarest tokens of the two sets, as many as a linked set
       cannot all lack, have one in common; so the matrix, restricted to such tokens, names the groups a set
       may be linked into.  The bound comes next: ``percent`` of the set's tokens must be in the group's union,
       whose row of the matrix is a bitmap, so that the bound is never too low.  Only then is the group
       opened and the set compared with its members.
    4. Links between components are followed to the end.

    No link between different components is lost.  Tokens are 64-bit hashes: unequal shingles of one pair of
    texts collide with a chance below 10^-11.  Sets are only shuffled for documents with a candidate.

    Null and empty texts and texts without words have an empty set, size 0 and link with nothing; texts of
    fewer than ``k`` words have one token.  Rows of one key are one node; rows with a null key get their size,
    take part in nothing, and have a null component.  Other columns take no part; an empty table gives an empty result.
    """
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = frequency_sketch(source, "text", k)
    sets = written(_sets(source, k, percent, sketch), "sets")
    reps = written(sets.filter((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("d1", "d2", "n").agg(F.min("id").alias("rep")), "reps")
    own = sets.withColumnRenamed("id", "rep").join(reps.select("rep").distinct(), "rep", "left_semi").filter("n > 0")

    level = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.25))).cast("int").alias("level")
    mins = own.select("rep", level, F.posexplode("mins").alias("j", "h"))
    leaders = mins.groupBy("j", "h", "level").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last").drop("last")
    pairs = written(mins.join(leaders, ["j", "h", "level"]).filter("rep <> leader").select("rep", "leader").distinct(), "pairs")
    pairs = _bounded(pairs, own, "rep", "leader", percent)
    tokens = _tokens_of(source, pairs.select(F.col("rep").alias("id")).union(pairs.select("leader")), k)
    a, b = tokens.toDF("rep", "ta"), tokens.toDF("leader", "tb")
    links = pairs.join(b, "leader").join(a, "rep").filter(_linked(F.col("ta"), F.col("tb"), percent)).select("rep", "leader")
    first = written(components(written(links, "links"), "rep", "leader"), "components")

    member = reps.select("rep").distinct().join(first.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    sizes = first.groupBy(F.col("component").alias("comp")).agg(F.count(F.lit(1)).alias("members"))
    member = member.join(sizes, "comp", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    member = written(member.withColumn("slot", F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / GROUP)).cast("int")), "members")

    prefixes = own.select("rep", "n", "prefix")
    across = prefixes.join(member.select("rep", "comp"), "rep").select("comp", F.explode("prefix").alias("token"))
    across = written(across.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token"), "across")
    rare = written(prefixes.select("rep", "n", F.explode("prefix").alias("token")).join(across, "token").join(member, "rep"), "rare")
    matrix = rare.groupBy("token", "comp", "slot", "members").agg(F.min("n").alias("n_least"), F.max("n").alias("n_most"))
    matrix = matrix.select("token", F.col("comp").alias("g_comp"), F.col("slot").alias("g_slot"), F.col("members").alias("g_members"), "n_least", "n_most")
    # Each pair of components is looked at from the smaller one.
    turn = F.struct("members", "comp") < F.struct(F.col("g_members").alias("members"), F.col("g_comp").alias("comp"))
    fits = (F.col("n") * 100 >= F.col("n_least") * percent) & (F.col("n_most") * 100 >= F.col("n") * percent)
    cand = written(rare.join(matrix, "token").filter(turn & fits).select("rep", "comp", "g_comp", "g_slot").distinct(), "candidates")

    group = ["g_comp", "g_slot"]
    inside = member.select("rep", F.col("comp").alias("g_comp"), F.col("slot").alias("g_slot"))
    rows = written(inside.join(cand.select(*group).distinct(), group).join(own.select("rep", "bits"), "rep"), "rows")
    words = rows.groupBy(*group).agg(F.min(F.size("bits")).alias("words"))
    bit = rows.join(words, group).select(*group, F.posexplode(_folded(F.col("bits"), F.col("words"))).alias("at", "bit"))
    union = bit.groupBy(*group, "at").agg(F.bit_or("bit").alias("bit")).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at", "bit")))["bit"].alias("union"))
    asked = own.select("rep", "n", "bits").join(cand.select("rep").distinct(), "rep", "left_semi")
    bounded = cand.join(asked, "rep").join(union, group).filter(_may_hold(F.col("bits"), F.col("n"), F.col("union"), percent))
    cand = written(bounded.select("rep", "comp", *group).distinct(), "qualifying")

    inside = written(rows.select("rep", *group).join(cand.select(*group).distinct(), group), "inside")
    tokens = _tokens_of(source, inside.select(F.col("rep").alias("id")).union(cand.select("rep")), k)
    a, b = tokens.toDF("rep", "ta"), tokens.toDF("rep", "tb")
    groups = inside.join(b, "rep").groupBy(*group).agg(F.collect_list("tb").alias("sets"))
    opened = F.exists("sets", lambda s: _linked(F.col("ta"), s, percent))
    more = cand.join(a, "rep").join(groups, group).filter(opened).select("comp", "g_comp").distinct()
    second = components(written(more, "links"), "comp", "g_comp").toDF("comp", "last")

    of = member.select("rep", "comp").join(second, "comp", "left").select("rep", F.coalesce("last", "comp").alias("component_id"))
    of = reps.select("d1", "d2", "n", "rep").join(of, "rep").groupBy("d1", "d2", "n").agg(F.min("component_id").alias("component_id"))
    out = sets.select("id", "n", "d1", "d2").join(of, ["d1", "d2", "n"], "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
