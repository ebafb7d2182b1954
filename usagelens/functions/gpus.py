"""GPU sets as a bigint mask: bits 0..30 are card indices, 2^31 alone means "unknown"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.schemas import GPU_UNKNOWN

MAX_CARD = 30


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(mask: Column) -> Column:
    """A union of masks in which "unknown" absorbs everything else."""
    unknown = F.lit(GPU_UNKNOWN)
    return F.when(mask.bitwiseAND(unknown) != 0, unknown).otherwise(mask)


def gpu_set_union(c: Column | str) -> Column:
    """Aggregate: union of sets."""
    return normalise(F.coalesce(F.bit_or(_col(c)), F.lit(0).cast("bigint")))


def is_unknown(c: Column | str) -> Column:
    return _col(c) == GPU_UNKNOWN


def gpu_set_size(c: Column | str) -> Column:
    """Number of cards; NULL for the unknown set."""
    return F.when(~is_unknown(c), F.bit_count(_col(c)).cast("bigint"))


def gpu_set_compare(a: Column | str, b: Column | str, op: str) -> Column:
    """``op`` is one of ``=``, ``<``, ``<=``, ``>``, ``>=`` where ``<`` is proper inclusion."""
    a, b = _col(a), _col(b)
    if op == "=":
        return a == b
    if op in (">", ">="):
        a, b = b, a
    included = a.bitwiseAND(b) == a
    if op in ("<", ">"):
        included = included & (a != b)
    return included & ~is_unknown(a) & ~is_unknown(b)


def gpu_set_parse(c: Column | str) -> Column:
    """``none``, ``unknown`` or ``1,3`` to a mask; NULL for anything else, also an index over 30."""
    text = F.trim(_col(c))
    indices = F.transform(F.split(text, ","), lambda x: x.try_cast("int"))
    bits = F.transform(indices, lambda i: F.when(i.between(0, MAX_CARD), F.expr("1L")).otherwise(F.expr("NULL")))
    ok = F.forall(bits, lambda x: x.isNotNull())
    mask = F.aggregate(
        indices, F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.expr("1L"), i))
    )
    return (
        F.when(text == "none", F.lit(0).cast("bigint"))
        .when(text == "unknown", F.lit(GPU_UNKNOWN).cast("bigint"))
        .when(ok, mask)
    )


def gpu_set_indices(c: Column | str) -> Column:
    """Array of card indices, ascending; empty for the unknown set."""
    mask = F.when(is_unknown(c), F.lit(0).cast("bigint")).otherwise(_col(c))
    return F.filter(
        F.sequence(F.lit(0), F.lit(MAX_CARD)),
        lambda i: mask.bitwiseAND(F.call_function("shiftleft", F.expr("1L"), i)) != 0,
    )


def gpu_set_text(c: Column | str) -> Column:
    c = _col(c)
    return (
        F.when(c == 0, F.lit("none"))
        .when(is_unknown(c), F.lit("unknown"))
        .otherwise(F.array_join(gpu_set_indices(c).cast("array<string>"), ","))
    )


def gpu_set_cards(df: DataFrame, cards: DataFrame, gpus: str = "gpus", host: str = "host") -> DataFrame:
    """One row per card of the set, with the card's ``uuid`` and ``model``.

    ``cards`` has ``node, index, uuid, model``, one row per (node, index).
    """
    info = cards.select(
        F.col("node").alias("_node"), F.col("index").cast("int").alias("_index"), "uuid", "model"
    )
    exploded = df.withColumn("card_index", F.explode(gpu_set_indices(gpus)))
    return exploded.join(
        info, (F.col(host) == F.col("_node")) & (F.col("card_index") == F.col("_index")), "left"
    ).drop("_node", "_index")
