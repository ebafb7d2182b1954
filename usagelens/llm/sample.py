"""A bounded sample of labelled rows to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, targets: dict[str, Column], bound: int, use: Column | None = None) -> DataFrame:
    """(key, text, targets...) of at most ``bound`` keys whose targets are all known, taken in the order of a hash of the key.

    ``bound`` limits what the driver gets and what is broadcast; labels of a key that stands twice
    count once (the smallest).
    """
    known = labels.filter(F.col(key).isNotNull() & (use if use is not None else F.lit(True)))
    known = known.groupBy(key).agg(*[F.min(c.cast("int")).alias(f"_y_{n}") for n, c in targets.items()]).na.drop()
    chosen = known.orderBy(F.xxhash64(key), key).limit(bound)
    texts = docs.select(F.col(key), F.col(text).alias("_text"))
    return texts.join(F.broadcast(chosen), key)
