"""Connected components of a graph given as a table of links, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.store import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): each id that stands in a link, and the smallest id it can reach.

    Rounds of large-star and small-star contraction (links to the smallest neighbour) until no link
    changes.  A round is two sums by key with a map-side combine and two joins; each round is
    written, so a lost executor costs no more than a round.  Links with a null end and loops are no
    links; repeated links count once.  Without links the result is empty.
    """
    e = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter((F.col("u") != F.col("v")) & F.col(a).isNotNull() & F.col(b).isNotNull()).distinct(),
        "links",
    )
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v")).groupBy("id").agg(F.min("component").alias("component"))
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        e = written(small.select("e.*").filter("u <> v").distinct(), "links")
