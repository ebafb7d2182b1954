"""The at-a-glance report per host, and load series with downtime."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.scalars import BUCKET_SECONDS, format_time
from usagelens.operators.config import available_hosts

# Fixed values: "recent" and "longer" look-back in seconds.
RECENT = 30 * 60
LONGER = 12 * 3600
RELATIVE = {"rcpu": "cpu", "rmem": "mem", "rres": "resident", "rgpu": "gpu", "rgpumem": "gpumem"}


def users_jobs_by_host(jobs: DataFrame, now: int) -> DataFrame:
    """Jobs and distinct users per host, recently and over the longer time.

    First one row per (host, user), then per host: no set of users is built in a single aggregation buffer.
    """
    recent = F.col("live_at_end") | (F.col("last") > now - RECENT)
    longer = recent | (F.col("last") > now - LONGER)
    per_user = (
        jobs.select(F.explode("hosts").alias("host"), "user", recent.alias("_r"), longer.alias("_l"))
        .groupBy("host", "user")
        .agg(F.count_if("_r").alias("_r"), F.count_if("_l").alias("_l"))
    )
    return per_user.groupBy("host").agg(
        F.sum("_r").alias("jobs_recent"),
        F.sum("_l").alias("jobs_longer"),
        F.count_if(F.col("_r") > 0).alias("users_recent"),
        F.count_if(F.col("_l") > 0).alias("users_longer"),
    )


def status_by_host(uptime: DataFrame) -> DataFrame:
    """From the last uptime line of a host: is it down, is its GPU (or the host) down."""
    order = F.struct("start", F.when(F.col("device") == "host", 0).otherwise(1), "end", "state")
    last = uptime.groupBy("host").agg(F.max_by(F.struct("device", "state"), order).alias("_l"))
    down = F.col("_l.state") == "down"
    return last.select(
        "host",
        (down & (F.col("_l.device") == "host")).cast("bigint").alias("cpu_status"),
        down.cast("bigint").alias("gpu_status"),
    )


def load_averages(rollups: DataFrame) -> DataFrame:
    """Relative load of the last half-hour and the last half-day of every host, from load in both units.

    ``rollups`` is :func:`usagelens.operators.load.load_rollups`; a last bucket is a maximum that combines before the shuffle.
    """
    values = F.struct(*[F.col(c).alias(n) for c, n in RELATIVE.items()])
    spans = (("recent", "half-hour"), ("longer", "half-day"))
    last = rollups.groupBy("host").agg(*[F.max_by(values, F.when(F.col("unit") == u, F.col("t"))).alias(f"_{s}") for s, u in spans])
    return last.select("host", *[F.coalesce(F.col(f"_{s}")[n], F.lit(0)).alias(f"{n}_{s}") for n in RELATIVE.values() for s, _ in spans])


def at_a_glance(
    users_jobs: DataFrame, status: DataFrame, averages: DataFrame, hogs: DataFrame, deadweights: DataFrame,
    config: DataFrame, current: DataFrame,
) -> DataFrame:
    """One row per host that any part knows.

    ``config`` has ``host, gpu_cards, description``; ``current`` the hosts that reported lately, only these
    get a status and a description.  GPU load is shown for hosts with cards.  All parts have one row per
    host, so the joins are small and keep one partitioning.
    """
    parts = [
        users_jobs,
        status.join(current.select("host"), "host", "left_semi"),
        averages,
        hogs.withColumnRenamed("violations", "violators"),
        deadweights.withColumnRenamed("violations", "deadweights"),
    ]
    joined = reduce(lambda a, b: a.join(b, "host", "full_outer"), parts)
    known = config.join(current.select("host"), "host", "left_semi").select("host", "gpu_cards", "description")
    joined = joined.join(known, "host", "left")
    has_cards = F.coalesce(F.col("gpu_cards") > 0, F.lit(False))
    cols = []
    for c in joined.columns:
        if c in ("host", "gpu_cards", "description"):
            continue
        value = F.coalesce(c, F.lit(0)).cast("bigint")
        if c.startswith("gpu_") and c != "gpu_status" or c.startswith("gpumem_"):
            value = F.when(has_cards, value).otherwise(0).cast("bigint")
        cols.append(value.alias(c))
    return joined.select("host", F.coalesce("description", F.lit("")).alias("description"), *cols).orderBy("host")


def load_with_downtime(load: DataFrame, uptime: DataFrame, unit: str) -> DataFrame:
    """Adds 0/1 columns for host and GPU downtime that overlaps a bucket.

    A down window marks the bucket it starts in and every bucket that starts before its end.  The window is
    exploded into the buckets it covers, so the range join becomes an equi-join on (host, bucket).
    """
    width = BUCKET_SECONDS[unit]
    down = uptime.filter(F.col("state") == "down")
    anchor = F.pmod(F.lit(4 * 86400 if unit == "week" else 0), F.lit(width))

    def bucket(c):
        return c - F.pmod(c - anchor, F.lit(width))

    first = bucket(F.col("start"))
    last = F.greatest(first, bucket(F.col("end") - 1))
    covered = down.select(
        "host", "device", F.explode(F.sequence(first, last, F.lit(width).cast("bigint"))).alias("t")
    )
    marks = covered.groupBy("host", "t").agg(
        F.max((F.col("device") == "host").cast("bigint")).alias("down_host"),
        F.max((F.col("device") == "gpu").cast("bigint")).alias("down_gpu"),
    )
    joined = load.join(marks, ["host", "t"], "left")
    return joined.withColumn("down_host", F.coalesce("down_host", F.lit(0)).cast("bigint")).withColumn(
        "down_gpu", F.coalesce("down_gpu", F.lit(0)).cast("bigint")
    )


def load_arrays(load: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """One row per host with parallel arrays in time order: a report of a bounded number of buckets.

    GPU arrays are NULL for hosts without cards or with a value that is not a number.
    """
    fields = ["rcpu", "rmem", "rres", "rgpu", "rgpumem"]
    fields += [c for c in ("down_host", "down_gpu") if c in load.columns]
    rows = F.array_sort(F.collect_list(F.struct("t", format_time("t").alias("label"), *fields)))
    bad = F.max(F.isnan(F.col("rgpu").cast("double")) | F.isnan(F.col("rgpumem").cast("double")))
    out = load.groupBy("host").agg(rows.alias("_r"), bad.alias("_bad"))
    usable = ~F.col("_bad")
    if config is not None:
        out = out.join(config.select("host", "gpu_cards"), "host", "left")
        usable = usable & (F.coalesce("gpu_cards", F.lit(0)) > 0)
    cols = [F.col("_r")[c].alias(c) for c in fields if c not in ("rgpu", "rgpumem", "down_gpu")]
    gpu = [F.when(usable, F.col("_r")[c]).alias(c) for c in fields if c in ("rgpu", "rgpumem", "down_gpu")]
    return out.select("host", F.col("_r")["label"].alias("labels"), *cols, *gpu)


def host_names(nodes: DataFrame, now: int) -> DataFrame:
    """Sorted distinct hosts of the last 14 days."""
    return available_hosts(nodes, None, now - 14 * 86400, now).orderBy("host")
