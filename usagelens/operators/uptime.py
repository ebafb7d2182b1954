"""Up and down windows of hosts and their GPUs, and bounds of the data.

Samples are first reduced to one row per (host, time): partial aggregation does that before the shuffle,
and afterwards a host has as many rows as there are sample instants, however many processes it ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.hosts import match_hosts
from usagelens.operators.config import available_hosts
from usagelens.operators.filters import filter_time_host
from usagelens.operators.streams import host_bounds, merged_bounds


def host_instants(samples: DataFrame, from_t: int, to_t: int, hosts: list[str] | None = None) -> DataFrame:
    """(host, t, gpu_down) per sample instant inside the window."""
    inside = filter_time_host(samples, from_t, to_t, hosts)
    return inside.groupBy("host", "t").agg((F.max("gpu_fail") > 0).alias("gpu_down"))


def mark_windows(instants: DataFrame, interval_min: int) -> DataFrame:
    """Adds ``window_start``: a new up window opens after a gap over twice the sampling interval."""
    w = Window.partitionBy("host").orderBy("t")
    gap = F.col("t") - F.lag("t").over(w)
    opens = gap.isNull() | (gap > interval_min * 60 * 2)
    return instants.withColumn("_opens", opens).withColumn(
        "window_start", F.last(F.when(F.col("_opens"), F.col("t")), ignorenulls=True).over(w)
    ).drop("_opens")


def _lines(df: DataFrame, device: str, state: str, start: str, end: str) -> DataFrame:
    return df.select(
        "host", F.lit(device).alias("device"), F.lit(state).alias("state"),
        F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"),
    )


def host_up_windows(marked: DataFrame, from_t: int, to_t: int, interval_min: int) -> DataFrame:
    """Up windows, the gaps between them, and downtime at the ends of the period."""
    cutoff = interval_min * 60 * 2
    up = marked.groupBy("host", "window_start").agg(F.max("t").alias("window_end"))
    w = Window.partitionBy("host").orderBy("window_start")
    up = up.withColumn("_next", F.lead("window_start").over(w)).withColumn("_prev", F.lag("window_start").over(w))
    # Every up window yields itself, the gap after it and, at the host's ends, the gap to the bounds.
    after = F.coalesce(F.col("_next"), F.lit(to_t))
    has_after = F.col("_next").isNotNull() | (F.lit(to_t) - F.col("window_end") > cutoff)
    has_before = F.col("_prev").isNull() & (F.col("window_start") - F.lit(from_t) > cutoff)

    def line(state: str, start, end):
        return F.struct(F.lit(state).alias("state"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))

    lines = F.array(
        line("up", F.col("window_start"), F.col("window_end")),
        F.when(has_after, line("down", F.col("window_end"), after)),
        F.when(has_before, line("down", F.lit(from_t), F.col("window_start"))),
    )
    return (
        up.select("host", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("_l"))
        .select("host", F.lit("host").alias("device"), "_l.*")
    )


def host_always_down(hosts: DataFrame, samples: DataFrame, from_t: int, to_t: int) -> DataFrame:
    """Known hosts without any sample."""
    silent = hosts.select("host").distinct().join(samples.select("host").distinct(), "host", "left_anti")
    return silent.select(
        "host", F.lit("host").alias("device"), F.lit("down").alias("state"),
        F.lit(from_t).cast("bigint").alias("start"), F.lit(to_t).cast("bigint").alias("end"),
    )


def gpu_windows(marked: DataFrame) -> DataFrame:
    """Inside each up window, runs of equal GPU state; a run ends where the next one begins."""
    w = Window.partitionBy("host").orderBy("t")
    changed = (
        F.lag("gpu_down").over(w).isNull()
        | (F.lag("window_start").over(w) != F.col("window_start"))
        | (F.lag("gpu_down").over(w) != F.col("gpu_down"))
    )
    runs = marked.withColumn("_new", changed).withColumn(
        "_run", F.last(F.when(F.col("_new"), F.col("t")), ignorenulls=True).over(w)
    )
    ends = runs.groupBy("host", "window_start", "_run").agg(
        F.max("t").alias("_last"), F.first("gpu_down").alias("gpu_down")
    )
    in_window = Window.partitionBy("host", "window_start").orderBy("_run")
    ends = ends.withColumn("_end", F.coalesce(F.lead("_run").over(in_window), F.col("_last")))
    return ends.select(
        "host", F.lit("gpu").alias("device"),
        F.when(F.col("gpu_down"), "down").otherwise("up").alias("state"),
        F.col("_run").alias("start"), F.col("_end").alias("end"),
    )


def uptime(
    samples: DataFrame,
    from_t: int,
    to_t: int,
    interval_min: int,
    nodes: DataFrame | None = None,
    static: DataFrame | None = None,
    hosts: list[str] | None = None,
    only_up: bool = False,
    only_down: bool = False,
    sort: bool = True,
) -> DataFrame:
    """All windows by host, start, host before GPU.

    ``nodes`` (``host``, ``t``) are node reports that tell which hosts exist; ``static`` the configured
    hosts if none reported in the period.
    """
    marked = mark_windows(host_instants(samples, from_t, to_t, hosts), interval_min)
    out = host_up_windows(marked, from_t, to_t, interval_min).unionByName(gpu_windows(marked))
    if nodes is not None or static is not None:
        if nodes is not None:
            known = available_hosts(nodes, static, from_t, to_t)
        else:
            known = static.select("host")
        known = match_hosts(known, hosts or [], prefix=True)
        out = out.unionByName(host_always_down(known, samples, from_t, to_t))
    if only_up or only_down:
        out = out.filter(F.col("state") == ("up" if only_up else "down"))
    if not sort:
        return out
    return out.orderBy("host", "start", F.when(F.col("device") == "host", 0).otherwise(1), "end", "state")


def last_seen(samples: DataFrame) -> DataFrame:
    """Latest sample time of every host."""
    return samples.groupBy("host").agg(F.max("t").alias("last_seen"))


def metadata_bounds(samples: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Earliest and latest time per host, or with ``jobs`` (having ``hosts``) per merged host set."""
    bounds = host_bounds(samples)
    if jobs is None:
        return bounds.orderBy("host")
    sets = jobs.select("hosts", F.array_join("hosts", ",").alias("host_set")).distinct()
    return merged_bounds(bounds, sets, ["host_set"]).orderBy("host_set")
