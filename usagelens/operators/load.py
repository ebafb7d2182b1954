"""Load of hosts and host groups in time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.scalars import kb_to_gb
from usagelens.operators.config import CAPACITY, config_asof, drop_unconfigured
from usagelens.operators.filters import Criteria, apply_criteria, default_filters
from usagelens.operators.merge import fill_gaps, fold_means, fold_sums, fold_time, merge_across_hosts, merge_by_host, roll_up
from usagelens.operators.streams import clean_streams, host_bounds, interval_bounds

KB_PER_GB = 1 << 20


def group_capacity(starts: DataFrame, node_config: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """Capacities of a group of hosts added up; ``starts`` has (host, t), one row per host."""
    found = config_asof(starts, node_config, static).filter(F.col("cores").isNotNull())
    return found.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("host", "description"))), lambda x: x["description"]), "|||").alias("description"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in CAPACITY],
    )


def relative_load(series: DataFrame) -> DataFrame:
    """Report columns of a series that carries the capacities of its host or group."""

    def share(value: Column, cap: str) -> Column:
        # Half away from zero; the values are never negative.
        return F.when(F.col(cap) > 0, F.floor(value / F.col(cap) + 0.5)).otherwise(0).cast("bigint")

    return series.select(
        *[c for c in ("host", "unit", "t") if c in series.columns],
        F.floor("cpu_util_pct").cast("bigint").alias("cpu"),
        share(F.col("cpu_util_pct"), "cores").alias("rcpu"),
        kb_to_gb("cpu_kb").alias("mem"),
        share(F.col("cpu_kb") / KB_PER_GB * 100, "mem_gb").alias("rmem"),
        kb_to_gb("rss_kb").alias("res"),
        share(F.col("rss_kb") / KB_PER_GB * 100, "mem_gb").alias("rres"),
        F.floor("gpu_pct").cast("bigint").alias("gpu"),
        share(F.col("gpu_pct"), "gpu_cards").alias("rgpu"),
        kb_to_gb("gpu_kb").alias("gpumem"),
        share(F.col("gpu_kb") / KB_PER_GB * 100, "gpumem_gb").alias("rgpumem"),
        "gpus",
    )


def load(
    samples: DataFrame,
    node_config: DataFrame | None = None,
    static: DataFrame | None = None,
    unit: str | None = "hour",
    group: bool = False,
    fill: bool = False,
    from_t: int | None = None,
    to_t: int | None = None,
    criteria: Criteria | None = None,
    tie: list[str] | None = None,
) -> DataFrame:
    """Load per host (or for all hosts as one group) in buckets of ``unit``, or per sample with None.

    The capacity of a series is that of its first time.  With ``fill`` empty buckets of the window are
    zero rows; the window's ends default to the bounds of the samples before filtering.
    """
    criteria = default_filters("load", criteria or Criteria())
    streams = clean_streams(apply_criteria(samples, criteria), tie)
    if node_config is not None:
        streams = drop_unconfigured(streams, node_config, static)
    series = merge_by_host(streams)
    if unit:
        series = fold_time(series, unit, ["host"])
    interval = interval_bounds(host_bounds(samples), from_t, to_t) if fill and unit else None
    if group:
        merged = merge_across_hosts(series, folded=bool(unit))
        if interval is not None:
            keyed = merged.withColumn("_g", F.lit(0))
            merged = fill_gaps(keyed, unit, interval, ["_g"]).drop("_g")
        if node_config is None:
            return relative_load(_no_capacity(merged))
        # One row of fixed width.
        starts = series.groupBy("host").agg(F.min("t").alias("t"))
        capacity = group_capacity(starts, node_config, static).select(*CAPACITY)
        return relative_load(merged.join(F.broadcast(capacity)))
    if interval is not None:
        series = fill_gaps(series, unit, interval, ["host"])
    if node_config is None:
        return relative_load(_no_capacity(series))
    # The series has a row per host and bucket (or instant) here, which is all this window sees.
    started = series.withColumn("_first", F.min("t").over(Window.partitionBy("host")))
    return relative_load(config_asof(started, node_config, static, "_first"))


def load_rollups(
    samples: DataFrame,
    node_config: DataFrame | None = None,
    static: DataFrame | None = None,
    units: tuple[str, ...] = ("half-hour", "half-day"),
    criteria: Criteria | None = None,
    tie: list[str] | None = None,
) -> DataFrame:
    """:func:`load` per host in several units at once, told apart by ``unit``; all from one merge.

    The merged series is folded to half-hours that keep sums and counts, and these add up to the longer buckets.
    """
    streams = clean_streams(apply_criteria(samples, default_filters("load", criteria or Criteria())), tie)
    if node_config is not None:
        streams = drop_unconfigured(streams, node_config, static)
    finest = fold_sums(merge_by_host(streams), "half-hour", ["host"])
    series = fold_means(roll_up(finest, list(units), ["host"]))
    if node_config is None:
        return relative_load(_no_capacity(series))
    started = series.withColumn("_first", F.min("t").over(Window.partitionBy("host", "unit")))
    return relative_load(config_asof(started, node_config, static, "_first"))


def _no_capacity(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.lit(None).cast("bigint").alias(c) for c in CAPACITY])


def load_last(load_df: DataFrame) -> DataFrame:
    """The last bucket of every host: an aggregation that combines before the shuffle."""
    rest = [c for c in load_df.columns if c != "host"]
    return load_df.groupBy("host").agg(F.max_by(F.struct(*rest), "t").alias("_r")).select("host", "_r.*")
