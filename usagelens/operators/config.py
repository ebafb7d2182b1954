"""Node configuration: derivation, as-of lookup and listings.

``node_config`` has ``host, valid_from, description, cores, mem_gb, gpu_cards, gpumem_gb`` (and optional
columns), one row per host and time of report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.operators.filters import filter_time_host, where

DAY = 86400
LOOKBACK = 14 * DAY
CAPACITY = ["cores", "mem_gb", "gpu_cards", "gpumem_gb"]


def _intervals(node_config: DataFrame) -> DataFrame:
    """Each version with the span in which it is the one to use, split into days for an equi-join."""
    w = Window.partitionBy("host").orderBy("valid_from")
    latest = Window.partitionBy("host", "valid_from").orderBy(F.col("description").desc(), *CAPACITY)
    one = node_config.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")
    until = F.least(
        F.coalesce(F.lead("valid_from").over(w) - 1, F.col("valid_from") + LOOKBACK), F.col("valid_from") + LOOKBACK
    )
    spans = one.withColumn("_until", until)
    first, last = F.floor(F.col("valid_from") / DAY), F.floor(F.col("_until") / DAY)
    return spans.withColumn("_day", F.explode(F.sequence(first, last)))


def config_asof(
    left: DataFrame, node_config: DataFrame, static: DataFrame | None = None, time: str = "t", host: str = "host"
) -> DataFrame:
    """Adds the newest configuration at or before ``time``, at most 14 days old, else the static one.

    An interval spans at most 15 days, so the range condition becomes an equi-join on (host, day) plus an
    exact test.  That join carries no broadcast hint: Spark broadcasts the dimension only while it is below
    its size threshold, and its adaptive skew handling splits a hot host's rows otherwise.
    """
    fields = ["description", *CAPACITY]
    dim = _intervals(node_config).select(
        F.col("host").alias("_host"), "_day", F.col("valid_from").alias("_from"), "_until",
        *[F.col(c).alias(f"_c_{c}") for c in fields],
    )
    at = F.col(time)
    joined = left.withColumn("_left_day", F.floor(at / DAY)).join(
        dim,
        (F.col(host) == F.col("_host")) & (F.col("_left_day") == F.col("_day")) & at.between(F.col("_from"), F.col("_until")),
        "left",
    )
    if static is not None:
        fallback = static.select(F.col("host").alias("_shost"), *[F.col(c).alias(f"_s_{c}") for c in fields])
        joined = joined.join(fallback, F.col(host) == F.col("_shost"), "left")
        found = F.col("_from").isNotNull()
        values = [F.when(found, F.col(f"_c_{c}")).otherwise(F.col(f"_s_{c}")).alias(c) for c in fields]
    else:
        values = [F.col(f"_c_{c}").alias(c) for c in fields]
    keep = [c for c in left.columns if c not in fields]
    return joined.select(*keep, *values, F.col("_from").alias("config_from"))


def config_merged(
    jobs: DataFrame, node_config: DataFrame, keys: list[str], static: DataFrame | None = None, time: str = "t",
    hosts: str = "hosts",
) -> DataFrame:
    """Per job the capacities of all its hosts added up; hosts without configuration count nothing."""
    members = jobs.select(*keys, time, F.explode(hosts).alias("_member"))
    found = config_asof(members, node_config, static, time, "_member").filter(F.col("cores").isNotNull())
    return found.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in CAPACITY])


def drop_unconfigured(streams: DataFrame, node_config: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """Keep streams whose host has a configuration at the stream's first time.

    The dimension is looked up for each row: while Spark can broadcast it, the streams are not shuffled.
    An empty result is the caller's error to raise.
    """
    found = config_asof(streams, node_config, static, "stream_start").filter(F.col("cores").isNotNull())
    return found.select(*streams.columns)


def node_config(nodes: DataFrame, cards: DataFrame) -> DataFrame:
    """Configuration rows from node and card reports of the same (time, node)."""
    per_node = cards.groupBy("time", "node").agg(
        F.count(F.lit(1)).alias("gpu_cards"),
        F.sum("memory").alias("_gpu_kb"),
        F.min_by(F.struct("model", "memory"), "index").alias("_card"),
    )
    joined = nodes.join(per_node, ["time", "node"], "left")
    gb = 1 << 20
    mem_gb = F.floor(F.col("memory") / gb + 0.5).cast("bigint")
    hyper = F.when(F.col("threads_per_core") > 1, " (hyperthreaded)").otherwise("")
    desc = F.concat(
        F.col("sockets").cast("string"), F.lit("x"), F.col("cores_per_socket").cast("string"), hyper, F.lit(" "),
        F.col("cpu_model"), F.lit(", "), mem_gb.cast("string"), F.lit(" GiB"),
    )
    card_desc = F.concat(
        F.lit(", "), F.col("gpu_cards").cast("string"), F.lit("x "), F.col("_card.model"), F.lit(" @ "),
        F.floor(F.col("_card.memory") / gb).cast("string"), F.lit("GiB"),
    )
    return joined.select(
        F.col("node").alias("host"),
        F.unix_seconds(F.try_to_timestamp(F.col("time"))).alias("valid_from"),
        F.concat(desc, F.coalesce(card_desc, F.lit(""))).alias("description"),
        (F.col("sockets") * F.col("cores_per_socket") * F.col("threads_per_core")).cast("bigint").alias("cores"),
        mem_gb.alias("mem_gb"),
        F.coalesce("gpu_cards", F.lit(0)).cast("bigint").alias("gpu_cards"),
        F.floor(F.coalesce("_gpu_kb", F.lit(0)) / gb + 0.5).cast("bigint").alias("gpumem_gb"),
    )


def newest_per_host(df: DataFrame, time: str = "valid_from", host: str = "host", tie: list[str] | None = None) -> DataFrame:
    """The latest row of each host."""
    w = Window.partitionBy(host).orderBy(F.col(time).desc(), *(tie or []))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def available_hosts(nodes: DataFrame, static: DataFrame | None, from_t: int, to_t: int, time: str = "t") -> DataFrame:
    """Distinct hosts that reported in the period; the configured ones if none did."""
    seen = nodes.filter(F.col(time).between(from_t, to_t)).select("host").distinct()
    if static is None:
        return seen
    # One row, so the broadcast is of fixed size: it only tells whether anything was seen.
    none = seen.limit(1).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0")
    return seen.unionByName(static.select("host").distinct().join(F.broadcast(none)).drop("_n"))


def config_backfill(newest: DataFrame, background: DataFrame) -> DataFrame:
    """Zero or empty fields of the newest report filled from background data, plus background-only hosts."""
    b = background.select("host", *[F.col(c).alias(f"_b_{c}") for c in ["description", *CAPACITY]])
    joined = newest.join(b, "host", "full_outer")
    cols: list[Column] = [F.col("host")]
    empty = {"description": ""}
    for c in ["description", *CAPACITY]:
        zero = F.lit(empty.get(c, 0))
        own = F.coalesce(F.col(c), zero)
        cols.append(F.when(own == zero, F.coalesce(F.col(f"_b_{c}"), own)).otherwise(own).alias(c))
    filled = joined.select(*cols, newest["cores"].isNull().alias("_only_background"))
    usable = (F.col("cores") > 0) & (F.col("mem_gb") > 0)
    return filled.filter(~F.col("_only_background") | usable).drop("_only_background")


def cards_listing(cards: DataFrame, from_t=None, to_t=None, hosts=None, condition=None) -> DataFrame:
    """Card reports in order of time, node and index."""
    out = filter_time_host(cards, from_t, to_t, hosts, time="time", host="node")
    return (where(out, condition) if condition is not None else out).orderBy("time", "node", "index")


def configs_listing(configs: DataFrame, from_t=None, to_t=None, hosts=None, newest=False, condition=None) -> DataFrame:
    out = filter_time_host(configs, from_t, to_t, hosts, time="valid_from")
    out = newest_per_host(out) if newest else out
    return (where(out, condition) if condition is not None else out).orderBy("host", "valid_from")


def clusters_listing(clusters: DataFrame, condition=None) -> DataFrame:
    return (where(clusters, condition) if condition is not None else clusters).orderBy("cluster")


def partition_rows(partitions: DataFrame) -> DataFrame:
    """(time, partition, nodes) rows from nested cluster state."""
    return (
        partitions.select("time", "cluster", F.explode("partitions").alias("p"))
        .select("time", "cluster", F.col("p.name").alias("partition"), F.col("p.nodes").alias("nodes"))
        .orderBy("time", "cluster", "partition")
    )


def node_state_rows(nodes: DataFrame) -> DataFrame:
    """(time, nodes, states) rows from nested cluster state."""
    return (
        nodes.select("time", "cluster", F.explode("nodes").alias("n"))
        .select("time", "cluster", F.col("n.names").alias("nodes"), F.col("n.states").alias("states"))
        .orderBy("time", "cluster", "nodes")
    )
