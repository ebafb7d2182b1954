"""Fixed-resolution time series, anchored at each series' first sample, and states at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.gpus import gpu_set_indices
from usagelens.operators.merge import merge_by_host
from usagelens.operators.profile import gpu_samples_rows
from usagelens.operators.streams import STREAM
from usagelens.schemas import DISK_COUNTERS

DAY = 86400
DEFAULT_WIDTH = 300
DEFAULT_WINDOW = 3600
MAX_WINDOW = 14 * DAY


def one_place(c: Column | str) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) * 10 + 0.5) / 10


def anchored_series(
    df: DataFrame, keys: list[str], width: int, means: list[str], whole: list[str], anchor: Column | None = None
) -> DataFrame:
    """Bucket means per series; empty buckets between the first and last sample are zero rows.

    Two aggregations that combine before the shuffle: the anchor of every series, then its buckets.  The
    anchors join back without a hint, so a long list of series is shuffled and a short one broadcast.
    ``anchor`` is the first time where the rows can tell it, which spares that.
    """
    if anchor is not None:
        timed = df.withColumn("_t0", anchor)
    else:
        timed = df.join(df.groupBy(*keys).agg(F.min("t").alias("_t0")), keys)
    placed = timed.withColumn("_b", F.floor((F.col("t") - F.col("_t0")) / width))
    n = F.count(F.lit(1))
    filled = placed.groupBy(*keys, "_t0", "_b").agg(
        *[(F.sum(c) / n).alias(c) for c in means], *[F.expr(f"sum({c}) div count(1)").alias(c) for c in whole]
    )
    # The gap after a bucket is filled by the bucket itself: no join with a grid of all times.
    nxt = F.lead("_b").over(Window.partitionBy(*keys).orderBy("_b"))
    filled = filled.withColumn("_upto", F.coalesce(nxt - 1, F.col("_b")))
    spread = filled.withColumn("_e", F.explode(F.sequence("_b", "_upto")))
    own = F.col("_e") == F.col("_b")
    return spread.select(
        *keys,
        (F.col("_t0") + F.col("_e") * width).alias("t"),
        *[F.when(own, F.col(c)).otherwise(0.0).alias(c) for c in means],
        *[F.when(own, F.col(c)).otherwise(F.lit(0)).cast("bigint").alias(c) for c in whole],
    )


def node_cpu_mem_series(
    streams: DataFrame, sysinfo: DataFrame, width: int = DEFAULT_WIDTH, compat: bool = False
) -> DataFrame:
    """Per host: CPU use as % of the node's cores and resident memory as % of its memory.

    ``sysinfo`` has one row per host: ``host, cores, memory_kb``.  ``compat`` gives the older formula,
    which divides the summed percentage by the number of process streams and multiplies by 100 again.
    """
    merged = merge_by_host(streams)
    # Merged steps are one row per instant, so a window can give their start.
    start = F.min("t").over(Window.partitionBy("host"))
    series = anchored_series(merged, ["host"], width, ["cpu_util_pct"], ["rss_kb"], start)
    series = series.join(sysinfo.select("host", "cores", "memory_kb"), "host")
    cpu = F.col("cpu_util_pct")
    if compat:
        tasks = streams.filter("is_first").groupBy("host").agg(F.count(F.lit(1)).alias("_tasks"))
        series = series.join(tasks, "host")
        cpu = cpu / F.col("_tasks") * 100
    return series.select(
        "host",
        "t",
        one_place(F.when(F.col("cores") > 0, cpu / F.col("cores")).otherwise(0.0)).alias("cpu_util"),
        one_place(F.when(F.col("memory_kb") > 0, F.col("rss_kb") / F.col("memory_kb") * 100).otherwise(0.0)).alias("mem_util"),
    )


def gpu_series(gpu_samples: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Per (host, uuid, index): mean compute and memory utilization."""
    rows = gpu_samples_rows(gpu_samples)
    series = anchored_series(rows, ["host", "uuid", "index"], width, ["ce_util", "memory_util"], [])
    return series.select("host", "uuid", "index", "t", one_place("ce_util").alias("ce_util"), one_place("memory_util").alias("memory_util"))


def disk_series(disk_samples: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Per (host, disk): whole-number means of the counters."""
    return anchored_series(disk_samples, ["host", "name"], width, [], DISK_COUNTERS)


def process_series(streams: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Per process stream: mean CPU %, GPU %, GPU memory % and KB.  The anchor is in the stream already."""
    series = anchored_series(
        streams, STREAM, width, ["cpu_pct", "gpu_pct", "gpumem_pct"], ["cpu_kb"],
        F.col("stream_start"),
    )
    return series.select(*STREAM, "t", *[one_place(c).alias(c) for c in ("cpu_pct", "gpu_pct", "gpumem_pct")], "cpu_kb")


def node_gpu_at(streams: DataFrame, t: int) -> DataFrame:
    """Per host with GPU use: means over the merged steps that used a GPU, and the sorted pids.

    ``streams`` are the clean streams of the samples within half a window of ``t``.
    """
    used = (F.col("gpu_pct") > 0) | (F.col("gpumem_pct") > 0) | (F.col("gpu_kb") > 0)
    steps = merge_by_host(streams).filter(used).groupBy("host").agg(
        one_place(F.avg("gpu_pct")).alias("gpu_util"),
        one_place(F.avg("gpumem_pct")).alias("gpumem_util"),
        F.expr("sum(gpu_kb) div count(1)").alias("gpu_kb"),
    )
    pids = streams.filter(F.col("is_first") & (F.col("pid") != 0)).groupBy("host").agg(
        F.array_sort(F.collect_list("pid")).alias("pids")
    )
    return steps.join(pids, "host", "left").withColumn("t", F.lit(t).cast("bigint"))


def cards_at(cards: DataFrame, t: int) -> DataFrame:
    """Latest report of every card (by uuid) in the day before t; ``cards`` has ``t`` in seconds."""
    recent = cards.filter(F.col("t").between(t - DAY, t))
    rest = [c for c in recent.columns if c != "uuid"]
    return recent.groupBy("uuid").agg(F.max_by(F.struct(*rest), F.struct("t", "node", "index")).alias("_c")).select("uuid", "_c.*")


def _stream_cards(last: DataFrame, cards: DataFrame, t: int) -> DataFrame:
    """One row per process and card it used."""
    known = cards_at(cards, t)
    by_index = known.groupBy("node", "index").agg(
        F.min_by(F.struct("uuid", "model"), "uuid").alias("_c")
    ).select(F.col("node").alias("_node"), F.col("index").alias("_index"), F.col("_c.uuid").alias("uuid"), F.col("_c.model").alias("model"))
    used = last.select(*STREAM, F.explode(gpu_set_indices("gpus")).alias("_ix"))
    return used.join(by_index, (F.col("host") == F.col("_node")) & (F.col("_ix") == F.col("_index"))).drop("_node", "_index")


def processes_at(streams: DataFrame, cards: DataFrame, t: int) -> DataFrame:
    """Last sample of every stream of the window, with the uuids of its cards (at most 31) in index order."""
    last = streams.filter("is_last")
    uuids = _stream_cards(last, cards, t).groupBy(*STREAM).agg(
        F.array_sort(F.collect_list(F.struct("_ix", "uuid")))["uuid"].alias("uuids")
    )
    return last.join(uuids, STREAM, "left").select(
        *STREAM, "t", "pid", "user", one_place("cpu_sampled_pct").alias("cpu_pct"),
        F.col("cpu_kb").alias("mem_kb"), one_place("gpu_pct").alias("gpu_pct"), one_place("gpumem_pct").alias("gpumem_pct"),
        F.coalesce("uuids", F.array().cast("array<string>")).alias("uuids"),
    )


def process_gpus_at(streams: DataFrame, gpu_samples: DataFrame, cards: DataFrame, t: int) -> DataFrame:
    """For every process and card it used: the first reading of that card in the window."""
    readings = gpu_samples_rows(gpu_samples).groupBy("host", "uuid").agg(
        F.min_by(F.struct("t", "index", "ce_util", "memory_util"), F.struct("t", "index")).alias("_r")
    ).select("host", "uuid", F.col("_r.t").alias("t"), F.col("_r.index").alias("gpu_index"), F.col("_r.ce_util").alias("gpu_pct"), F.col("_r.memory_util").alias("gpumem_pct"))
    used = _stream_cards(streams.filter("is_last"), cards, t)
    return used.join(readings, ["host", "uuid"]).select(*STREAM, "uuid", "model", "t", "gpu_index", "gpu_pct", "gpumem_pct")


def node_info_at(sysinfo: DataFrame, cards: DataFrame, t: int) -> DataFrame:
    """Latest report of every node in the day before t, with the model and memory of its cards."""
    recent = sysinfo.filter(F.col("t").between(t - DAY, t))
    rest = [c for c in recent.columns if c != "node"]
    newest = recent.groupBy("node").agg(F.max_by(F.struct(*rest), "t").alias("_n")).select("node", "_n.*")
    info = cards_at(cards, t).select(F.col("uuid").alias("_uuid"), "model", "memory")
    exploded = newest.select("node", F.posexplode("cards").alias("_pos", "_card"))
    detailed = exploded.join(info, F.col("_card") == F.col("_uuid"), "left")
    per_node = detailed.groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("_pos", F.col("_card").alias("uuid"), "model", "memory"))).alias("card_info")
    )
    return newest.join(per_node, "node", "left")


def cluster_overview(clusters: DataFrame, partitions: DataFrame, sysinfo: DataFrame, t: int) -> DataFrame:
    """Per cluster: partitions and nodes seen in the day before t, and whether it has a batch system."""
    inside = F.col("t").between(t - DAY, t)
    parts = partitions.filter(inside).select("cluster", F.explode("partitions.name").alias("_p")).groupBy("cluster").agg(
        F.array_sort(F.collect_set("_p")).alias("partitions")
    )
    nodes = sysinfo.filter(inside).groupBy("cluster").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    empty = F.array().cast("array<string>")
    return (
        clusters.select("cluster").join(parts, "cluster", "left").join(nodes, "cluster", "left")
        .select(
            "cluster", F.lit(t).cast("bigint").alias("t"),
            F.when(F.size("partitions") > 0, 1).otherwise(0).alias("slurm"),
            F.coalesce("partitions", empty).alias("partitions"), F.coalesce("nodes", empty).alias("nodes"),
        )
    )


def clamp_window(extent: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Window from the data's extent (``min_t``, ``max_t``): an hour by default, at most 14 days, inside the data."""
    lo, hi = F.col("min_t"), F.col("max_t")
    to = F.lit(end) if end else (F.lit(start + DEFAULT_WINDOW) if start else hi)
    frm = F.lit(start) if start else (F.lit(end - DEFAULT_WINDOW) if end else hi - DEFAULT_WINDOW)
    return extent.select(
        F.greatest(F.greatest(frm, to - MAX_WINDOW), lo).cast("bigint").alias("from_t"),
        F.least(to, hi).cast("bigint").alias("to_t"),
    )
