"""Reconstruction of process streams from samples.

A stream is (host, stream_id, cmd).  De-duplication runs first with the time in its key: Spark then
keeps one row per key before the shuffle, so a mass of copies never reaches one task.  After it a
stream has one row per instant, which bounds every later window by the number of instants and not by
the number of rows that came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.scalars import parse_version

# Fixed value: marks stream IDs made from a job number.
ROLLED_UP_BASE = 10_000_000
STREAM = ["host", "stream_id", "cmd"]


def stream_key(samples: DataFrame) -> DataFrame:
    """Adds ``stream_id``: the pid, or a tagged job number for rolled-up rows without a pid."""
    tagged = F.lit(ROLLED_UP_BASE) + F.col("job")
    rolled = (F.col("rolledup") > 0) & (F.col("pid") == 0)
    return samples.withColumn("stream_id", F.when(rolled, tagged).otherwise(F.col("pid")).cast("bigint"))


def dealt_out(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by key, in no more partitions than Spark fills side by side.

    Up to ``spark.shuffle.sort.bypassMergeThreshold`` partitions a task writes each row to its partition as it comes; for more it
    collects its rows in memory first, and a scan may be one task however large its file is.
    """
    conf = rows.sparkSession.conf
    most = int(conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    wanted = max(int(conf.get(c, None) or 0) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    return rows.repartition(*keys) if wanted <= most else rows.repartition(most, *keys)


def dedup_streams(samples: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """One row per (stream, time).  ``tie`` orders rows of equal time; by default all other columns do.

    Rows are dealt out by stream before they are sorted, as a scan may be one task however large its file is.  The windows
    of :func:`cpu_util` find them dealt that way already.
    """
    df = samples if "stream_id" in samples.columns else stream_key(samples)
    key = [*STREAM, "t"]
    order = tie or [c for c in df.columns if c not in key]
    w = Window.partitionBy(*key).orderBy(*order)
    return dealt_out(df, *STREAM).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def cpu_util(streams: DataFrame) -> DataFrame:
    """Adds ``cpu_util_pct`` and drops rows where the CPU time went backwards.

    The first row of a stream has ``cpu_pct``; later rows the CPU time used since the row before, dropped
    or not.  Streams that start with version 0.6 or older have no CPU time and always use ``cpu_pct``.

    Also adds what merging needs, all in the same window: the stream's first job, user, epoch and time,
    the time of the previous kept row, and whether a row is the stream's first or last.
    """
    w = Window.partitionBy(*STREAM).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def first(c: str) -> Column:
        return F.first(c).over(upto)

    df = streams.withColumns(
        {
            "_raw_t": F.lag("t").over(w),
            "_raw_cpu": F.lag("cputime_sec").over(w),
            "_v": first("version"),
            "stream_job": first("job"),
            "stream_user": first("user"),
            "stream_epoch": first("epoch"),
            "stream_start": first("t"),
        }
    )
    v = parse_version("_v")
    old = (v["major"] == 0) & (v["minor"] <= 6)
    is_first = F.col("_raw_t").isNull()
    rate = (F.col("cputime_sec") - F.col("_raw_cpu")) / (F.col("t") - F.col("_raw_t")) * 100
    df = df.withColumn("cpu_util_pct", F.when(is_first | old, F.col("cpu_pct")).otherwise(rate))
    df = df.filter(is_first | old | (F.col("cpu_util_pct") >= 0))
    previous = F.lag("t").over(w)
    marks = {"prev_t": previous, "is_first": previous.isNull(), "is_last": F.lead("t").over(w).isNull()}
    return df.withColumns(marks).drop("_raw_t", "_raw_cpu", "_v")


def clean_streams(samples: DataFrame, tie: list[str] | None = None, deduplicated: bool = False) -> DataFrame:
    """Keys, de-duplication and CPU utilization: the input of all merges.

    ``deduplicated`` tells that the table holds one row per (stream, time) already, as after
    ``stream_dedup``; that spares a shuffle.
    """
    keyed = stream_key(samples)
    return cpu_util(keyed if deduplicated else dedup_streams(keyed, tie))


def host_bounds(samples: DataFrame) -> DataFrame:
    """Earliest and latest time of every host.  Give it the samples before any filter."""
    return samples.groupBy("host").agg(F.min("t").alias("earliest"), F.max("t").alias("latest"))


def merged_bounds(bounds: DataFrame, jobs: DataFrame, keys: list[str], hosts: str = "hosts") -> DataFrame:
    """For every merged job the bounds over all its hosts."""
    members = jobs.select(*keys, F.explode(hosts).alias("_member"))
    ends = bounds.select(F.col("host").alias("_member"), "earliest", "latest")
    return (
        members.join(ends, "_member")
        .groupBy(*keys)
        .agg(F.min("earliest").alias("earliest"), F.max("latest").alias("latest"))
    )


def interval_bounds(bounds: DataFrame, from_t: int | None = None, to_t: int | None = None) -> DataFrame:
    """One row: the given window ends, or the extremes over all hosts."""
    return bounds.agg(
        F.coalesce(F.lit(from_t).cast("bigint"), F.min("earliest")).alias("from_t"),
        F.coalesce(F.lit(to_t).cast("bigint"), F.max("latest")).alias("to_t"),
    )


def clean_cpu_samples(cpu_samples: DataFrame) -> DataFrame:
    """One per-core row per (host, time)."""
    w = Window.partitionBy("host", "t").orderBy("per_core")
    return cpu_samples.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def last_n(streams: DataFrame, n: int) -> DataFrame:
    """The last n samples of every stream; Spark limits each key before the shuffle."""
    w = Window.partitionBy(*STREAM).orderBy(F.col("t").desc())
    return streams.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def export_samples(samples: DataFrame, mode: str = "raw", tie: list[str] | None = None) -> DataFrame:
    """Raw filtered rows, ``clean`` streams, or rows merged by host and job (``merged``), in a fixed order."""
    if mode == "raw":
        return samples.orderBy("host", "t", "job", "cmd", "pid")
    clean = clean_streams(samples, tie)
    if mode == "clean":
        return clean.orderBy("host", "stream_start", "stream_job", "cmd", "stream_id", "t")
    from usagelens.operators.merge import merge_by_host_job

    merged = merge_by_host_job(clean)
    start = F.min("t").over(Window.partitionBy("host", "job", "solo"))
    return merged.withColumn("_start", start).orderBy("host", "_start", "job", "cmd", "t").drop("_start")
