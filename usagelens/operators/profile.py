"""Profiles of jobs, cores, cards, nodes and disks over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.scalars import clamp_outlier, round_minute
from usagelens.operators.filters import filter_time_host

CELL = ["cpu_util_pct", "gpu_pct", "cpu_kb", "gpu_kb", "rss_kb"]
KB_PER_GB = 1 << 20


def profile(streams: DataFrame, job: int | None = None, limit: float | None = None) -> DataFrame:
    """One row per (job, minute, host, process) with clamped values; the last sample of a minute wins.

    With ``job=None`` all jobs are profiled at once.  ``proc_rank`` columns order processes by first time,
    command and pid.
    """
    df = streams if job is None else streams.filter(F.col("stream_job") == job)
    mem = limit * KB_PER_GB if limit else None
    values = {
        "cpu_util_pct": clamp_outlier("cpu_util_pct", limit),
        "gpu_pct": clamp_outlier("gpu_pct", limit),
        "cpu_kb": clamp_outlier("cpu_kb", mem),
        "gpu_kb": clamp_outlier("gpu_kb", mem),
        "rss_kb": clamp_outlier("rss_kb", mem),
    }
    kinds = dict(df.dtypes)
    cells = df.select(
        F.col("stream_job").alias("job"),
        round_minute("t").alias("minute"),
        "host",
        F.when(F.col("stream_id") != 0, F.col("stream_id").cast("string")).otherwise(F.col("cmd")).alias("process"),
        "t",
        "cmd",
        "stream_start",
        *[c.cast(kinds[n]).alias(n) for n, c in values.items()],
    )
    last = F.max_by(F.struct("cmd", "stream_start", *CELL), F.struct("t", F.col("stream_start"), "cmd"))
    return cells.groupBy("job", "minute", "host", "process").agg(last.alias("_v")).select(
        "job", "minute", "host", "process", "_v.*"
    )


def _chunked_minutes(prof: DataFrame, b: int) -> DataFrame:
    """For every minute present in a job: the time of its chunk of b consecutive present minutes."""
    minutes = prof.select("job", "minute").distinct()
    rank = F.row_number().over(Window.partitionBy("job").orderBy("minute"))
    ranked = minutes.withColumn("_chunk", F.floor((rank - 1) / b))
    # A chunk has at most b minutes, so its array is bounded.
    times = ranked.groupBy("job", "_chunk").agg(F.array_sort(F.collect_list("minute")).alias("_m"))
    return times.select(
        "job",
        F.element_at("_m", (F.floor(F.size("_m") / 2) + 1).cast("int")).alias("time"),
        F.explode("_m").alias("minute"),
    )


def profile_buckets(prof: DataFrame, b: int) -> DataFrame:
    """Means over every b consecutive minutes that are present, over the cells that exist."""
    n = F.count(F.lit(1))
    whole = ["cpu_kb", "gpu_kb", "rss_kb"]
    return (
        prof.join(_chunked_minutes(prof, b), ["job", "minute"])
        .groupBy("job", F.col("time").alias("minute"), "host", "process")
        .agg(
            (F.sum("cpu_util_pct") / n).alias("cpu_util_pct"),
            (F.sum("gpu_pct") / n).alias("gpu_pct"),
            *[F.expr(f"sum({c}) div count(1)").alias(c) for c in whole],
            F.max_by("cmd", "minute").alias("cmd"),
            F.min("stream_start").alias("stream_start"),
        )
    )


def profile_matrix(prof: DataFrame, field: str, processes: list[str] | None = None) -> DataFrame:
    """Time by process pivot of one quantity, for a single job.

    Columns are ``process@host`` unless processes are given.  Without a list Spark first finds the distinct
    column names and refuses more than its pivot limit.
    """
    named = prof.withColumn("_p", F.concat_ws("@", "process", "host"))
    grouped = named.groupBy("minute")
    pivoted = grouped.pivot("_p", processes) if processes else grouped.pivot("_p")
    return pivoted.agg(F.first(field)).orderBy("minute")


def profile_idle(prof: DataFrame, field: str = "cpu_util_pct", threshold: float = 5.0) -> DataFrame:
    """Per process: is it mostly idle (never at the threshold), and its average counting missing as zero."""
    times = prof.select("job", "minute").distinct().groupBy("job").agg(F.count(F.lit(1)).alias("_times"))
    per = prof.groupBy("job", "host", "process").agg(F.max(field).alias("peak"), F.sum(field).alias("_sum"))
    return per.join(times, "job").select(
        "job", "host", "process", (F.col("peak") < threshold).alias("idle"),
        (F.col("_sum") / F.col("_times")).alias("average"),
    )


def core_busyness(cpu_samples: DataFrame) -> DataFrame:
    """Per host, time and core: CPU seconds per second since the sample before, and its class.

    The previous array is found once per sample; the cores are exploded after that, so the window does not
    see a row per core.
    """
    w = Window.partitionBy("host").orderBy("t")
    pairs = (
        cpu_samples.withColumn("_prev", F.lag("per_core").over(w))
        .withColumn("_dt", F.col("t") - F.lag("t").over(w))
        .filter(F.col("_prev").isNotNull())
    )
    cores = pairs.select("host", "t", "_dt", "_prev", F.posexplode("per_core").alias("core", "_now"))
    rate = (F.col("_now") - F.get("_prev", F.col("core"))) / F.col("_dt")
    out = cores.select("host", "t", "core", rate.alias("rate"))
    # O is 25 % busy or more, o 10 %, a dot less.
    return out.withColumn("mark", F.when(F.col("rate") >= 0.25, "O").when(F.col("rate") >= 0.10, "o").otherwise("."))


def core_lines(busyness: DataFrame) -> DataFrame:
    """The classes of all cores as one text per sample; as many elements as the node has cores."""
    ordered = F.array_sort(F.collect_list(F.struct("core", "mark")))
    return busyness.groupBy("host", "t").agg(F.array_join(ordered["mark"], "").alias("line"))


def gpu_samples_rows(gpu_samples: DataFrame, index: int | None = None) -> DataFrame:
    """Per-card rows."""
    rows = gpu_samples.select("t", "host", F.explode("cards").alias("c")).select("t", "host", "c.*")
    return rows.filter(F.col("index") == index) if index is not None else rows


def node_profile(node_samples: DataFrame, from_t=None, to_t=None, hosts=None) -> DataFrame:
    return filter_time_host(node_samples, from_t, to_t, hosts).orderBy("host", "t")


def disk_profile(disk_samples: DataFrame, from_t=None, to_t=None, hosts=None) -> DataFrame:
    return filter_time_host(disk_samples, from_t, to_t, hosts).orderBy("host", "t", "name")
