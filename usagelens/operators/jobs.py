"""Job summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.gpus import gpu_set_size, gpu_set_union, is_unknown
from usagelens.functions.scalars import job_mark, kb_to_gb, round_half_up
from usagelens.operators.config import CAPACITY, config_asof, drop_unconfigured
from usagelens.operators.filters import (
    Criteria,
    apply_criteria,
    default_filters,
    filter_job_aggregates,
    filter_job_flags,
    sacct_condition,
)
from usagelens.operators.merge import JOB_KEY, across_hosts, job_names, merge_by_epoch, merge_by_host_job, merge_by_job, with_job_names
from usagelens.operators.streams import clean_streams, host_bounds

KB_PER_GB = 1 << 20


def job_aggregate(merged: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Averages and peaks over a job's merged steps, sums of counters, first and last time: one aggregation.

    CPU time and I/O are cumulative in the samples and are summed over the steps; the usage reports build
    on that.  With ``names`` (of :func:`job_names`) steps need none: a job's names meet its one row here.  Without, the steps'
    own are taken; Spark sorts the steps for that, each with all names of its job.
    """
    kb = 1.0 / KB_PER_GB

    def both(name: str, c: Column) -> list[Column]:
        return [F.avg(c).alias(f"{name}_avg"), F.max(c).alias(f"{name}_peak")]

    aggs = [
        *both("cpu", F.col("cpu_util_pct")),
        *both("mem", F.col("cpu_kb") * kb),
        *both("res", F.col("rss_kb") * kb),
        *both("gpu", F.col("gpu_pct")),
        *both("gpumem", F.col("gpu_kb") * kb),
        *both("threads", F.col("threads")),
        F.sum("cputime_sec").alias("cputime_sec"),
        F.sum("data_read_kb").alias("read_kb"),
        F.sum("data_written_kb").alias("written_kb"),
        F.max("cpu_kb").alias("vm_kb_peak"),
        F.max("rss_kb").alias("rss_kb_peak"),
        gpu_set_union("gpus").alias("gpus"),
        F.max("gpu_fail").alias("gpu_fail"),
        F.max("in_container").alias("in_container"),
        F.count(F.lit(1)).alias("n_samples"),
        F.min("t").alias("first"),
        F.max("t").alias("last"),
    ]
    if names is None:
        out = merged.groupBy(*JOB_KEY).agg(*aggs, *[F.first(c).alias(c) for c in ("user", "cmd", "hosts")])
    else:
        out = merged.groupBy(*JOB_KEY).agg(*aggs)
        out = with_job_names(out, names).select(*out.columns, "user", "cmd", "hosts")
    return out.withColumn("read_gb", kb_to_gb("read_kb")).withColumn("written_gb", kb_to_gb("written_kb"))


def job_times(jobs: DataFrame) -> DataFrame:
    """Adds ``duration`` and ``gputime_sec`` = average GPU % of the duration."""
    duration = F.col("last") - F.col("first")
    return jobs.withColumn("duration", duration).withColumn(
        "gputime_sec", round_half_up(F.col("gpu_avg") * duration / 100)
    )


def job_liveness(jobs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds whether the job was live at the bounds of its hosts, the mark and the classification bits."""
    ends = bounds.select(F.col("host").alias("_member"), "earliest", "latest")
    joined = _per_member(
        jobs, lambda members: members.join(ends, "_member", "left"),
        {"_earliest": F.min("earliest"), "_latest": F.max("latest")},
    )
    start, end = F.col("first") == F.col("_earliest"), F.col("last") == F.col("_latest")
    return joined.select(
        *jobs.columns,
        start.alias("live_at_start"),
        end.alias("live_at_end"),
        F.concat(F.col("job").cast("string"), job_mark(start, end)).alias("jobm"),
        # 2 live at start, 1 live at end.
        (start.cast("int") * 2 + end.cast("int")).alias("classification"),
    )


def _per_member(jobs: DataFrame, attach: Callable[[DataFrame], DataFrame], aggs: dict[str, Column]) -> DataFrame:
    """Look something up for every host of a job and aggregate it per job, the job's own columns kept.

    The row travels with the first of its hosts, the others carry the key and the time only: a summary is computed
    once, and a job of many hosts does not multiply its names.
    """
    rest = [c for c in jobs.columns if c not in JOB_KEY]
    members = jobs.select(*JOB_KEY, F.struct(*rest).alias("_row"), "first", F.posexplode("hosts").alias("_pos", "_member"))
    members = members.withColumn("_row", F.when(F.col("_pos") == 0, F.col("_row"))).drop("_pos")
    row = F.first("_row", ignorenulls=True).alias("_row")
    summed = attach(members).groupBy(*JOB_KEY).agg(row, *[c.alias(n) for n, c in aggs.items()])
    return summed.select(*[c if c in JOB_KEY else F.col(f"_row.{c}").alias(c) for c in jobs.columns], *aggs)


def job_zombie(jobs: DataFrame) -> DataFrame:
    """Adds ``zombie``: the command tells of a defunct process."""
    return jobs.withColumn("zombie", F.col("cmd").contains("<defunct>") | F.col("cmd").startswith("_zombie_"))


def job_commands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct commands of a job in the order they were first seen."""
    first = rows.groupBy(*keys, "cmd").agg(F.min("t").alias("_first"))
    ordered = F.array_sort(F.collect_list(F.struct("_first", "cmd")))
    return first.groupBy(*keys).agg(F.array_join(ordered["cmd"], ", ").alias("commands"))


def job_relative(jobs: DataFrame, node_config: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """Adds usage as % of the capacity of the job's hosts, and of the cards it occupied (``s`` columns).

    The configuration is that of the job's first time.  Without one, or where a capacity is zero, the
    values are zero.
    """
    df = _per_member(
        jobs, lambda members: config_asof(members, node_config, static, "first", "_member"),
        {c: F.sum(c).cast("bigint") for c in CAPACITY},
    )

    def share(value: str, cap: str, factor: float) -> Column:
        return F.when(F.col(cap) > 0, F.col(value) * factor / F.col(cap)).otherwise(0.0)

    used = (F.col("gpus") != 0) & ~is_unknown("gpus") & F.col("cores").isNotNull()
    cards = gpu_set_size("gpus")
    mem = cards * F.col("gpumem_gb") / F.col("gpu_cards")
    sized = used & (F.col("gpu_cards") > 0) & (F.col("gpumem_gb") > 0)
    added = {}
    for kind in ("avg", "peak"):
        added[f"rcpu_{kind}"] = share(f"cpu_{kind}", "cores", 1.0)
        added[f"rmem_{kind}"] = share(f"mem_{kind}", "mem_gb", 100.0)
        added[f"rres_{kind}"] = share(f"res_{kind}", "mem_gb", 100.0)
        added[f"rgpu_{kind}"] = share(f"gpu_{kind}", "gpu_cards", 1.0)
        added[f"rgpumem_{kind}"] = share(f"gpumem_{kind}", "gpumem_gb", 100.0)
        added[f"sgpu_{kind}"] = F.when(used, F.col(f"gpu_{kind}") / cards).otherwise(0.0)
        added[f"sgpumem_{kind}"] = F.when(sized, F.col(f"gpumem_{kind}") * 100 / mem).otherwise(0.0)
    return df.withColumns(added).drop(*CAPACITY)


def merge_jobs(streams: DataFrame, merge: str, names: bool = True) -> DataFrame:
    """``merge`` is ``epoch`` (default of the reports), ``all`` hosts or ``none``."""
    return {"epoch": merge_by_epoch, "all": merge_by_job, "none": merge_by_host_job}[merge](streams, names)


def jobs(
    samples: DataFrame,
    node_config: DataFrame | None = None,
    static: DataFrame | None = None,
    sacct_jobs: DataFrame | None = None,
    criteria: Criteria | None = None,
    merge: str = "epoch",
    limits: dict | None = None,
    flags: dict | None = None,
    accounting: dict | None = None,
    tie: list[str] | None = None,
    sort: bool = True,
) -> DataFrame:
    """Job summaries from samples, by start time and job.

    Bounds come from all samples given, before the record filter.  With ``node_config`` streams of hosts
    without configuration are left out and relative columns are added.  With ``accounting`` filters, jobs
    that have a record failing them go.
    """
    criteria = default_filters("jobs", criteria or Criteria())
    streams = clean_streams(apply_criteria(samples, criteria), tie)
    if node_config is not None:
        streams = drop_unconfigured(streams, node_config, static)
    out = job_zombie(job_times(job_aggregate(merge_jobs(streams, merge, names=False), job_names(streams, merge))))
    out = job_liveness(out, host_bounds(samples))
    if node_config is not None:
        out = job_relative(out, node_config, static)
    out = filter_job_aggregates(out, **(limits or {}))
    out = filter_job_flags(out, **(flags or {}))
    if sacct_jobs is not None:
        out = attach_accounting(out, sacct_jobs, accounting)
    return out.orderBy("first", "job", "host", "solo") if sort else out


def top_jobs_per_user(jobs_df: DataFrame, n: int) -> DataFrame:
    """The n most recent jobs of every user; each user is cut to n rows before the shuffle."""
    w = Window.partitionBy("user").orderBy(
        F.col("first").desc(), F.col("job").desc(), F.col("host").desc(), F.col("solo").desc()
    )
    return jobs_df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def synth_accounting(jobs_df: DataFrame, streams: DataFrame, merge: str = "epoch") -> DataFrame:
    """An accounting record for every job, made from its samples: per task first, then per job."""
    from usagelens.operators.merge import _job_keyed

    keyed = _job_keyed(streams, across_hosts(merge))
    task_key = ["merge_host", "job", "solo", "host", "stream_id", "cmd"]
    tasks = keyed.groupBy(*task_key).agg(
        F.max_by("cputime_sec", "t").alias("_cpu"),
        F.expr("sum(rss_kb) div count(1)").alias("_rss"),
        F.expr("sum(cpu_kb) div count(1)").alias("_vm"),
        F.max("rss_kb").alias("_max_rss"),
        F.max("cpu_kb").alias("_max_vm"),
    )
    per_job = (
        tasks.groupBy(F.col("merge_host").alias("_h"), F.col("job").alias("_j"), F.col("solo").alias("_s"))
        .agg(
            F.min("_cpu").alias("min_cpu"),
            F.expr("sum(_rss) div count(1)").alias("ave_rss"),
            F.expr("sum(_vm) div count(1)").alias("ave_vmsize"),
            F.max("_max_rss").alias("max_rss"),
            F.max("_max_vm").alias("max_vmsize"),
            F.count(F.lit(1)).alias("_tasks"),
        )
    )
    cond = F.col("host").eqNullSafe(F.col("_h")) & (F.col("job") == F.col("_j")) & F.col("solo").eqNullSafe(F.col("_s"))
    n_cards = gpu_set_size("gpus")
    req = (
        F.when(is_unknown("gpus"), "*=1").when(n_cards > 0, F.concat(F.lit("*="), n_cards.cast("string"))).otherwise("")
    )
    return jobs_df.join(per_job, cond).select(
        *JOB_KEY,
        "hosts",
        F.col("job").alias("job_id"),
        F.when(F.col("live_at_end"), "RUNNING").otherwise("COMPLETED").alias("state"),
        F.col("user").alias("account"),
        "user",
        F.concat_ws(": ", "user", "cmd").alias("job_name"),
        F.col("first").alias("start"),
        F.col("first").alias("submit"),
        F.col("last").alias("end"),
        F.col("last").alias("t"),
        F.col("duration").alias("elapsed"),
        F.col("cputime_sec").alias("user_cpu"),
        F.expr("cputime_sec div _tasks").alias("ave_cpu"),
        F.expr("read_kb div _tasks").alias("ave_disk_read"),
        F.expr("written_kb div _tasks").alias("ave_disk_write"),
        "min_cpu", "ave_rss", "ave_vmsize", "max_rss", "max_vmsize",
        F.col("max_vmsize").alias("req_mem"),
        F.col("threads_peak").alias("req_cpus"),
        req.alias("req_gpus"),
        req.alias("req_res"),
    )


def attach_accounting(jobs_df: DataFrame, sacct_jobs: DataFrame, filters: dict | None = None) -> DataFrame:
    """Left join on the job.  With filters, jobs whose record fails them go; jobs without record stay.

    The filter is evaluated on the records, so one left join and a row test are enough.
    """
    passes = sacct_condition(**filters) if filters else F.lit(True)
    records = sacct_jobs.select(
        F.struct(*sacct_jobs.columns).alias("accounting"), F.col("job_id").alias("_job_id"), passes.alias("_passes")
    )
    joined = jobs_df.join(records, F.col("job") == F.col("_job_id"), "left")
    return joined.filter(F.col("_job_id").isNull() | F.col("_passes")).drop("_job_id", "_passes")
