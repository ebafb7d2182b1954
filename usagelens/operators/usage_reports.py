"""Usage reports over job summaries, accounting reports and load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.hosts import host_pattern_regex
from usagelens.operators.filters import filter_job_flags

DAY = 86400
# Names that tell an interactive job, states that are left out, cohort limits.
INTERACTIVE = "interactive|OOD|ood"
SERIOUS = {"runtime": 2 * 3600, "mem_kb": 20 << 20, "cores": 32}


def _totals(jobs: DataFrame, keys: list[str], quantities: list[str]) -> DataFrame:
    """Sums per key and each sum's share of the whole.

    The grand total is a one-row aggregate of the grouped sums, so no window over everything is needed.
    """
    sums = jobs.groupBy(*keys).agg(*[F.sum(q).alias(q) for q in quantities])
    whole = sums.agg(*[F.sum(q).alias(f"_all_{q}") for q in quantities])
    # One row of fixed width.
    joined = sums.join(F.broadcast(whole))
    shares = [
        F.when(F.col(f"_all_{q}") != 0, F.col(q) * 100 / F.col(f"_all_{q}")).otherwise(0.0).alias(f"{q}_share")
        for q in quantities
    ]
    return joined.select(*keys, *quantities, *shares)


def top_commands(jobs: DataFrame, n: int = 25) -> DataFrame:
    """CPU time per command with its share, largest first."""
    out = _totals(jobs, ["cmd"], ["cputime_sec"]).filter(F.col("cputime_sec") != 0)
    return out.orderBy(F.col("cputime_sec").desc(), "cmd").limit(n)


def top_consumers(jobs: DataFrame, n: int, by: str = "cputime_sec") -> DataFrame:
    """CPU and GPU time per user with shares, sorted by one of them."""
    out = _totals(jobs, ["user"], ["cputime_sec", "gputime_sec"])
    return out.orderBy(F.col(by).desc(), "user").limit(n)


def user_total_load(jobs: DataFrame, quantity: str) -> DataFrame:
    """One quantity per user with its share; users with none are left out."""
    out = _totals(jobs, ["user"], [quantity]).filter(F.col(quantity) != 0)
    return out.orderBy(F.col(quantity).desc(), "user")


def worst_violators(jobs: DataFrame, n: int) -> DataFrame:
    """CPU time per user on jobs that used no GPU."""
    return user_total_load(filter_job_flags(jobs, no_gpu=True), "cputime_sec").limit(n)


def user_load_by_command(jobs: DataFrame, user: str, n: int, by: str = "cputime_sec") -> DataFrame:
    mine = jobs.filter(F.col("user") == user)
    sums = mine.groupBy("cmd").agg(F.sum("cputime_sec").alias("cputime_sec"), F.sum("gputime_sec").alias("gputime_sec"))
    return sums.orderBy(F.col(by).desc(), "cmd").limit(n)


def heavy_gpu_users(
    jobs: DataFrame, prof: DataFrame, cutoff: int = DAY, buckets_per_period: int = 24, full: int = 100
) -> DataFrame:
    """Jobs of a day or more with a day or more of GPU time, starred if they kept a full card busy that long.

    ``prof`` is the bucketed profile of all jobs.  Runs of busy buckets are islands; sums per (job, bucket)
    come first, so a job's window has one row per bucket.
    """
    heavy = jobs.filter((F.col("job") != 0) & (F.col("duration") >= cutoff) & (F.col("gputime_sec") >= cutoff))
    wanted = prof.join(heavy.select("job").distinct(), "job", "left_semi")
    busy = (
        wanted.groupBy("job", "minute")
        .agg((F.sum(F.floor("gpu_pct")) >= full).alias("_busy"))
        .withColumn("_n", F.row_number().over(Window.partitionBy("job").orderBy("minute")))
        .filter("_busy")
    )
    island = F.col("_n") - F.row_number().over(Window.partitionBy("job").orderBy("_n"))
    runs = busy.withColumn("_island", island).groupBy("job", "_island").agg(F.count(F.lit(1)).alias("_len"))
    starred = runs.filter(F.col("_len") >= buckets_per_period).select("job").distinct().withColumn("_star", F.lit(True))
    share = F.floor(F.col("gputime_sec") / F.col("duration") * 100).cast("bigint")
    return heavy.join(starred, "job", "left").select(
        F.when(F.col("_star"), "*").otherwise("").alias("mark"), "job", "user", "gputime_sec",
        share.alias("gpu_share"), F.array_join("hosts", ",").alias("hosts"), "cmd",
    )


def underused_gpu_jobs(jobs: DataFrame, sacct: DataFrame, min_runtime: int = 7200, limit: float = 25) -> DataFrame:
    """Per command the non-interactive jobs whose occupied GPU and GPU memory both peaked below the limit."""
    batch = sacct.filter(~F.concat_ws(" ", "user", "account", "state", "job_name").rlike(INTERACTIVE)).select(
        F.col("job_id").alias("job")
    )
    low = jobs.filter(
        (F.col("duration") >= min_runtime) & (F.ceil("sgpu_peak") < limit) & (F.ceil("sgpumem_peak") < limit)
    ).join(batch, "job", "left_semi")
    return low.select(F.explode(F.split("cmd", ",")).alias("cmd")).groupBy("cmd").agg(F.count(F.lit(1)).alias("jobs"))


def _noninteractive() -> Column:
    return ~F.coalesce(F.col("job_name"), F.lit("")).rlike(INTERACTIVE)


def _serious(runtime: int) -> Column:
    return (
        (F.col("elapsed") >= runtime) & (F.col("req_mem") >= SERIOUS["mem_kb"])
        & (F.col("req_cpus") * F.col("req_nodes") >= SERIOUS["cores"])
    )


def blame(report: DataFrame, by: str, limit: int = 25) -> DataFrame:
    """Serious, non-interactive jobs with both relative values at most the limit, per user or account."""
    wasteful = report.filter(
        _serious(SERIOUS["runtime"]) & _noninteractive() & ~F.col("state").rlike("TIMEOUT|CANCELLED")
        & (F.col("rcpu") <= limit) & (F.col("rmem") <= limit)
    )
    return wasteful.groupBy(by).agg(F.count(F.lit(1)).alias("jobs")).orderBy(F.col("jobs").desc(), by)


def heatmap(df: DataFrame, x: str, y: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """Counts of two percentages, clamped to 1..100, in an n by n grid."""
    width = 100 // n

    def cell(c: str) -> Column:
        return F.floor((F.greatest(F.lit(1), F.least(F.lit(100), F.floor(c))) - 1) / width).cast("bigint")

    return df.groupBy(*(keys or []), cell(x).alias("x"), cell(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def heatmap_grid(counts: DataFrame, n: int) -> DataFrame:
    """The counts as a grid with a column per x, zero where there is none."""
    pivoted = counts.groupBy("y").pivot("x", list(range(n))).agg(F.sum("n"))
    return pivoted.select("y", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"x{i}") for i in range(n)]).orderBy("y")


def with_cohorts(report: DataFrame) -> DataFrame:
    """One row per cohort a job belongs to."""
    serious, large = _serious(SERIOUS["runtime"]), _serious(DAY)
    timeout = F.col("state").contains("TIMEOUT")
    cancelled = F.col("state").contains("CANCELLED")
    batch = _noninteractive()
    cohorts = {
        "all": F.lit(True),
        "serious": serious,
        "serious-noninteractive": serious & batch,
        "serious-timeout": serious & batch & timeout,
        "serious-nontimeout": serious & batch & ~timeout,
        "large": large & batch & ~timeout,
        "large-noncancelled": large & batch & ~timeout & ~cancelled,
    }
    labels = F.array(*[F.when(c, F.lit(name)) for name, c in cohorts.items()])
    return report.withColumn("cohort", F.explode(F.filter(labels, lambda v: v.isNotNull())))


def right_size_maps(report: DataFrame, n: int = 10, cohort: str | None = None) -> DataFrame:
    """Heat maps of relative CPU and memory of every cohort in one pass."""
    df = with_cohorts(report)
    df = df.filter(F.col("cohort") == cohort) if cohort else df
    return heatmap(df, "rcpu", "rmem", n, ["cohort"])


def gpu_class_maps(jobs: DataFrame, classes: dict[str, str], n: int = 10, min_runtime: int = 7200) -> DataFrame:
    """Heat maps of occupied GPU and GPU memory peaks per host class.

    ``classes`` gives a host pattern per class; a job counts once in each class one of its hosts is in.
    """

    def member(pattern: str) -> Column:
        regex = host_pattern_regex(pattern)
        return F.exists("hosts", lambda h: h.rlike(regex))

    labels = F.array(*[F.when(member(p), F.lit(name)) for name, p in classes.items()])
    df = jobs.filter((F.col("gpus") != 0) & (F.col("duration") >= min_runtime))
    df = df.withColumn("host_class", F.explode(F.filter(labels, lambda v: v.isNotNull())))
    df = df.withColumn("_x", F.ceil("sgpu_peak")).withColumn("_y", F.ceil("sgpumem_peak"))
    return heatmap(df, "_x", "_y", n, ["host_class"])


def waste_trend(report: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Per end day the share of jobs with both values at most the cutoff, and its mean over 7 days present.

    After the aggregation a cutoff has one row per day, which is all the window sees.
    """
    day = F.floor(F.col("end") / DAY).cast("bigint")
    each = F.explode(F.array(*[F.lit(c).cast("bigint") for c in cutoffs]))
    rows = report.select(day.alias("day"), "rcpu", "rmem", each.alias("cutoff"))
    days = rows.groupBy("cutoff", "day").agg(
        (F.count_if((F.col("rcpu") <= F.col("cutoff")) & (F.col("rmem") <= F.col("cutoff"))) / F.count(F.lit(1))).alias("share")
    )
    w = Window.partitionBy("cutoff").orderBy("day").rowsBetween(-6, 0)
    return days.withColumn("trend", F.floor(F.avg("share").over(w) * 100 + 1e-9).cast("bigint"))


def wait_histogram(report: DataFrame, hosts: str | None = None) -> DataFrame:
    """Jobs by whole hours waited: one row with a column per class."""
    df = report if hosts is None else report.filter(F.col("node_list").rlike(hosts))
    hours = F.floor(F.col("wait") / 3600)
    classes = {
        "h0": hours == 0, "h1": hours == 1, "h2": hours == 2, "h3": hours == 3,
        "h4_11": hours.between(4, 11), "h12_23": hours.between(12, 23),
        "d1_6": hours.between(24, 167), "longer": hours >= 168,
    }
    return df.agg(F.count(F.lit(1)).alias("jobs"), *[F.count_if(c).alias(n) for n, c in classes.items()])


def gpu_utilization_days(load: DataFrame) -> DataFrame:
    """Mean daily relative GPU %, days below 40, days above 80."""
    return load.agg(
        F.avg("rgpu").alias("mean"), F.count_if(F.col("rgpu") < 40).alias("below_40"), F.count_if(F.col("rgpu") > 80).alias("above_80")
    )


def interactive_utilization(jobs: DataFrame, pattern: str = "OOD", min_runtime: int = 7200) -> DataFrame:
    """Average and peak CPU per requested core of the jobs whose name matches.

    ``jobs`` carries ``accounting`` (see ``attach_accounting``) with ``job_name`` and ``req_cpus``.
    """
    named = jobs.filter(F.col("accounting.job_name").rlike(pattern) & (F.col("duration") >= min_runtime))
    cores = F.col("accounting.req_cpus")
    return named.filter(cores > 0).select(
        "job", F.col("accounting.job_name").alias("job_name"), "duration", cores.alias("req_cpus"),
        (F.col("cpu_avg") / cores).alias("avg_per_core"), (F.col("cpu_peak") / cores).alias("peak_per_core"), "cmd",
    )
