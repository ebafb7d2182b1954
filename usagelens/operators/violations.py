"""Policy violations: detection, consolidation of repeated reports, and state kept between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.operators.filters import filter_job_aggregates, filter_job_flags

# What counts as a CPU hog.
HOG_RCPU_PEAK = 10
HOG_RUNTIME = 600
TWO_DAYS = 2 * 86400
MAX_FIELDS = ["cpu_peak", "gpu_peak", "rcpu_avg", "rcpu_peak", "rmem_avg", "rmem_peak"]


def cpu_hogs(jobs: DataFrame, since: int | None = None) -> DataFrame:
    """Jobs without GPU that ran 10 minutes or more and peaked at 10 % or more of the host."""
    recent = jobs if since is None else jobs.filter(F.col("last") >= since)
    out = filter_job_aggregates(recent, min_rcpu_peak=HOG_RCPU_PEAK, min_runtime=HOG_RUNTIME)
    return filter_job_flags(out, no_gpu=True)


def deadweight_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that have become zombies."""
    return filter_job_flags(jobs, zombie=True)


def consolidate_runs(log: DataFrame) -> DataFrame:
    """Repeated reports of a job in consecutive report times of its host are one run; a gap starts a new one.

    Older runs of an ID are expired.  ``log`` has ``now, id, host, user, cmd, start, end`` and any of the
    peak columns.  Report times are ranked on the distinct (host, time) pairs, so a host with many reports
    per time costs one row per time in that window.
    """
    peaks = [c for c in MAX_FIELDS if c in log.columns]
    once = log.groupBy("host", "id", "now").agg(
        F.max_by(F.struct("user", "cmd"), F.struct("user", "cmd")).alias("_who"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        *[F.max(c).alias(c) for c in peaks],
    )
    times = log.select("host", "now").distinct()
    times = times.withColumn("_rank", F.row_number().over(Window.partitionBy("host").orderBy("now")))
    nth = F.row_number().over(Window.partitionBy("host", "id").orderBy("now"))
    runs = (
        once.join(times, ["host", "now"])
        .withColumn("_island", F.col("_rank") - nth)
        .groupBy("host", "id", "_island")
        .agg(
            F.max_by("_who", "now").alias("_who"),
            F.min("now").alias("first_seen"),
            F.max("now").alias("last_seen"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            *[F.max(c).alias(c) for c in peaks],
        )
    )
    newer = F.row_number().over(Window.partitionBy("host", "id").orderBy(F.col("last_seen").desc()))
    return runs.withColumn("expired", newer > 1).select(
        "host", "id", "_who.user", "_who.cmd", "first_seen", "last_seen", "start", "end", *peaks, "expired"
    )


STATE = ["id", "host", "started_on_or_before", "first_violation", "last_seen", "is_reported", "is_expired"]
STATE_SCHEMA = (
    "id bigint, host string, started_on_or_before bigint, first_violation bigint, last_seen bigint, "
    "is_reported boolean, is_expired boolean"
)


def _keyed(df: DataFrame, expired: str) -> DataFrame:
    """Active entries are keyed by (id, host); expired ones also by when they were last seen."""
    seen = F.when(F.col(expired), F.col("last_seen")).otherwise(F.lit(-1))
    return df.withColumn("_seen", seen.cast("bigint"))


def merge_state(state: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """Insert new violations, first seen now; update when active ones were last seen."""
    s = _keyed(state, "is_expired").select("id", "host", "_seen", F.struct(*STATE).alias("_s"))
    r = _keyed(runs, "expired").select("id", "host", "_seen", F.struct("start", "last_seen", "expired").alias("_r"))
    both = s.join(r, ["id", "host", "_seen"], "full_outer")
    known = F.col("_s").isNotNull()
    return both.select(
        "id",
        "host",
        F.when(known, F.col("_s.started_on_or_before")).otherwise(F.col("_r.start")).alias("started_on_or_before"),
        F.when(known, F.col("_s.first_violation")).otherwise(F.lit(now)).cast("bigint").alias("first_violation"),
        F.coalesce("_r.last_seen", "_s.last_seen").alias("last_seen"),
        F.coalesce("_s.is_reported", F.lit(False)).alias("is_reported"),
        F.coalesce("_s.is_expired", "_r.expired").alias("is_expired"),
    )


def purge_cutoff(from_t: int, to_t: int) -> int:
    return min(from_t, to_t - TWO_DAYS)


def purge_state(state: DataFrame, cutoff: int) -> DataFrame:
    """Drop reported entries not seen since the cutoff."""
    return state.filter(~(F.col("is_reported") & (F.col("last_seen") < cutoff)))


def new_violations(state: DataFrame, runs: DataFrame, everything: bool = False) -> DataFrame:
    """Unreported entries (or all) that occur in the log, with what the log knows about them."""
    wanted = state if everything else state.filter(~F.col("is_reported"))
    s = _keyed(wanted, "is_expired").drop("last_seen", "is_reported", "is_expired")
    r = _keyed(runs, "expired").drop("expired")
    return s.join(r, ["id", "host", "_seen"]).drop("_seen")


def mark_reported(state: DataFrame, reported: DataFrame) -> DataFrame:
    """The state after a report: the entries in it count as reported."""
    keys = reported.select("id", "host", "last_seen", F.lit(True).alias("_now")).distinct()
    return (
        state.join(keys, ["id", "host", "last_seen"], "left")
        .withColumn("is_reported", F.col("is_reported") | F.coalesce("_now", F.lit(False)))
        .select(*STATE)
    )


def violations_by_host(state: DataFrame, now: int) -> DataFrame:
    """Entries whose first violation lies in the last day, per host."""
    return state.filter(F.col("first_violation") > now - 86400).groupBy("host").agg(F.count(F.lit(1)).alias("violations"))


def write_state(state: DataFrame, root: str, version: int) -> None:
    """Write one version of the state as its own folder; a failed write leaves the version before in force."""
    state.select(*STATE).write.mode("overwrite").parquet(f"{root}/version={version}")


def read_state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The given version, the empty state for None."""
    if version is None:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(f"{root}/version={version}")
