"""Batch-system accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.scalars import round_half_up
from usagelens.operators.streams import dealt_out

# How final a state is; everything else is final.
STATE_RANK = {"PENDING": 0, "RUNNING": 1}
FINAL_RANK = 2


def state_rank(c: Column) -> Column:
    return F.when(c == "PENDING", STATE_RANK["PENDING"]).when(c == "RUNNING", STATE_RANK["RUNNING"]).otherwise(FINAL_RANK)


def sacct_dedup(sacct: DataFrame) -> DataFrame:
    """Per (job, step) the latest record, of equally late ones the most final.

    Records are dealt out by job before they are sorted, as a scan may be one task over a whole table; the grouping of
    :func:`sacct_jobs` finds them dealt that way already.
    """
    rest = [c for c in sacct.columns if c not in ("job_id", "job_step", "t", "state")]
    w = Window.partitionBy("job_id", "job_step").orderBy(
        F.col("t").desc(), state_rank(F.col("state")).desc(), "state", *rest
    )
    return dealt_out(sacct, "job_id").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def sacct_jobs(records: DataFrame) -> DataFrame:
    """One row per job: its main record, the number of steps and the largest resident size over all.

    The main record has a user; the one with the smallest step name if several do.  Jobs without are
    dropped.  Steps stay rows of ``records`` (see :func:`sacct_steps`), only their aggregates are kept, so
    a job may have any number of them.
    """
    main = F.when(F.col("user") != "", F.struct(*records.columns))
    grouped = records.groupBy(F.col("job_id").alias("_job")).agg(
        F.min_by(main, F.when(F.col("user") != "", F.col("job_step"))).alias("_m"),
        F.count(F.lit(1)).alias("_n"),
        F.max("max_rss").alias("job_max_rss"),
    )
    return grouped.filter(F.col("_m").isNotNull()).select("_m.*", (F.col("_n") - 1).alias("n_steps"), "job_max_rss")


def sacct_steps(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """Steps of the given jobs, without the main records."""
    mains = jobs.select("job_id", F.col("job_step").alias("_main_step"))
    return records.join(mains, "job_id").filter(F.col("job_step") != F.col("_main_step")).drop("_main_step")


def sacct_report(jobs: DataFrame) -> DataFrame:
    """Adds requested and used CPU time, both relative values, and the waiting time."""
    requested = F.col("req_cpus") * F.col("req_nodes") * F.col("elapsed")
    used = F.col("user_cpu") + F.col("system_cpu")
    return (
        jobs.withColumn("requested_cpu", requested)
        .withColumn("used_cpu", used)
        .withColumn("rcpu", F.when(requested > 0, round_half_up(100 * used / requested)).otherwise(0).cast("bigint"))
        .withColumn(
            "rmem", F.when(F.col("req_mem") > 0, round_half_up(100 * F.col("job_max_rss") / F.col("req_mem"))).otherwise(0).cast("bigint")
        )
        .withColumn("wait", F.when(F.col("start") > 0, F.col("start") - F.col("submit")).otherwise(0).cast("bigint"))
    )


def sacct_split(jobs: DataFrame, kind: str) -> DataFrame:
    """``array``, ``het`` or ``regular`` jobs."""
    array = F.col("array_job_id") != 0
    het = ~array & (F.col("het_job_id") != 0)
    return jobs.filter({"array": array, "het": het, "regular": ~array & ~het}[kind])


def sacct_arrays(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per array job the number of elements with user and state of its first element, and the members' reports."""
    members = sacct_report(sacct_split(jobs, "array"))
    head = F.min_by(F.struct("user", "state"), "job_id")
    arrays = members.groupBy("array_job_id").agg(F.count(F.lit(1)).alias("elements"), head.alias("_h"))
    return arrays.select("array_job_id", "elements", "_h.user", "_h.state"), members


def alloc_log(records: DataFrame, node_gpus: DataFrame, keep_steps: bool = False) -> DataFrame:
    """Allocation log: CPU count, GPU count and type, uniform partition and state names.

    ``node_gpus`` (``node, kind``, one row per node) tells the type of GPUs that a record does not name.
    """
    alloc = F.col("alloc_res")

    def extract(pattern: str) -> Column:
        return F.regexp_extract(alloc, pattern, 1)

    named = r"(?:^|,)gres/gpu:([^=,]+)=\d+"
    partition = (
        F.when(F.col("partition").contains("accel"), "accel")
        .when(F.col("partition").contains("bigmem"), "bigmem")
        .when(F.col("partition").isin("normal", "mig", ""), F.col("partition"))
        .otherwise("other")
    )
    named_count = extract(r"(?:^|,)gres/gpu:[^=,]+=(\d+)")
    df = records.filter(F.col("state") != "RUNNING").filter(F.col("state") != "PENDING")
    if not keep_steps:
        df = df.filter(~F.col("job_step").isin("interactive", "batch", "extern"))
    df = df.select(
        "job_id", "job_step", "user", "node_list", "elapsed", "start", "end",
        partition.alias("partition"),
        F.when(F.col("state").startswith("CANCELLED"), "CANCELLED").otherwise(F.col("state")).alias("state"),
        extract(r"(?:^|,)cpu=(\d+)").try_cast("bigint").alias("cpus"),
        F.when(named_count != "", named_count).otherwise(extract(r"(?:^|,)gres/gpu=(\d+)")).try_cast("bigint").alias("gpus"),
        extract(named).alias("_type"),
    )
    kinds = node_gpus.select(F.col("node").alias("_node"), F.col("kind").alias("_kind"))
    joined = df.join(kinds, F.col("node_list") == F.col("_node"), "left")
    gpu_type = F.when(F.col("_type") != "", F.col("_type")).when(F.col("gpus").isNotNull(), F.col("_kind"))
    return joined.withColumn("gpu_type", F.coalesce(gpu_type, F.lit(""))).drop("_type", "_node", "_kind")
