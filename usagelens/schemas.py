"""Record schemas.  Times are Unix seconds (UTC) in a bigint column ``t``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of a process sample, their types and what an absent field means.
SAMPLE_FIELDS = [
    ("version", "string", ""),
    ("t", "bigint", None),
    ("cluster", "string", ""),
    ("host", "string", None),
    ("user", "string", ""),
    ("job", "bigint", 0),
    ("pid", "bigint", 0),
    ("ppid", "bigint", 0),
    ("cmd", "string", None),
    ("epoch", "bigint", 1),
    ("num_cores", "bigint", 0),
    ("memtotal_kb", "bigint", 0),
    ("rolledup", "bigint", 0),
    ("threads", "bigint", 0),
    ("cpu_pct", "double", 0.0),
    ("cpu_sampled_pct", "double", 0.0),
    ("cpu_kb", "bigint", 0),
    ("rss_kb", "bigint", 0),
    ("gpus", "bigint", 0),
    ("gpu_pct", "double", 0.0),
    ("gpumem_pct", "double", 0.0),
    ("gpu_kb", "bigint", 0),
    ("gpu_fail", "bigint", 0),
    ("cputime_sec", "bigint", 0),
    ("data_read_kb", "bigint", 0),
    ("data_written_kb", "bigint", 0),
    ("data_cancelled_kb", "bigint", 0),
    ("in_container", "boolean", False),
    ("heartbeat", "boolean", False),
]

# Columns of an accounting record.
SACCT_TEXT = [
    "version", "user", "job_name", "state", "account", "layout", "reservation", "job_step",
    "array_step", "het_step", "node_list", "partition", "req_gpus", "alloc_res", "req_res",
]
SACCT_NUMBERS = [
    "t", "start", "end", "submit", "system_cpu", "user_cpu", "ave_cpu", "min_cpu", "ave_disk_read",
    "ave_disk_write", "ave_rss", "ave_vmsize", "max_rss", "max_vmsize", "req_mem", "elapsed",
    "suspended", "timelimit", "job_id", "array_job_id", "array_task_id", "het_job_id",
    "het_job_offset", "req_cpus", "req_nodes", "priority", "exit_code",
]

# The counters of a disk sample, in the order of the kernel's statistics line.
DISK_COUNTERS = [
    "reads_completed", "reads_merged", "sectors_read", "ms_reading", "writes_completed",
    "writes_merged", "sectors_written", "ms_writing", "ios_in_progress", "ms_doing_io",
    "weighted_ms_doing_io", "discards_completed", "discards_merged", "sectors_discarded",
    "ms_discarding", "flushes_completed", "ms_flushing",
]

GPU_UNKNOWN = 1 << 31


def conform_samples(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All sample columns with their types; absent optional fields get their defaults."""
    cols = []
    for name, kind, default in SAMPLE_FIELDS:
        if name in df.columns:
            c = F.col(name).cast(kind)
            cols.append((c if default is None else F.coalesce(c, F.lit(default).cast(kind))).alias(name))
        else:
            cols.append(F.lit(default).cast(kind).alias(name))
    return df.select(*cols, *keep)


def conform_sacct(df: DataFrame) -> DataFrame:
    """All accounting columns with their types; absent text is empty and absent numbers are zero."""
    cols = []
    for name in SACCT_NUMBERS:
        c = F.coalesce(F.col(name).cast("bigint"), F.lit(0)) if name in df.columns else F.lit(0)
        cols.append(c.cast("bigint").alias(name))
    for name in SACCT_TEXT:
        c = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")
        cols.append(c.alias(name))
    return df.select(*cols)
