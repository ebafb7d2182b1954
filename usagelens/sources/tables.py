"""Dated Parquet tables, joins at the source, and exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.gpus import gpu_set_union
from usagelens.operators.filters import filter_time_host
from usagelens.schemas import GPU_UNKNOWN, SAMPLE_FIELDS

HOUR = 3600


def utc_date(t: Column) -> Column:
    return F.to_date(F.timestamp_seconds(t))


def write_table(df: DataFrame, root: str, rows_per_file: int = 10_000_000, mode: str = "append") -> None:
    """Append, one folder per UTC day, rows ordered by host and time inside a file.

    Spark rebalances the rows by day, host and hour to partitions of its advisory size: small ones are joined, a
    day or host with a third of all rows is split.  So the number of files follows the data; the order inside a file
    gives row groups narrow host ranges for pruning.
    """
    dated = df.withColumn("date", utc_date(F.col("t"))).withColumn("_hour", F.floor(F.col("t") / HOUR))
    (
        dated.hint("rebalance", "date", "host", "_hour")
        .sortWithinPartitions("date", "host", "t")
        .drop("_hour")
        .write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("date").parquet(root)
    )


def read_dated(
    spark: SparkSession, root: str, from_t: int, to_t: int, hosts: list[str] | None = None, schema: str | None = None
) -> DataFrame:
    """Rows of the closed interval and hosts: whole days are pruned by folder, then rows by time and host."""
    reader = spark.read.schema(schema) if schema else spark.read
    first, last = (dt.datetime.fromtimestamp(x, dt.timezone.utc).date() for x in (from_t, to_t))
    days = reader.parquet(root).filter(F.col("date").between(F.lit(first), F.lit(last)))
    return filter_time_host(days, from_t, to_t, hosts)


def join_process_gpu(proc: DataFrame, proc_gpu: DataFrame) -> DataFrame:
    """Process rows with the sums over their cards, their number and the set of card indices.

    An index without a bit in a set makes the set unknown.
    Cards are summed per process before the join, so the join is one to one.
    """
    key = ["cluster", "host", "t", "pid", "job", "epoch"]
    bit = F.call_function("shiftleft", F.expr("1L"), F.col("index").cast("int"))
    per_process = proc_gpu.withColumn("_bit", F.when(F.col("index").between(0, 30), bit).otherwise(GPU_UNKNOWN)).groupBy(*key).agg(
        F.sum("gpu_memory").alias("gpu_kb"), F.sum("gpu_util").alias("gpu_pct"), F.sum("gpu_memory_util").alias("gpumem_pct"),
        F.count("uuid").alias("gpu_count"), gpu_set_union("_bit").alias("gpus"),
    )
    new = ["gpu_kb", "gpu_pct", "gpumem_pct", "gpu_count", "gpus"]
    kinds = dict(per_process.dtypes)
    joined = proc.drop(*new).join(per_process, key, "left")
    return joined.select(
        *[c for c in joined.columns if c not in new], *[F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) for c in new]
    )


def export(
    df: DataFrame, fields: list[str], fmt: str | None = None, path: str | None = None,
    aliases: dict[str, list[str]] | None = None, header: bool = True,
) -> DataFrame:
    """The fields in the given order; an alias stands for several; unknown fields are an error.

    With a format (``csv`` or ``json``) and path the result is written as well.
    """
    wanted: list[str] = []
    for f in fields:
        for name in (aliases or {}).get(f, [f]):
            if name not in df.columns:
                raise ValueError(f"unknown field: {name}")
            if name not in wanted:
                wanted.append(name)
    out = df.select(*wanted)
    if fmt and path:
        writer = out.write.mode("overwrite")
        writer.csv(path, header=header) if fmt == "csv" else writer.json(path)
    return out


def time_extent(sysinfo: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: earliest node report and latest sample."""
    lo = sysinfo.agg(F.min("t").alias("min_t"))
    hi = samples.agg(F.max("t").alias("max_t"))
    # Both sides are single rows.
    return lo.join(F.broadcast(hi))


SAMPLES_DDL = ", ".join(f"`{n}` {k}" for n, k, _ in SAMPLE_FIELDS)
