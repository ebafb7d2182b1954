"""Projections of the given tables into the library's record schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.schemas import conform_samples

# The first instant of the event tables, and the densified series starts there.
EVENTS_START = 1704067200
DENSE_FACTOR = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def project_events(events: DataFrame) -> DataFrame:
    """Process samples from events: one stream per (user, event type) on eight hosts, 10 s grid.

    CPU time grows with the time and has the event's value added, so it goes backwards now and then,
    as real counters do.  It needs no window: every row is projected on its own.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    gpu_user = F.col("event_type").isin("purchase", "view")
    raw = events.withColumn("_raw_t", seconds("ts"))
    df = raw.select(
        "event_id",
        (F.col("_raw_t") - F.col("_raw_t") % 10).alias("t"),
        F.concat(F.lit("n"), (F.col("user_id") % 8).cast("string")).alias("host"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        (F.col("user_id") % 50).alias("job"),
        (F.col("user_id") + 1000).alias("pid"),
        F.col("event_type").alias("cmd"),
        (F.col("user_id") % 2).alias("epoch"),
        F.lit("0.12.0").alias("version"),
        F.lit(0).alias("rolledup"),
        F.col("value").alias("cpu_pct"),
        (F.floor((F.col("_raw_t") - EVENTS_START) / 400) + F.floor("value")).cast("bigint").alias("cputime_sec"),
        F.floor(F.col("value") * 1048576).cast("bigint").alias("cpu_kb"),
        F.floor(F.col("value") * 524288).cast("bigint").alias("rss_kb"),
        F.when(F.col("event_type") == "error", F.lit(1 << 31))
        .when(gpu_user, F.power(F.lit(2), F.col("user_id") % 4).cast("bigint"))
        .otherwise(0).cast("bigint").alias("gpus"),
        F.when(gpu_user, k).otherwise(0).cast("double").alias("gpu_pct"),
        F.when(gpu_user, k * 16384).otherwise(0).cast("bigint").alias("gpu_kb"),
        F.when((F.col("event_type") == "error") & (k >= 90), 1).otherwise(0).alias("gpu_fail"),
        (F.col("user_id") % 3 + 1).alias("threads"),
        (k * 1024).alias("data_read_kb"),
        (k * 512).alias("data_written_kb"),
    )
    return conform_samples(df, ("event_id",))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_events(table(spark, sf_dir, "events"))


def dense_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples twenty times closer together, each stream at its own offset in the 10 s grid."""
    df = samples(spark, sf_dir)
    t = F.floor((F.col("t") - EVENTS_START) / DENSE_FACTOR).cast("bigint")
    return df.withColumn("t", F.lit(EVENTS_START) + t - t % 10 + F.col("pid") % 7)
