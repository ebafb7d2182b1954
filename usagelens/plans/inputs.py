"""Frames that several queries start from, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.scalars import format_time
from usagelens.operators import config
from usagelens.operators.streams import clean_streams
from usagelens.plans.driver_tables import EVENTS_START, dense_samples, samples, seconds, table
from usagelens.schemas import conform_sacct

DAY = 86400
GB = 1 << 20
CLUSTER = "c1"


def clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_streams(samples(spark, d), ["event_id"])


def clean_dense(spark: SparkSession, d: str) -> DataFrame:
    return clean_streams(dense_samples(spark, d), ["event_id"])


def reports(spark: SparkSession, d: str) -> DataFrame:
    """(host, t, h, day): days on which a host reported its hardware.

    Even hosts report every fifth day, odd ones on days 0, 1 and 22, which leaves a gap of more than two
    weeks; n7 never does.
    """
    seen = samples(spark, d).select("host", (F.col("t") - F.col("t") % DAY).alias("t")).distinct()
    seen = seen.withColumn("h", F.substring("host", 2, 9).try_cast("bigint")).withColumn(
        "day", F.floor((F.col("t") - EVENTS_START) / DAY)
    )
    even = (F.col("h") % 2 == 0) & (F.col("day") % 5 == 0)
    odd = (F.col("h") % 2 == 1) & F.col("day").isin(0, 1, 22)
    return seen.filter((F.col("h") != 7) & (even | odd))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    r = reports(spark, d)
    n_cards = (F.col("h") % 4).cast("int")
    uuids = F.when(n_cards > 0, F.transform(F.sequence(F.lit(1), n_cards), lambda i: F.concat_ws("/", "host", i.cast("string"))))
    return r.select(
        format_time("t", "iso").alias("time"), "t", F.lit(CLUSTER).alias("cluster"), F.col("host").alias("node"), "host",
        F.lit("Linux").alias("os_name"),
        F.lit(2).cast("bigint").alias("sockets"), (F.col("h") + 4).alias("cores_per_socket"),
        (F.col("h") % 2 + 1).alias("threads_per_core"), F.concat(F.lit("X"), F.col("h").cast("string")).alias("cpu_model"),
        ((64 + 16 * F.col("h") + 8 * F.floor(F.col("day") / 10)) * GB).cast("bigint").alias("memory"),
        F.coalesce(uuids, F.array().cast("array<string>")).alias("cards"),
    )


def cards(spark: SparkSession, d: str) -> DataFrame:
    r = reports(spark, d).filter("h % 4 > 0")
    each = r.withColumn("index", F.explode(F.sequence(F.lit(1), (F.col("h") % 4).cast("int"))))
    return each.select(
        format_time("t", "iso").alias("time"), "t", F.lit(CLUSTER).alias("cluster"), F.col("host").alias("node"),
        F.col("index").cast("bigint").alias("index"), F.concat_ws("/", "host", F.col("index").cast("string")).alias("uuid"),
        F.concat(F.lit("G"), (F.col("h") % 3).cast("string")).alias("model"),
        (8 * GB * (1 + F.floor(F.col("day") / 10))).cast("bigint").alias("memory"),
    )


def node_config(spark: SparkSession, d: str) -> DataFrame:
    return config.node_config(nodes(spark, d), cards(spark, d))


def static_config(spark: SparkSession, d: str) -> DataFrame:
    """Hosts n1 and n3 have a fixed configuration too."""
    seen = samples(spark, d).select("host").distinct().filter(F.col("host").isin("n1", "n3"))
    return seen.select(
        "host", F.concat(F.lit("static "), F.col("host")).alias("description"),
        *[F.lit(v).cast("bigint").alias(c) for c, v in (("cores", 4), ("mem_gb", 32), ("gpu_cards", 1), ("gpumem_gb", 16))],
    )


def sacct(spark: SparkSession, d: str) -> DataFrame:
    """Accounting records: mains from orders, steps from line items."""
    o = table(spark, d, "orders").withColumn("_d", seconds("o_orderdate"))
    k = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING")
    state = F.when((F.col("o_orderstatus") == "F") & (k % 11 == 0), "TIMEOUT").otherwise(state.otherwise("PENDING"))
    gpu = F.when(k % 3 == 0, F.concat(F.lit("gres/gpu:a100="), (k % 4 + 1).cast("string"))).when(k % 3 == 1, "gres/gpu=2")
    alloc = F.concat_ws(",", F.concat(F.lit("cpu="), (k % 64 + 1).cast("string")), F.lit("mem=4G"), gpu)
    main = o.select(
        k.alias("job_id"), F.lit("").alias("job_step"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"),
        F.concat(F.lit("a"), (F.col("o_custkey") % 7).cast("string")).alias("account"),
        F.when(k % 5 == 0, "interactive").when(k % 5 == 1, "OOD desktop").otherwise("run").alias("job_name"),
        state.alias("state"), F.col("o_orderpriority").alias("partition"), F.col("_d").alias("submit"),
        (F.col("_d") + (k % 200) * 1800).alias("start"), (F.col("_d") + (k % 200) * 1800 + k % 90000).alias("end"),
        (k % 90000).alias("elapsed"), (k % 64 + 1).alias("req_cpus"), (k % 4 + 1).alias("req_nodes"),
        F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("req_mem"),
        F.when(k % 13 == 0, k - k % 130).otherwise(0).alias("array_job_id"),
        F.when(k % 17 == 0, k - k % 34).otherwise(0).alias("het_job_id"),
        (k % 90000 * (k % 40)).alias("user_cpu"), (k % 1000).alias("system_cpu"),
        F.concat(F.lit("n["), (k % 4).cast("string"), F.lit("-"), (k % 4 + 2).cast("string"), F.lit("].x")).alias("node_list"),
        alloc.alias("alloc_res"), F.lit(0).alias("max_rss"), F.col("_d").alias("t"),
    )
    l = table(spark, d, "lineitem")
    steps = l.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("string").alias("job_step"),
        F.floor(F.col("l_extendedprice") * 100).cast("bigint").alias("max_rss"), seconds("l_shipdate").alias("t"),
    )
    from usagelens.functions.scalars import parse_gpu_request

    both = main.unionByName(steps, allowMissingColumns=True)
    return conform_sacct(both.withColumn("req_gpus", parse_gpu_request("alloc_res")))


def cpu_samples(spark: SparkSession, d: str) -> DataFrame:
    """Per-core arrays from the vectors; not cumulative, so differences may be negative."""
    e = table(spark, d, "embeddings")
    return e.select(
        F.col("vec_id").alias("t"), F.concat(F.lit("n"), F.col("label").cast("string")).alias("host"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 100000).cast("bigint")).alias("per_core"),
    )


def gpu_samples(spark: SparkSession, d: str) -> DataFrame:
    """Card readings of each instant: cards 1 .. h % 4 of every host, from the event values."""
    s = samples(spark, d).filter("try_cast(substring(host, 2, 9) as bigint) % 4 > 0")
    inst = s.groupBy("host", "t").agg(F.max(F.col("data_read_kb")).alias("v"), F.count(F.lit(1)).alias("c"))
    n = (F.substring("host", 2, 9).try_cast("int") % 4).cast("int")
    v = (F.col("v") / 1024).cast("bigint")
    card = lambda i: F.struct(
        i.cast("bigint").alias("index"), F.concat_ws("/", "host", i.cast("string")).alias("uuid"),
        ((v + i * 7) % 101).cast("bigint").alias("ce_util"), ((v * 3 + i) % 101).cast("bigint").alias("memory_util"),
    )
    return inst.select("t", "host", F.transform(F.sequence(F.lit(1), n), card).alias("cards"))


def disk_samples(spark: SparkSession, d: str) -> DataFrame:
    """Two disks per host with counters from the samples of each instant."""
    from usagelens.schemas import DISK_COUNTERS

    s = samples(spark, d).groupBy("host", "t").agg(F.sum("data_read_kb").alias("v"))
    each = s.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    return each.select(
        "t", F.lit(CLUSTER).alias("cluster"), "host", F.concat(F.lit("sd"), F.col("i").cast("string")).alias("name"),
        F.lit(8).cast("bigint").alias("major"), F.col("i").cast("bigint").alias("minor"),
        *[(F.col("v") * (i + 1) + F.col("i")).cast("bigint").alias(c) for i, c in enumerate(DISK_COUNTERS)],
    )
