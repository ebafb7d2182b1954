"""JSON envelopes, one per line: samples, accounting, inventory and cluster state.

All parsers take a frame with a text column ``value`` and an explicit schema.  Envelopes that carry errors
or do not parse are dropped; ``envelope_errors`` counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.gpus import normalise
from usagelens.functions.scalars import parse_gpu_request
from usagelens.schemas import DISK_COUNTERS, GPU_UNKNOWN, conform_sacct, conform_samples
from usagelens.sources.tagged import parse_time

_META = "meta struct<producer:string,version:string>, errors array<struct<detail:string>>"

SAMPLE_ENVELOPE = f"""{_META}, data struct<type:string, attributes:struct<
  time:string, cluster:string, node:string,
  system:struct<boot:string, cpus:array<bigint>, used_memory:bigint, load1:double, load5:double, load15:double,
    runnable_entities:bigint, existing_entities:bigint,
    gpus:array<struct<index:bigint, uuid:string, failing:bigint, fan:bigint, compute_mode:string,
      performance_state:bigint, memory:bigint, ce_util:bigint, memory_util:bigint, temperature:bigint,
      power:bigint, power_limit:bigint, ce_clock:bigint, memory_clock:bigint>>,
    disks:array<struct<name:string, major:bigint, minor:bigint, stats:array<bigint>>>>,
  jobs:array<struct<job:bigint, user:string, epoch:bigint, processes:array<struct<
    resident_memory:bigint, virtual_memory:bigint, cmd:string, pid:bigint, ppid:bigint, num_threads:bigint,
    cpu_avg:double, cpu_util:double, cpu_time:bigint, rolledup:bigint, in_container:boolean,
    data_read:bigint, data_written:bigint, data_cancelled:bigint,
    gpus:array<struct<index:bigint, uuid:string, gpu_util:double, gpu_memory:bigint, gpu_memory_util:double>>>>>>>>"""

# Accounting job field, column.  The nested block has the batch system's own names.
SACCT_TEXTS = [
    ("job_name", "job_name"), ("job_state", "state"), ("job_step", "job_step"), ("user_name", "user"),
    ("account", "account"), ("partition", "partition"), ("reservation", "reservation"), ("distribution", "layout"),
]
SACCT_COUNTS = [
    ("job_id", "job_id"), ("array_job_id", "array_job_id"), ("array_task_id", "array_task_id"),
    ("het_job_id", "het_job_id"), ("het_job_offset", "het_job_offset"), ("requested_cpus", "req_cpus"),
    ("requested_memory_per_node", "req_mem"), ("requested_node_count", "req_nodes"),
    ("suspend_time", "suspended"), ("exit_code", "exit_code"),
]
SACCT_NESTED = [
    ("SystemCPU", "system_cpu"), ("UserCPU", "user_cpu"), ("AveCPU", "ave_cpu"), ("MinCPU", "min_cpu"),
    ("AveDiskRead", "ave_disk_read"), ("AveDiskWrite", "ave_disk_write"), ("AveRSS", "ave_rss"),
    ("AveVMSize", "ave_vmsize"), ("ElapsedRaw", "elapsed"), ("MaxRSS", "max_rss"), ("MaxVMSize", "max_vmsize"),
]
# Fixed value: limits below this are "not set" and "unlimited"; others are stored with it added.
EXTENDED_BASE = 2

SACCT_ENVELOPE = (
    f"{_META}, data struct<type:string, attributes:struct<time:string, cluster:string, slurm_jobs:array<struct<"
    + ", ".join(f"{n}:string" for n, _ in SACCT_TEXTS)
    + ", "
    + ", ".join(f"{n}:bigint" for n, _ in SACCT_COUNTS)
    + ", start_time:string, end_time:string, submit_time:string, time_limit:bigint, priority:bigint, "
    + "nodes:array<string>, allocated_resources:string, requested_resources:string, sacct:struct<AllocTRES:string, "
    + ", ".join(f"{n}:bigint" for n, _ in SACCT_NESTED)
    + ">>>>>"
)

SYSINFO_ENVELOPE = f"""{_META}, data struct<type:string, attributes:struct<
  time:string, cluster:string, node:string, os_name:string, os_release:string, architecture:string,
  numa_nodes:bigint, sockets:bigint, cores_per_socket:bigint, threads_per_core:bigint, cpu_model:string,
  memory:bigint, topo_svg:string, topo_text:string, distances:array<array<bigint>>,
  cards:array<struct<index:bigint, uuid:string, address:string, manufacturer:string, model:string,
    architecture:string, driver:string, firmware:string, memory:bigint, power_limit:bigint,
    max_power_limit:bigint, min_power_limit:bigint, max_ce_clock:bigint, max_memory_clock:bigint>>>>"""

CLUSTER_ENVELOPE = f"""{_META}, data struct<type:string, attributes:struct<time:string, cluster:string, slurm:boolean,
  partitions:array<struct<name:string, nodes:array<string>>>,
  nodes:array<struct<names:array<string>, states:array<string>>>>>"""

FLAT_SYSINFO = """version string, timestamp string, hostname string, description string, cpu_cores bigint,
  mem_gb bigint, gpu_cards bigint, gpumem_gb bigint,
  gpu_info array<struct<bus_addr:string, index:bigint, uuid:string, manufacturer:string, model:string, arch:string,
    driver:string, firmware:string, mem_size_kib:bigint, power_limit_watt:bigint, max_power_limit_watt:bigint,
    min_power_limit_watt:bigint, max_ce_clock_mhz:bigint, max_mem_clock_mhz:bigint>>"""

KIND_SCHEMAS = {"sample": SAMPLE_ENVELOPE, "jobs": SACCT_ENVELOPE, "sysinfo": SYSINFO_ENVELOPE, "cluster": CLUSTER_ENVELOPE}


def opened(lines: DataFrame, kind: str) -> DataFrame:
    """Envelopes parsed once, as ``e``: every parser of the kind takes them in place of lines."""
    return _opened(lines, KIND_SCHEMAS[kind])


def _opened(lines: DataFrame, schema: str) -> DataFrame:
    if "e" in lines.columns:
        return lines
    return lines.filter(F.trim("value") != "").select(F.from_json("value", schema).alias("e"))


def _ok() -> Column:
    return F.col("e.errors").isNull() & F.col("e.data").isNotNull()


def _attributes(lines: DataFrame, schema: str) -> DataFrame:
    return _opened(lines, schema).filter(_ok()).select(F.col("e.meta.version").alias("version"), "e.data.attributes.*")


def envelope_errors(lines: DataFrame, kind: str) -> DataFrame:
    """One row: envelopes read and envelopes dropped."""
    return _opened(lines, KIND_SCHEMAS[kind]).agg(
        F.count(F.lit(1)).alias("envelopes"), F.count_if(~_ok()).alias("dropped")
    )


def _samples_base(lines: DataFrame) -> DataFrame:
    df = _attributes(lines, SAMPLE_ENVELOPE).withColumn("t", parse_time(F.col("time")))
    return df.filter(F.col("t").isNotNull()).withColumnRenamed("node", "host")


def _n(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def parse_samples_json(lines: DataFrame) -> DataFrame:
    """One row per process; a node without jobs gives one heartbeat row."""
    base = _samples_base(lines)
    failing = F.transform(
        F.filter(F.coalesce("system.gpus", F.array()), lambda g: _n(g["failing"]) != 0), lambda g: g["index"]
    )
    jobs = base.select(
        "version", "t", "cluster", "host",
        F.coalesce(F.size("system.cpus"), F.lit(0)).alias("_cores"),
        failing.alias("_failing"),
        F.explode_outer(F.when(F.size("jobs") > 0, F.col("jobs"))).alias("j"),
    )
    heartbeat = F.col("j").isNull()
    procs = jobs.select("*", F.explode_outer("j.processes").alias("p")).filter(heartbeat | F.col("p").isNotNull())
    gpus = F.coalesce("p.gpus", F.array())

    def total(field: str, kind: str) -> Column:
        return F.aggregate(gpus, F.lit(0).cast(kind), lambda a, g: a + _n(g[field]).cast(kind))

    # A card index without a bit in a set makes the set unknown.
    bit = lambda g: F.when(_n(g["index"]).between(0, 30), F.call_function("shiftleft", F.expr("1L"), _n(g["index"]).cast("int"))).otherwise(GPU_UNKNOWN)
    mask = normalise(F.aggregate(gpus, F.lit(0).cast("bigint"), lambda a, g: a.bitwiseOR(bit(g))))
    fail = F.exists(gpus, lambda g: F.array_contains(F.col("_failing"), _n(g["index"])))
    rows = procs.select(
        "version", "t", "cluster", "host",
        F.col("j.user").alias("user"), _n("j.job").alias("job"),
        F.when(heartbeat, 1).otherwise(_n("j.epoch")).alias("epoch"),
        _n("p.pid").alias("pid"), _n("p.ppid").alias("ppid"),
        F.when(heartbeat, "_heartbeat_").otherwise(F.coalesce("p.cmd", F.lit(""))).alias("cmd"),
        F.when(heartbeat, 0).otherwise(F.col("_cores")).alias("num_cores"),
        _n("p.rolledup").alias("rolledup"),
        F.when(heartbeat, 0).otherwise(_n("p.num_threads") + 1).alias("threads"),
        _n("p.cpu_avg").alias("cpu_pct"), _n("p.cpu_util").alias("cpu_sampled_pct"),
        _n("p.virtual_memory").alias("cpu_kb"), _n("p.resident_memory").alias("rss_kb"),
        mask.alias("gpus"), total("gpu_util", "double").alias("gpu_pct"),
        total("gpu_memory_util", "double").alias("gpumem_pct"), total("gpu_memory", "bigint").alias("gpu_kb"),
        F.coalesce(fail, F.lit(False)).cast("bigint").alias("gpu_fail"),
        _n("p.cpu_time").alias("cputime_sec"), _n("p.data_read").alias("data_read_kb"),
        _n("p.data_written").alias("data_written_kb"), _n("p.data_cancelled").alias("data_cancelled_kb"),
        "p.in_container", heartbeat.alias("heartbeat"),
    )
    return conform_samples(rows)


def parse_node_samples(lines: DataFrame) -> DataFrame:
    return _samples_base(lines).select(
        "t", "cluster", "host", _n(parse_time(F.col("system.boot"))).alias("boot"),
        _n("system.used_memory").alias("used_memory"),
        _n("system.load1").alias("load1"), _n("system.load5").alias("load5"), _n("system.load15").alias("load15"),
        _n("system.runnable_entities").alias("runnable_entities"),
        _n("system.existing_entities").alias("existing_entities"),
    )


def parse_disk_samples(lines: DataFrame) -> DataFrame:
    """One row per disk; counters missing at the end of the list are zero."""
    disks = _samples_base(lines).select("t", "cluster", "host", F.explode("system.disks").alias("d"))
    return disks.select(
        "t", "cluster", "host", "d.name", _n("d.major").alias("major"), _n("d.minor").alias("minor"),
        *[_n(F.get("d.stats", F.lit(i))).alias(c) for i, c in enumerate(DISK_COUNTERS)],
    )


def parse_cpu_samples(lines: DataFrame) -> DataFrame:
    rows = _samples_base(lines).select("t", "host", F.col("system.cpus").alias("per_core"))
    return rows.filter(F.size("per_core") > 0)


def parse_gpu_samples(lines: DataFrame) -> DataFrame:
    rows = _samples_base(lines).select("t", "host", F.col("system.gpus").alias("cards"))
    return rows.filter(F.size("cards") > 0)


def parse_sacct_json(lines: DataFrame) -> DataFrame:
    """One row per job step.  GPUs come from what was allocated, else requested, else the nested block."""
    jobs = _attributes(lines, SACCT_ENVELOPE).select(
        "version", _n(parse_time(F.col("time"))).alias("t"), F.explode("slurm_jobs").alias("j")
    )
    requests = [F.nullif(parse_gpu_request(c), F.lit("")) for c in ("j.allocated_resources", "j.requested_resources", "j.sacct.AllocTRES")]
    step = F.coalesce("j.job_step", F.lit(""))

    def extended(c: str) -> Column:
        return F.when(F.col(c) >= EXTENDED_BASE, F.col(c) - EXTENDED_BASE).otherwise(0)

    rows = jobs.select(
        "version", "t",
        *[F.col(f"j.{n}").alias(c) for n, c in SACCT_TEXTS],
        *[F.col(f"j.{n}").alias(c) for n, c in SACCT_COUNTS],
        *[F.col(f"j.sacct.{n}").alias(c) for n, c in SACCT_NESTED],
        parse_time(F.col("j.start_time")).alias("start"), parse_time(F.col("j.end_time")).alias("end"),
        parse_time(F.col("j.submit_time")).alias("submit"),
        extended("j.time_limit").alias("timelimit"), extended("j.priority").alias("priority"),
        F.when(_n("j.array_job_id") != 0, step).alias("array_step"),
        F.when(_n("j.het_job_id") != 0, step).alias("het_step"),
        F.array_join(F.coalesce("j.nodes", F.array().cast("array<string>")), ",").alias("node_list"),
        F.coalesce(*requests).alias("req_gpus"),
        F.coalesce(F.nullif(F.col("j.allocated_resources"), F.lit("")), F.col("j.sacct.AllocTRES")).alias("alloc_res"),
        F.col("j.requested_resources").alias("req_res"),
    )
    return conform_sacct(rows)


CARD_FIELDS = [
    "index", "uuid", "address", "manufacturer", "model", "architecture", "driver", "firmware", "memory",
    "power_limit", "max_power_limit", "min_power_limit", "max_ce_clock", "max_memory_clock",
]


def parse_sysinfo(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node frame and card frame of the same reports; topology drawings are decoded."""
    base = _attributes(lines, SYSINFO_ENVELOPE)

    def decoded(c: str) -> Column:
        return F.coalesce(F.try_to_binary(F.nullif(F.col(c), F.lit("")), F.lit("base64")).cast("string"), F.lit(""))

    nodes = base.select(
        "time", "cluster", "node", "os_name", "os_release", "architecture",
        *[_n(c).alias(c) for c in ("numa_nodes", "sockets", "cores_per_socket", "threads_per_core")],
        "cpu_model", _n("memory").alias("memory"),
        decoded("topo_svg").alias("topo_svg"), decoded("topo_text").alias("topo_text"),
        F.coalesce("distances", F.expr("array(array(10L))")).alias("distances"),
        F.coalesce(F.transform("cards", lambda c: c["uuid"]), F.array().cast("array<string>")).alias("cards"),
    )
    cards = base.select("time", "cluster", "node", F.explode("cards").alias("c")).select(
        "time", "cluster", "node", *[F.col(f"c.{f}").alias(f) for f in CARD_FIELDS]
    )
    return nodes, cards


def parse_sysinfo_flat(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The older flat form, where the hardware is in a description text."""
    base = lines.filter(F.trim("value") != "").select(F.from_json("value", FLAT_SYSINFO).alias("e")).select("e.*")
    base = base.filter(F.col("hostname").isNotNull())
    cpu = r"^(\d+)x(\d+)( \(hyperthreaded\))?(.*?), \d+ (?:GB|GiB)"
    gpu = r", \d+x (.*?) @ (\d+) ?(?:GB|GiB)"
    desc = F.coalesce("description", F.lit(""))
    known = desc.rlike(cpu)

    def number(i: int) -> Column:
        return F.coalesce(F.regexp_extract(desc, cpu, i).try_cast("bigint"), F.lit(0))

    threads = F.when(~known, 0).when(F.regexp_extract(desc, cpu, 3) != "", 2).otherwise(1)
    nodes = base.select(
        F.col("timestamp").alias("time"), F.lit("").alias("cluster"), F.col("hostname").alias("node"),
        F.lit("Linux").alias("os_name"), F.lit("").alias("os_release"),
        F.when(desc.contains("Intel") | desc.contains("AMD"), "x86_64").otherwise("aarch64").alias("architecture"),
        F.lit(0).cast("bigint").alias("numa_nodes"),
        number(1).alias("sockets"), number(2).alias("cores_per_socket"), threads.cast("bigint").alias("threads_per_core"),
        F.trim(F.regexp_extract(desc, cpu, 4)).alias("cpu_model"),
        (_n("mem_gb") * (1 << 20)).alias("memory"),
    )
    model = F.regexp_extract(desc, gpu, 1)
    maker = F.when(model.contains("NVIDIA"), "NVIDIA").when(model.contains("AMD"), "AMD").when(model.contains("Intel"), "Intel").otherwise("")
    named = F.transform(
        "gpu_info",
        lambda g, i: F.struct(
            i.cast("bigint").alias("index"), g["uuid"].alias("uuid"), g["manufacturer"].alias("manufacturer"),
            g["model"].alias("model"), _n(g["mem_size_kib"]).alias("memory"),
        ),
    )
    counted = F.transform(
        F.sequence(F.lit(0), F.col("gpu_cards").cast("int") - 1),
        lambda i: F.struct(
            i.cast("bigint").alias("index"), F.lit("").alias("uuid"), maker.alias("manufacturer"), model.alias("model"),
            (_n(F.regexp_extract(desc, gpu, 2).try_cast("bigint")) * (1 << 20)).alias("memory"),
        ),
    )
    cards = base.select(
        F.col("timestamp").alias("time"), F.lit("").alias("cluster"), F.col("hostname").alias("node"),
        F.explode(F.when(F.col("gpu_info").isNotNull(), named).when(F.col("gpu_cards") > 0, counted)).alias("c"),
    ).select("time", "cluster", "node", "c.*")
    return nodes, cards


def parse_cluster_state(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attribute, partition and node-state frames."""
    base = _attributes(lines, CLUSTER_ENVELOPE)
    return (
        base.select("time", "cluster", F.coalesce("slurm", F.lit(False)).alias("slurm")),
        base.select("time", "cluster", "partitions"),
        base.select("time", "cluster", "nodes"),
    )


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def ingest_samples_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_samples_json(_text(spark, path))


def ingest_node_samples(spark: SparkSession, path: str) -> DataFrame:
    return parse_node_samples(_text(spark, path))


def ingest_disk_samples(spark: SparkSession, path: str) -> DataFrame:
    return parse_disk_samples(_text(spark, path))


def ingest_cpu_samples(spark: SparkSession, path: str) -> DataFrame:
    return parse_cpu_samples(_text(spark, path))


def ingest_gpu_samples(spark: SparkSession, path: str) -> DataFrame:
    return parse_gpu_samples(_text(spark, path))


def ingest_sacct_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_sacct_json(_text(spark, path))


def ingest_sysinfo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_sysinfo(_text(spark, path))


def ingest_sysinfo_flat(spark: SparkSession, path: str, pretty: bool = True) -> tuple[DataFrame, DataFrame]:
    """``pretty`` files hold indented objects one after the other, each closed by a brace at the line start."""
    if pretty:
        lines = spark.read.text(path, lineSep="\n}").filter(F.trim("value") != "")
        lines = lines.select(F.concat("value", F.lit("}")).alias("value"))
    else:
        lines = _text(spark, path)
    return parse_sysinfo_flat(lines)


def ingest_cluster_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_cluster_state(_text(spark, path))
