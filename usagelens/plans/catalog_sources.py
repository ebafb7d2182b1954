"""Queries on sources and sinks.

The records the parsers read are written as text by Spark from the given tables, so their number grows
with the tables; a few of them are damaged on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.gpus import gpu_set_text
from usagelens.functions.scalars import format_time
from usagelens.plans import inputs
from usagelens.plans import oracle as o
from usagelens.plans.catalog_jobs import SACCT_BASE, SACCT_BASE_SQL, sacct_mains
from usagelens.plans.driver_tables import EVENTS_START, samples
from usagelens.plans.registry import query
from usagelens.schemas import DISK_COUNTERS
from usagelens.session import shared_dir
from usagelens.sources import envelopes as env
from usagelens.sources import tables, tagged

DAY = 86400


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), value.cast("string"))


def sample_lines(spark, d) -> DataFrame:
    """Tagged records.  Every 7th has a bad number, every 11th no host, every 13th an unknown field."""
    e = F.col("event_id")
    fields = [
        _tag("v", F.lit("0.12.0")), _tag("time", format_time("t", "iso")),
        F.when(e % 11 != 0, _tag("host", F.col("host"))), _tag("user", F.col("user")),
        F.concat(F.lit('"cmd='), F.col("cmd"), F.lit(',""x"""')), _tag("job", F.col("job")),
        F.when(e % 7 == 0, F.lit("pid=abc")).otherwise(_tag("pid", F.col("pid"))),
        _tag("cpu%", F.col("cpu_pct")), _tag("cpukib", F.col("cpu_kb")), F.when(e % 13 == 0, F.lit("wat=1")),
        _tag("cputime_sec", F.col("cputime_sec")),
    ]
    gpus = F.when(F.col("gpus") != 0, F.concat(F.lit('"gpus='), gpu_set_text("gpus"), F.lit('"')))
    return samples(spark, d).select(F.concat_ws(",", *fields, gpus).alias("value"))


@query(
    "ingest_samples_csv",
    o.SAMPLES + """ SELECT t, host, "user", cmd || ',"x"' AS cmd, job, pid, cpu_pct, cpu_kb, cputime_sec, gpus, 1 AS epoch, 0 AS rolledup, FALSE AS heartbeat
    FROM samples WHERE event_id % 7 <> 0 AND event_id % 11 <> 0""",
)
def ingest_samples_csv(spark, d):
    good, _ = tagged.parse_samples_csv(sample_lines(spark, d))
    return good.select("t", "host", "user", "cmd", "job", "pid", "cpu_pct", "cpu_kb", "cputime_sec", "gpus", "epoch", "rolledup", "heartbeat")


@query(
    "ingest_samples_csv_rejects",
    o.SAMPLES + """ SELECT CASE WHEN event_id % 7 = 0 THEN 'bad value: pid' ELSE 'missing: host' END AS reason, count(*) AS n FROM samples WHERE event_id % 7 = 0 OR event_id % 11 = 0 GROUP BY 1""",
)
def ingest_samples_csv_rejects(spark, d):
    _, rejects = tagged.parse_samples_csv(sample_lines(spark, d))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ingest_samples_untagged",
    o.SAMPLES + """ SELECT t, host, "user", job, job AS pid, cmd, cpu_pct, cpu_kb, '0.6.0' AS version FROM samples WHERE event_id % 9 <> 0""",
)
def ingest_samples_untagged(spark, d):
    cols = [format_time("t", "iso"), "host", F.lit("64"), "user", F.col("job").cast("string"), "cmd", F.col("cpu_pct").cast("string")]
    line = F.concat_ws(",", *cols, F.when(F.col("event_id") % 9 != 0, F.col("cpu_kb").cast("string")), F.when(F.col("event_id") % 2 == 0, F.lit("extra")))
    # A record cut short keeps seven fields, even with a stray one after it.
    lines = samples(spark, d).select(line.alias("value"))
    out = tagged.parse_samples_untagged(lines)
    return out.select("t", "host", "user", "job", "pid", "cmd", "cpu_pct", "cpu_kb", "version")


def sample_envelopes(spark, d) -> DataFrame:
    """JSON envelopes of a (host, instant) with at most a hundred processes each, cards, disks and cores.

    Instants of odd minutes on n0 have no jobs; every envelope of n7 carries errors.
    """
    s = samples(spark, d).withColumn("part", F.floor(F.col("event_id") / 100))
    bare = (F.col("host") == "n0") & (F.floor(F.col("t") / 60) % 2 == 1)
    proc = F.struct(
        F.col("rss_kb").alias("resident_memory"), F.col("cpu_kb").alias("virtual_memory"), "cmd", "pid",
        F.col("threads").alias("num_threads"), F.col("cpu_pct").alias("cpu_avg"), F.col("cputime_sec").alias("cpu_time"),
        F.col("data_read_kb").alias("data_read"),
        F.when(
            F.col("gpus").between(1, 16),
            F.array(
                F.struct(F.col("epoch").alias("index"), F.col("gpu_pct").alias("gpu_util"), F.col("gpu_kb").alias("gpu_memory")),
                F.struct((F.col("epoch") + 2).alias("index"), F.lit(1.5).alias("gpu_util"), F.lit(10).alias("gpu_memory")),
            ),
        ).alias("gpus"),
    )
    jobs = s.groupBy("host", "t", "part", "job", "user", "epoch").agg(F.collect_list(proc).alias("processes"), F.sum("cpu_kb").alias("kb"), F.count(F.lit(1)).alias("n"))
    per = jobs.groupBy("host", "t", "part").agg(
        F.collect_list(F.when(~bare, F.struct("job", "user", "epoch", "processes"))).alias("jobs"),
        F.sum("kb").alias("kb"), F.sum("n").alias("n"),
    )
    h = F.substring("host", 2, 9).try_cast("bigint")
    system = F.struct(
        format_time(F.lit(EVENTS_START), "iso").alias("boot"), F.array(F.col("kb"), F.col("n"), F.col("t") % 1000).alias("cpus"),
        F.col("kb").alias("used_memory"), F.lit(0.5).alias("load1"), F.col("n").alias("existing_entities"),
        F.array(
            F.struct(F.lit(0).alias("index"), F.concat_ws("/", "host", F.lit("0")).alias("uuid"), (h % 2).alias("failing"), (F.col("n") * 10).alias("ce_util")),
            F.struct(F.lit(1).alias("index"), F.concat_ws("/", "host", F.lit("1")).alias("uuid"), F.lit(0).alias("failing"), F.col("n").alias("ce_util")),
        ).alias("gpus"),
        F.array(F.struct(F.lit("sda").alias("name"), F.lit(8).alias("major"), h.alias("minor"), F.array(F.col("kb"), F.col("n")).alias("stats"))).alias("disks"),
    )
    attributes = F.struct(format_time("t", "iso").alias("time"), F.lit("c1").alias("cluster"), F.col("host").alias("node"), system.alias("system"), "jobs")
    envelope = F.struct(
        F.struct(F.lit("0.19.0").alias("version")).alias("meta"), F.struct(F.lit("sample").alias("type"), attributes.alias("attributes")).alias("data"),
        F.when(F.col("host") == "n7", F.array(F.struct(F.lit("broken").alias("detail")))).alias("errors"),
    )
    return per.select(F.to_json(envelope).alias("value"))


_BARE = "host = 'n0' AND (t // 60) % 2 = 1"
_HOST_T = "inst AS (SELECT host, t, CAST(sum(cpu_kb) AS BIGINT) AS kb, count(*) AS n FROM samples WHERE host <> 'n7' GROUP BY host, t, event_id // 100)"


@query(
    "ingest_samples_json",
    o.SAMPLES + f""" SELECT t, host, "user", job, epoch, pid, cmd, threads + 1 AS threads, cpu_pct, cpu_kb, rss_kb, cputime_sec, data_read_kb, 3 AS num_cores, FALSE AS heartbeat,
      CASE WHEN gpus BETWEEN 1 AND 16 THEN (1 << CAST(epoch AS INTEGER)) | (1 << CAST(epoch + 2 AS INTEGER)) ELSE 0 END AS gpus,
      CASE WHEN gpus BETWEEN 1 AND 16 THEN gpu_pct + 1.5e0 ELSE 0 END AS gpu_pct, CASE WHEN gpus BETWEEN 1 AND 16 THEN gpu_kb + 10 ELSE 0 END AS gpu_kb,
      CASE WHEN gpus BETWEEN 1 AND 16 AND epoch = 0 AND CAST(substr(host, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE 0 END AS gpu_fail
    FROM samples WHERE host <> 'n7' AND NOT ({_BARE})
    UNION ALL SELECT t, host, '', 0, 1, 0, '_heartbeat_', 0, 0, 0, 0, 0, 0, 0, TRUE, 0, 0, 0, 0 FROM samples WHERE {_BARE} GROUP BY t, host, event_id // 100""",
)
def ingest_samples_json(spark, d):
    out = env.parse_samples_json(sample_envelopes(spark, d))
    return out.select(
        "t", "host", "user", "job", "epoch", "pid", "cmd", "threads", "cpu_pct", "cpu_kb", "rss_kb", "cputime_sec", "data_read_kb",
        "num_cores", "heartbeat", "gpus", "gpu_pct", "gpu_kb", "gpu_fail",
    )


@query("ingest_node_samples", o.SAMPLES + f", {_HOST_T} SELECT t, host, {EVENTS_START} AS boot, kb AS used_memory, 0.5::DOUBLE AS load1, 0::DOUBLE AS load5, n AS existing_entities FROM inst")
def ingest_node_samples(spark, d):
    return env.parse_node_samples(sample_envelopes(spark, d)).select("t", "host", "boot", "used_memory", "load1", "load5", "existing_entities")


@query("ingest_disk_samples", o.SAMPLES + f", {_HOST_T} SELECT t, host, 'sda' AS name, 8 AS major, CAST(substr(host, 2) AS BIGINT) AS minor, kb AS {DISK_COUNTERS[0]}, n AS {DISK_COUNTERS[1]}, {', '.join(f'0 AS {c}' for c in DISK_COUNTERS[2:])} FROM inst")
def ingest_disk_samples(spark, d):
    return env.parse_disk_samples(sample_envelopes(spark, d)).drop("cluster")


@query("ingest_cpu_samples", o.SAMPLES + f", {_HOST_T} SELECT t, host, CAST(kb AS VARCHAR) || ',' || CAST(n AS VARCHAR) || ',' || CAST(t % 1000 AS VARCHAR) AS per_core FROM inst")
def ingest_cpu_samples(spark, d):
    out = env.parse_cpu_samples(sample_envelopes(spark, d))
    return out.select("t", "host", F.array_join(F.col("per_core").cast("array<string>"), ",").alias("per_core"))


@query(
    "ingest_gpu_samples",
    o.SAMPLES + f""", {_HOST_T} SELECT t, host, 0 AS index, host || '/0' AS uuid, CAST(substr(host, 2) AS BIGINT) % 2 AS failing, n * 10 AS ce_util FROM inst
    UNION ALL SELECT t, host, 1, host || '/1', 0, n FROM inst""",
)
def ingest_gpu_samples(spark, d):
    rows = env.parse_gpu_samples(sample_envelopes(spark, d)).select("t", "host", F.explode("cards").alias("c"))
    return rows.select("t", "host", "c.index", "c.uuid", "c.failing", "c.ce_util")


@query("envelope_errors", o.SAMPLES + " SELECT count(DISTINCT (host, t, event_id // 100)) AS envelopes, count(DISTINCT CASE WHEN host = 'n7' THEN (host, t, event_id // 100) END) AS dropped FROM samples")
def envelope_errors(spark, d):
    return env.envelope_errors(sample_envelopes(spark, d), "sample")


def load_texts(spark, d) -> DataFrame:
    """Per-core arrays written in base 45, least digit first; every 10th text is damaged."""
    base = tagged.LOAD_BASE

    def number(v):
        first = F.substring(F.lit(tagged.LOAD_INITIAL), (v % base + 1).cast("int"), F.lit(1))
        rest = [
            F.when(
                v >= base**k,
                F.substring(F.lit(tagged.LOAD_SUBSEQUENT), (F.floor(v / base**k) % base + 1).cast("int"), F.lit(1)),
            ).otherwise("")
            for k in (1, 2, 3)
        ]
        return F.concat(first, *rest)

    arrays = inputs.cpu_samples(spark, d).select("t", "host", F.transform("per_core", lambda x: x + 60000).alias("v"))
    arrays = arrays.withColumn("low", F.array_min("v"))
    low = F.col("low")
    text = F.concat(number(low), F.array_join(F.transform("v", lambda x: number(x - low)), ""))
    damaged = F.when(F.col("t") % 10 == 0, F.concat(text, F.lit(" "))).otherwise(text)
    return arrays.select("t", "host", damaged.alias("load"))


_ENCODED = "WITH e AS (SELECT vec_id AS t, 'n' || CAST(label AS VARCHAR) AS host, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100000) AS BIGINT) + 60000) AS v FROM embeddings)"


@query("decode_load_column", _ENCODED + " SELECT t, host, array_to_string(v, ',') AS per_core FROM e WHERE t % 10 <> 0")
def decode_load_column(spark, d):
    rows, _ = tagged.decode_load_column(load_texts(spark, d))
    return rows.select("t", "host", F.array_join(F.col("per_core").cast("array<string>"), ",").alias("per_core"))


@query("decode_load_errors", _ENCODED + " SELECT count(*) AS undecodable FROM e WHERE t % 10 = 0")
def decode_load_errors(spark, d):
    return tagged.decode_load_column(load_texts(spark, d))[1]


def sacct_envelopes(spark, d) -> DataFrame:
    m = sacct_mains(spark, d)
    j = F.col("job_id")
    job = F.struct(
        "job_id", "job_name", F.col("state").alias("job_state"), "job_step", F.col("user").alias("user_name"), "account", "partition",
        F.col("array_job_id"), F.col("req_cpus").alias("requested_cpus"), F.col("req_nodes").alias("requested_node_count"),
        F.col("req_mem").alias("requested_memory_per_node"), format_time("start", "iso").alias("start_time"),
        format_time("submit", "iso").alias("submit_time"), (F.col("elapsed") % 5).alias("time_limit"), F.array("node_list", F.lit("x")).alias("nodes"),
        F.when(j % 4 == 0, F.col("alloc_res")).alias("allocated_resources"), F.when(j % 4 == 1, F.col("alloc_res")).alias("requested_resources"),
        F.struct(F.col("elapsed").alias("ElapsedRaw"), F.col("user_cpu").alias("UserCPU"), F.col("job_max_rss").alias("MaxRSS"),
                 F.when(j % 4 == 2, F.col("alloc_res")).alias("AllocTRES")).alias("sacct"),
    )
    day = m.groupBy((F.col("submit") - F.col("submit") % DAY).alias("t"), F.floor(j / 200).alias("part")).agg(F.collect_list(job).alias("slurm_jobs"))
    attributes = F.struct(format_time("t", "iso").alias("time"), F.lit("c1").alias("cluster"), "slurm_jobs")
    envelope = F.struct(F.struct(F.lit("0.19.0").alias("version")).alias("meta"), F.struct(F.lit("jobs").alias("type"), attributes.alias("attributes")).alias("data"))
    return day.select(F.to_json(envelope).alias("value"))


@query(
    "ingest_sacct_json",
    o.ACCOUNTING + f""" SELECT {SACCT_BASE_SQL}, submit - submit % 86400 AS t, job_max_rss AS max_rss, user_cpu, node_list || ',x' AS node_list,
    CASE WHEN elapsed % 5 >= 2 THEN elapsed % 5 - 2 ELSE 0 END AS timelimit, CASE WHEN job_id % 4 <> 3 THEN req_gpus ELSE '' END AS req_gpus,
    CASE WHEN job_id % 4 IN (0, 2) THEN alloc_res ELSE '' END AS alloc_res FROM sjobs""",
)
def ingest_sacct_json(spark, d):
    out = env.parse_sacct_json(sacct_envelopes(spark, d))
    return out.select(*SACCT_BASE, "t", "max_rss", "user_cpu", "node_list", "timelimit", "req_gpus", "alloc_res")


def sacct_lines(spark, d) -> DataFrame:
    m = sacct_mains(spark, d)
    e = F.col("user_cpu")
    elapsed = F.format_string("%d-%02d:%02d:%02d.5", F.floor(e / DAY), F.floor(e / 3600) % 24, F.floor(e / 60) % 60, e % 60)
    j = F.col("job_id")
    shown = F.when(F.col("array_job_id") != 0, F.format_string("%d_%d.batch", "array_job_id", j % 10)).otherwise(j.cast("string"))
    fields = [
        _tag("JobIDRaw", j), _tag("JobID", shown), _tag("User", F.col("user")), _tag("Account", F.col("account")),
        _tag("State", F.concat(F.col("state"), F.lit(" by 1"))), _tag("Partition", F.col("partition")), _tag("Start", format_time("start", "iso")),
        _tag("ElapsedRaw", F.col("elapsed")), _tag("UserCPU", elapsed),
        _tag("ReqMem", F.when(j % 2 == 0, F.concat((F.col("req_mem") / 1024).cast("bigint").cast("string"), F.lit("M"))).otherwise(F.concat(F.col("req_mem").cast("string"), F.lit("K")))),
        _tag("TimelimitRaw", j % 100), _tag("ExitCode", F.lit("3:9")), F.concat(F.lit('"AllocTRES='), F.col("alloc_res"), F.lit('"')),
        F.when(j % 19 == 0, F.lit("MaxRSS=oops")),
    ]
    return m.select(F.concat_ws(",", *fields).alias("value"))


@query(
    "ingest_sacct_csv",
    o.ACCOUNTING + """ SELECT job_id, "user", account, state, "partition", start, elapsed, user_cpu, req_gpus, (job_id % 100) * 60 AS timelimit, 3 AS exit_code, array_job_id,
    CASE WHEN array_job_id <> 0 THEN job_id % 10 ELSE 0 END AS array_task_id, CASE WHEN array_job_id <> 0 THEN 'batch' ELSE '' END AS array_step,
    CASE WHEN job_id % 2 = 0 THEN req_mem // 1024 * 1024 ELSE req_mem END AS req_mem FROM sjobs WHERE job_id % 19 <> 0""",
)
def ingest_sacct_csv(spark, d):
    out = tagged.parse_sacct_csv(sacct_lines(spark, d))
    return out.select(
        "job_id", "user", "account", "state", "partition", "start", "elapsed", "user_cpu", "req_gpus", "timelimit", "exit_code",
        "array_job_id", "array_task_id", "array_step", "req_mem",
    )


def sysinfo_envelopes(spark, d) -> DataFrame:
    n = inputs.nodes(spark, d).drop("cards")
    c = inputs.cards(spark, d).groupBy("t", "node").agg(F.array_sort(F.collect_list(F.struct("index", "uuid", "model", "memory"))).alias("cards"))
    full = n.join(c, ["t", "node"], "left")
    attributes = F.struct(
        "time", "cluster", "node", "os_name", "sockets", "cores_per_socket", "threads_per_core", "cpu_model", "memory",
        F.base64(F.col("node").cast("binary")).alias("topo_text"), "cards",
    )
    envelope = F.struct(F.struct(F.lit("0.19.0").alias("version")).alias("meta"), F.struct(F.lit("sysinfo").alias("type"), attributes.alias("attributes")).alias("data"))
    return full.select(F.to_json(envelope).alias("value"))


_TIME = "strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS time"


@query(
    "ingest_sysinfo",
    o.SAMPLES + o.REPORTS + f""" SELECT {_TIME}, host AS node, 2 AS sockets, 4 + h AS cores_per_socket, host AS topo_text,
    coalesce((SELECT string_agg(uuid, ',' ORDER BY index) FROM cards c WHERE c.node = r.host AND c.t = r.t), '') AS cards FROM reports r""",
)
def ingest_sysinfo(spark, d):
    nodes, _ = env.parse_sysinfo(sysinfo_envelopes(spark, d))
    return nodes.select("time", "node", "sockets", "cores_per_socket", "topo_text", F.array_join("cards", ",").alias("cards"))


@query("ingest_sysinfo_cards", o.SAMPLES + o.REPORTS + f" SELECT {_TIME}, node, index, uuid, model, memory FROM cards")
def ingest_sysinfo_cards(spark, d):
    return env.parse_sysinfo(sysinfo_envelopes(spark, d))[1].select("time", "node", "index", "uuid", "model", "memory")


def flat_sysinfo(spark, d) -> DataFrame:
    c = inputs.node_config(spark, d)
    record = F.struct(
        format_time("valid_from", "iso").alias("timestamp"), F.col("host").alias("hostname"), "description", "mem_gb", "gpu_cards",
        F.col("cores").alias("cpu_cores"),
    )
    # The older form puts the threads before the model, as the newer description does.
    return c.select(F.to_json(record).alias("value"))


@query(
    "ingest_sysinfo_flat",
    o.SAMPLES + o.REPORTS + """ SELECT host AS node, valid_from, 2 AS sockets, 4 + CAST(substr(host, 2) AS BIGINT) AS cores_per_socket, 1 + CAST(substr(host, 2) AS BIGINT) % 2 AS threads_per_core,
    'X' || substr(host, 2) AS cpu_model, mem_gb * 1048576 AS memory FROM config""",
)
def ingest_sysinfo_flat(spark, d):
    nodes, _ = env.parse_sysinfo_flat(flat_sysinfo(spark, d))
    return nodes.select("node", tagged.parse_time(F.col("time")).alias("valid_from"), "sockets", "cores_per_socket", "threads_per_core", "cpu_model", "memory")


@query("ingest_sysinfo_flat_cards", o.SAMPLES + o.REPORTS + " SELECT node, t, index - 1 AS index, model, memory FROM cards")
def ingest_sysinfo_flat_cards(spark, d):
    cards = env.parse_sysinfo_flat(flat_sysinfo(spark, d))[1]
    return cards.select("node", tagged.parse_time(F.col("time")).alias("t"), "index", "model", "memory")


def cluster_envelopes(spark, d) -> DataFrame:
    from usagelens.plans.catalog_jobs import cluster_state

    p, n = cluster_state(spark, d)
    both = p.join(n.drop("time"), ["t", "cluster"])
    attributes = F.struct("time", "cluster", F.lit(True).alias("slurm"), "partitions", "nodes")
    envelope = F.struct(F.struct(F.lit("0.19.0").alias("version")).alias("meta"), F.struct(F.lit("cluster").alias("type"), attributes.alias("attributes")).alias("data"))
    return both.select(F.to_json(envelope).alias("value"))


@query(
    "ingest_cluster_state",
    o.SAMPLES + """ SELECT strftime(to_timestamp(t - t % 86400) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS time, 'c' || CAST(epoch AS VARCHAR) AS cluster, TRUE AS slurm,
    count(DISTINCT cmd) AS n_partitions, count(DISTINCT host) AS n_nodes FROM samples GROUP BY 1, 2""",
)
def ingest_cluster_state(spark, d):
    attributes, partitions, nodes = env.parse_cluster_state(cluster_envelopes(spark, d))
    key = ["time", "cluster"]
    parts = partitions.select(*key, F.size("partitions").cast("bigint").alias("n_partitions"))
    return attributes.join(parts, key).join(nodes.select(*key, F.size("nodes").cast("bigint").alias("n_nodes")), key)


@query(
    "ingest_violation_log",
    o.SAMPLES + """ SELECT t - t % 60 AS now, job AS id, host, "user", cmd, cpu_pct AS cpu_peak, rss_kb::DOUBLE AS rmem_peak FROM samples WHERE cmd <> 'click' AND event_id % 6 <> 0""",
)
def ingest_violation_log(spark, d):
    e = F.col("event_id")
    minute = format_time("t", "minute")
    fields = [
        _tag("now", minute), _tag("jobm", F.concat(F.col("job").cast("string"), F.when(e % 2 == 0, F.lit(">")).otherwise(""))), _tag("user", F.col("user")),
        _tag("host", F.col("host")), _tag("cpu-peak", F.when(e % 6 == 0, F.lit("much")).otherwise(F.col("cpu_pct").cast("string"))),
        F.lit("gpu-peak=0,rcpu-avg=1,rcpu-peak=2,rmem-avg=3"), _tag("rmem-peak", F.col("rss_kb")), _tag("start", minute), _tag("end", minute),
        _tag("cmd", F.col("cmd")), _tag("tag", F.when(F.col("cmd") == "click", "other").otherwise("cpuhog")),
    ]
    lines = samples(spark, d).select(F.concat_ws(",", *fields).alias("value"))
    return tagged.parse_violation_log(lines, "cpuhog").select("now", "id", "host", "user", "cmd", "cpu_peak", "rmem_peak")


FROM, TO = EVENTS_START + 3 * DAY + 5000, EVENTS_START + 6 * DAY + 100


@query("read_dated", o.SAMPLES + f" SELECT t, host, pid, cmd, cpu_kb FROM samples WHERE t BETWEEN {FROM} AND {TO} AND host IN ('n1', 'n2', 'n5')")
def read_dated(spark, d):
    root = shared_dir(spark, "samples")
    tables.write_table(samples(spark, d).drop("event_id"), root)
    out = tables.read_dated(spark, root, FROM, TO, ["n[1-2]", "n5"])
    return out.select("t", "host", "pid", "cmd", "cpu_kb")


@query(
    "join_process_gpu",
    o.SAMPLES + """ SELECT event_id, cpu_kb, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 + event_id % 2 END AS gpu_count,
    CASE WHEN event_id % 3 = 0 THEN 0 ELSE cpu_kb * (1 + event_id % 2) END AS gpu_kb, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 2 = 0 THEN 1 ELSE 3 END AS gpus FROM samples""",
)
def join_process_gpu(spark, d):
    proc = samples(spark, d).withColumn("cluster", F.lit("c1")).withColumn("epoch", F.col("event_id"))
    per_card = proc.filter("event_id % 3 <> 0").withColumn("index", F.explode(F.expr("sequence(0, cast(event_id % 2 as int))")))
    proc_gpu = per_card.select(
        "cluster", "host", "t", "pid", "job", "epoch", "index", F.concat_ws("/", "host", F.col("index").cast("string")).alias("uuid"),
        F.col("cpu_kb").alias("gpu_memory"), F.col("cpu_pct").alias("gpu_util"), F.lit(0.0).alias("gpu_memory_util"),
    )
    return tables.join_process_gpu(proc, proc_gpu).select("event_id", "cpu_kb", "gpu_count", "gpu_kb", "gpus")


@query("write_table", o.SAMPLES + " SELECT strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, 2 * count(*) AS n, CAST(2 * sum(cpu_kb) AS BIGINT) AS cpu_kb FROM samples GROUP BY 1")
def write_table(spark, d):
    root = shared_dir(spark, "samples")
    for _ in range(2):
        tables.write_table(samples(spark, d).select("t", "host", "cpu_kb"), root)
    return spark.read.parquet(root).groupBy(F.col("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("cpu_kb").alias("cpu_kb"))


_EXPORTED = " SELECT host, CAST(t AS VARCHAR) AS t, CAST(job AS VARCHAR) AS job, cmd FROM samples"


@query("export", o.SAMPLES + _EXPORTED)
def export(spark, d):
    path = shared_dir(spark, "export")
    tables.export(samples(spark, d), ["where", "job", "cmd"], "csv", path, {"where": ["host", "t"]})
    return spark.read.csv(path, header=True)


@query("export_json", o.SAMPLES + _EXPORTED)
def export_json(spark, d):
    path = shared_dir(spark, "export")
    tables.export(samples(spark, d), ["where", "job", "cmd"], "json", path, {"where": ["host", "t"]})
    return spark.read.schema("host string, t string, job string, cmd string").json(path)
