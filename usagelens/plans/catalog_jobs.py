"""Queries on job summaries, configuration and accounting joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.operators import accounting, config, filters, jobs as j, merge, streams
from usagelens.plans import inputs
from usagelens.plans import oracle as o
from usagelens.plans.driver_tables import EVENTS_START, samples
from usagelens.plans.inputs import clean
from usagelens.plans.registry import query, rounded, sql_round

R = sql_round
CAPS = ["cores", "mem_gb", "gpu_cards", "gpumem_gb"]
CAPS_SQL = ", ".join(CAPS)

# A job is identified by its number and hosts; job 0 streams by cmd and user too.
def ids():
    return ["job", F.array_join("hosts", ",").alias("hosts"), "user", "cmd"]


IDS_SQL = "job, array_to_string(hosts, ',') AS hosts, \"user\", cmd"
MEANS = ["cpu_avg", "cpu_peak", "mem_avg", "mem_peak", "res_avg", "res_peak", "gpu_avg", "gpu_peak", "gpumem_avg", "gpumem_peak", "threads_avg"]
WHOLES = ["threads_peak", "cputime_sec", "read_kb", "written_kb", "read_gb", "written_gb", "vm_kb_peak", "rss_kb_peak", "gpus", "gpu_fail", "n_samples"]
JOB_SQL = f"{IDS_SQL}, {', '.join(f'{R(c)} AS {c}' for c in MEANS)}, {', '.join(WHOLES)}"


def job_view(df, *more):
    return df.select(*ids(), *[rounded(c).alias(c) for c in MEANS], *WHOLES, *more)


def summaries(spark, d, **kw):
    return j.jobs(samples(spark, d), criteria=filters.Criteria(all_users=True), tie=["event_id"], **kw)


def unsorted(spark, d, **kw):
    return summaries(spark, d, sort=False, **kw)


def aggregated(clean_rows):
    return j.job_aggregate(merge.merge_by_epoch(clean_rows, names=False), merge.job_names(clean_rows))


@query("job_aggregate", o.JOBS + f" SELECT {JOB_SQL}, first, last FROM jobs")
def job_aggregate(spark, d):
    return job_view(aggregated(clean(spark, d)), "first", "last")


@query("job_times", o.JOBS + f" SELECT {IDS_SQL}, first, last, duration, gputime_sec FROM jobs")
def job_times(spark, d):
    return j.job_times(aggregated(clean(spark, d))).select(*ids(), "first", "last", "duration", "gputime_sec")


_MARK = "CAST(job AS VARCHAR) || CASE WHEN live_at_start AND live_at_end THEN '!' WHEN live_at_start THEN '<' WHEN live_at_end THEN '>' ELSE '' END AS jobm"
_CLASS = "CAST(live_at_start AS INTEGER) * 2 + CAST(live_at_end AS INTEGER) AS classification"


@query("job_liveness", o.JOBS + f" SELECT {IDS_SQL}, live_at_start, live_at_end, {_MARK}, {_CLASS} FROM jobs")
def job_liveness(spark, d):
    summary = aggregated(clean(spark, d))
    out = j.job_liveness(summary, streams.host_bounds(samples(spark, d)))
    return out.select(*ids(), "live_at_start", "live_at_end", "jobm", "classification")


@query("job_zombie", o.JOBS + f" SELECT {IDS_SQL}, contains(cmd, 'error') AS zombie FROM jobs")
def job_zombie(spark, d):
    df = samples(spark, d).withColumn("cmd", F.when(F.col("cmd") == "error", "error <defunct>").otherwise(F.col("cmd")))
    out = j.job_zombie(aggregated(streams.clean_streams(df, ["event_id"])))
    return out.withColumn("cmd", F.replace("cmd", F.lit(" <defunct>"))).select(*ids(), "zombie")


@query(
    "job_commands",
    o.CLEAN + """ SELECT host, job, string_agg(cmd, ', ' ORDER BY first, cmd) AS commands FROM (
    SELECT host, job, cmd, min(t) AS first FROM clean GROUP BY 1, 2, 3) GROUP BY host, job""",
)
def job_commands(spark, d):
    return j.job_commands(clean(spark, d), ["host", "job"])


@query("jobs", o.JOBS + f" SELECT {JOB_SQL}, first, last, duration, gputime_sec, {_MARK}, {_CLASS} FROM jobs")
def jobs(spark, d):
    return job_view(summaries(spark, d), "first", "last", "duration", "gputime_sec", "jobm", "classification")


_LIMITS = dict(min_cpu_peak=150, max_cpu_avg=2000, min_runtime=86400, min_samples=10, max_mem_peak=2000, min_res_avg=1, max_gpu_peak=400)
_LIMITS_SQL = "cpu_peak >= 150 AND cpu_avg <= 2000 AND duration >= 86400 AND n_samples >= 10 AND mem_peak <= 2000 AND res_avg >= 1 AND gpu_peak <= 400"


@query("filter_job_aggregates", o.JOBS + f" SELECT {JOB_SQL} FROM jobs WHERE {_LIMITS_SQL}")
def filter_job_aggregates(spark, d):
    return job_view(filters.filter_job_aggregates(unsorted(spark, d), **_LIMITS))


@query("filter_job_flags", o.JOBS + f" SELECT {IDS_SQL}, gpus, live_at_end FROM jobs WHERE gpus <> 0 AND NOT live_at_end")
def filter_job_flags(spark, d):
    return filters.filter_job_flags(unsorted(spark, d), some_gpu=True, completed=True).select(*ids(), "gpus", "live_at_end")


@query("filter_job_flags_running", o.JOBS + f" SELECT {IDS_SQL}, gpus, live_at_end FROM jobs WHERE gpus = 0 OR live_at_end")
def filter_job_flags_running(spark, d):
    summary = unsorted(spark, d)
    no_gpu = filters.filter_job_flags(summary, no_gpu=True)
    running = filters.filter_job_flags(summary, running=True, some_gpu=True)
    return no_gpu.unionByName(running).select(*ids(), "gpus", "live_at_end")


@query(
    "top_jobs_per_user",
    o.JOBS + f""" SELECT {IDS_SQL}, first FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY first DESC, job DESC, host DESC, solo DESC) AS rn FROM jobs) WHERE rn <= 2""",
)
def top_jobs_per_user(spark, d):
    return j.top_jobs_per_user(unsorted(spark, d), 2).select(*ids(), "first")


# --- configuration ---------------------------------------------------------------------------------

_CFG = o.SAMPLES + o.REPORTS


@query("node_config", _CFG + f" SELECT host, valid_from, description, {CAPS_SQL} FROM config")
def node_config(spark, d):
    return inputs.node_config(spark, d)


@query("config_asof", _CFG + o.asof("samples", "found", keep="l.event_id") + f" SELECT event_id, {CAPS_SQL}, description, config_from FROM found")
def config_asof(spark, d):
    out = config.config_asof(samples(spark, d), inputs.node_config(spark, d), inputs.static_config(spark, d))
    return out.select("event_id", *CAPS, "description", "config_from")


@query(
    "config_merged",
    _CFG + ", sets AS (SELECT job, min(t) AS t FROM samples GROUP BY job), sh AS (SELECT DISTINCT s.job, s.t, x.host FROM sets s JOIN samples x USING (job))"
    + o.asof("sh", "found", keep="l.job", inner=True)
    + " SELECT job, CAST(sum(cores) AS BIGINT) AS cores, CAST(sum(mem_gb) AS BIGINT) AS mem_gb, CAST(sum(gpu_cards) AS BIGINT) AS gpu_cards, CAST(sum(gpumem_gb) AS BIGINT) AS gpumem_gb FROM found GROUP BY job",
)
def config_merged(spark, d):
    sets = samples(spark, d).groupBy("job").agg(F.min("t").alias("t"), F.collect_set("host").alias("hosts"))
    return config.config_merged(sets, inputs.node_config(spark, d), ["job"], inputs.static_config(spark, d))


@query("drop_unconfigured", o.CONFIGURED + " SELECT event_id, host, t FROM conf")
def drop_unconfigured(spark, d):
    return config.drop_unconfigured(clean(spark, d), inputs.node_config(spark, d), inputs.static_config(spark, d)).select("event_id", "host", "t")


@query("newest_per_host", _CFG + f" SELECT host, valid_from, {CAPS_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY valid_from DESC) AS rn FROM config) WHERE rn = 1")
def newest_per_host(spark, d):
    return config.newest_per_host(inputs.node_config(spark, d)).select("host", "valid_from", *CAPS)


_P = (EVENTS_START + 2 * 86400, EVENTS_START + 4 * 86400)


@query(
    "available_hosts",
    _CFG + f", seen AS (SELECT DISTINCT host FROM reports WHERE t BETWEEN {_P[0]} AND {_P[1]}) SELECT host FROM seen UNION SELECT host FROM static WHERE NOT EXISTS (SELECT 1 FROM seen)",
)
def available_hosts(spark, d):
    return config.available_hosts(inputs.nodes(spark, d), inputs.static_config(spark, d), *_P)


@query(
    "config_backfill",
    _CFG + """, newest AS (SELECT * REPLACE (CASE WHEN gpu_cards = 2 THEN 0 ELSE gpu_cards END AS gpu_cards, CASE WHEN host = 'n1' THEN 0 ELSE mem_gb END AS mem_gb)
      FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY valid_from DESC) AS rn FROM config) WHERE rn = 1),
    back AS (SELECT DISTINCT host, 'bg' AS description, 3 AS cores, CASE WHEN host = 'n6' THEN 0 ELSE 5 END AS mem_gb, 1 AS gpu_cards, 7 AS gpumem_gb FROM samples)
    SELECT coalesce(n.host, b.host) AS host, CASE WHEN n.host IS NULL THEN b.description ELSE n.description END AS description,
    CASE WHEN coalesce(n.cores, 0) = 0 THEN b.cores ELSE n.cores END AS cores, CASE WHEN coalesce(n.mem_gb, 0) = 0 THEN b.mem_gb ELSE n.mem_gb END AS mem_gb,
    CASE WHEN coalesce(n.gpu_cards, 0) = 0 THEN b.gpu_cards ELSE n.gpu_cards END AS gpu_cards, CASE WHEN coalesce(n.gpumem_gb, 0) = 0 THEN b.gpumem_gb ELSE n.gpumem_gb END AS gpumem_gb
    FROM newest n FULL JOIN back b ON n.host = b.host WHERE n.host IS NOT NULL OR (b.cores > 0 AND b.mem_gb > 0)""",
)
def config_backfill(spark, d):
    newest = config.newest_per_host(inputs.node_config(spark, d))
    newest = newest.withColumn("gpu_cards", F.expr("IF(gpu_cards = 2, 0, gpu_cards)")).withColumn("mem_gb", F.expr("IF(host = 'n1', 0, mem_gb)"))
    back = samples(spark, d).select("host").distinct().select(
        "host", F.lit("bg").alias("description"), F.lit(3).alias("cores"), F.expr("IF(host = 'n6', 0, 5)").alias("mem_gb"),
        F.lit(1).alias("gpu_cards"), F.lit(7).alias("gpumem_gb"),
    )
    return config.config_backfill(newest, back)


@query("cards_listing", _CFG + " SELECT t, node, index, uuid, model, memory FROM cards WHERE node IN ('n1', 'n2', 'n3') AND memory > 8388608")
def cards_listing(spark, d):
    out = config.cards_listing(inputs.cards(spark, d), EVENTS_START, None, ["n[1-3]"], "memory > 8388608")
    return out.select(F.col("time").alias("t"), "node", "index", "uuid", "model", "memory")


@query("configs_listing", _CFG + f" SELECT host, valid_from, {CAPS_SQL} FROM config WHERE valid_from >= {EVENTS_START + 86400} AND cores > 20")
def configs_listing(spark, d):
    out = config.configs_listing(inputs.node_config(spark, d), EVENTS_START + 86400, condition="cores > 20")
    return out.select("host", "valid_from", *CAPS)


def clusters(spark, d):
    """A cluster per host parity, its excluded users taken from the data."""
    s = samples(spark, d).withColumn("cluster", F.concat(F.lit("c"), (F.col("epoch")).cast("string")))
    return s.groupBy("cluster").agg(
        F.array_sort(F.collect_set(F.when(F.col("job").isin(3, 4) & (F.col("pid") < 1100), F.col("user")))).alias("exclude_users"),
        F.countDistinct("host").alias("n_hosts"),
    )


@query(
    "clusters_listing",
    o.SAMPLES + """ SELECT 'c' || CAST(epoch AS VARCHAR) AS cluster, count(DISTINCT host) AS n_hosts,
    array_to_string(list_sort(list(DISTINCT "user") FILTER (WHERE job IN (3, 4) AND pid < 1100)), ',') AS exclude_users FROM samples GROUP BY epoch""",
)
def clusters_listing(spark, d):
    return config.clusters_listing(clusters(spark, d)).select("cluster", "n_hosts", F.array_join("exclude_users", ",").alias("exclude_users"))


def cluster_state(spark, d):
    """Nested partition and node state per day."""
    day = samples(spark, d).select((F.col("t") - F.col("t") % 86400).alias("t"), "host", "cmd", F.concat(F.lit("c"), F.col("epoch").cast("string")).alias("cluster"))
    from usagelens.functions.scalars import format_time

    parts = day.groupBy("t", "cluster", "cmd").agg(F.array_sort(F.collect_set("host")).alias("nodes"))
    partitions = parts.groupBy("t", "cluster").agg(F.collect_list(F.struct(F.col("cmd").alias("name"), "nodes")).alias("partitions"))
    states = day.groupBy("t", "cluster", "host").agg(F.array_sort(F.collect_set("cmd")).alias("states"))
    nodes = states.groupBy("t", "cluster").agg(F.collect_list(F.struct(F.array("host").alias("names"), "states")).alias("nodes"))
    return partitions.withColumn("time", format_time("t", "iso")), nodes.withColumn("time", format_time("t", "iso"))


_ISO = "strftime(to_timestamp(t - t % 86400) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS time"
_CL = "'c' || CAST(epoch AS VARCHAR) AS cluster"


@query("partition_rows", o.SAMPLES + f" SELECT {_ISO}, {_CL}, cmd AS partition, array_to_string(list_sort(list(DISTINCT host)), ',') AS nodes FROM samples GROUP BY 1, 2, 3")
def partition_rows(spark, d):
    return config.partition_rows(cluster_state(spark, d)[0]).withColumn("nodes", F.array_join("nodes", ","))


@query("node_state_rows", o.SAMPLES + f" SELECT {_ISO}, {_CL}, host AS nodes, array_to_string(list_sort(list(DISTINCT cmd)), ',') AS states FROM samples GROUP BY 1, 2, 3")
def node_state_rows(spark, d):
    out = config.node_state_rows(cluster_state(spark, d)[1])
    return out.withColumn("nodes", F.array_join("nodes", ",")).withColumn("states", F.array_join("states", ","))


# --- relative values -------------------------------------------------------------------------------

_REL = [f"{k}_{s}" for k in ("rcpu", "rmem", "rres", "rgpu", "rgpumem", "sgpu", "sgpumem") for s in ("avg", "peak")]


def _relative_sql() -> str:
    def share(v, cap, f):
        return f"CASE WHEN coalesce({cap}, 0) > 0 THEN {v} * {f} / {cap} ELSE 0.0::DOUBLE END"

    cols = []
    for s in ("avg", "peak"):
        cols += [
            (f"rcpu_{s}", share(f"cpu_{s}", "cores", "1e0")), (f"rmem_{s}", share(f"mem_{s}", "mem_gb", "1e2")),
            (f"rres_{s}", share(f"res_{s}", "mem_gb", "1e2")), (f"rgpu_{s}", share(f"gpu_{s}", "gpu_cards", "1e0")),
            (f"rgpumem_{s}", share(f"gpumem_{s}", "gpumem_gb", "1e2")),
            (f"sgpu_{s}", f"CASE WHEN gpus <> 0 AND gpus <> 2147483648 AND cores IS NOT NULL THEN gpu_{s} / bit_count(gpus) ELSE 0.0::DOUBLE END"),
            (f"sgpumem_{s}", f"CASE WHEN gpus <> 0 AND gpus <> 2147483648 AND gpu_cards > 0 AND gpumem_gb > 0 THEN gpumem_{s} * 100 / (bit_count(gpus) * gpumem_gb / gpu_cards) ELSE 0.0::DOUBLE END"),
        ]
    return ", ".join(f"{R(e)} AS {n}" for n, e in cols)


RELATIVE_JOBS = (
    o.CONFIGURED_JOBS
    + ", jh AS (SELECT host AS jhost, job, solo, first, unnest(hosts) AS host FROM jobs)"
    + o.asof("jh", "jcap", "first", keep="l.jhost, l.job, l.solo", inner=True)
    + ", cap AS (SELECT jhost, job, solo, CAST(sum(cores) AS BIGINT) AS cores, CAST(sum(mem_gb) AS BIGINT) AS mem_gb, CAST(sum(gpu_cards) AS BIGINT) AS gpu_cards, CAST(sum(gpumem_gb) AS BIGINT) AS gpumem_gb FROM jcap GROUP BY 1, 2, 3)"
    + ", rjobs AS (SELECT a.*, b.cores, b.mem_gb, b.gpu_cards, b.gpumem_gb FROM jobs a LEFT JOIN cap b ON a.host IS NOT DISTINCT FROM b.jhost AND a.job = b.job AND a.solo IS NOT DISTINCT FROM b.solo)"
    + f", rel AS (SELECT *, {_relative_sql()} FROM rjobs)"
)


def relative(spark, d, **kw):
    return unsorted(spark, d, node_config=inputs.node_config(spark, d), static=inputs.static_config(spark, d), **kw)


@query("job_relative", RELATIVE_JOBS + f" SELECT {IDS_SQL}, {', '.join(_REL)} FROM rel")
def job_relative(spark, d):
    return relative(spark, d).select(*ids(), *[rounded(c).alias(c) for c in _REL])


# --- accounting ------------------------------------------------------------------------------------


def sacct_mains(spark, d):
    return accounting.sacct_jobs(accounting.sacct_dedup(inputs.sacct(spark, d)))


SACCT_BASE = ["job_id", "user", "account", "state", "partition", "elapsed", "req_mem", "start"]
SACCT_BASE_SQL = 'job_id, "user", account, state, "partition", elapsed, req_mem, start'


@query("sacct_dedup", o.ACCOUNTING + ' SELECT job_id, job_step, "user", state, max_rss, t FROM records')
def sacct_dedup(spark, d):
    raw = inputs.sacct(spark, d)
    older = raw.filter("job_id % 3 = 0").withColumn("t", F.col("t") - 5).withColumn("state", F.lit("RUNNING"))
    earlier_state = raw.filter("job_id % 4 = 0 AND state NOT IN ('PENDING', '')").withColumn("state", F.lit("PENDING"))
    everything = raw.unionByName(older).unionByName(earlier_state)
    return accounting.sacct_dedup(everything).select("job_id", "job_step", "user", "state", "max_rss", "t")


@query("sacct_jobs", o.ACCOUNTING + f" SELECT {SACCT_BASE_SQL}, n_steps, job_max_rss FROM sjobs")
def sacct_jobs(spark, d):
    return sacct_mains(spark, d).select(*SACCT_BASE, "n_steps", "job_max_rss")


@query("sacct_steps", o.ACCOUNTING + " SELECT r.job_id, r.job_step, r.max_rss FROM records r JOIN sjobs s ON r.job_id = s.job_id AND r.job_step <> s.job_step")
def sacct_steps(spark, d):
    records = accounting.sacct_dedup(inputs.sacct(spark, d))
    return accounting.sacct_steps(records, accounting.sacct_jobs(records)).select("job_id", "job_step", "max_rss")


REPORT_COLS = ["requested_cpu", "used_cpu", "rcpu", "rmem", "wait"]


@query("sacct_report", o.ACCOUNTING + f" SELECT {SACCT_BASE_SQL}, {', '.join(REPORT_COLS)} FROM report")
def sacct_report(spark, d):
    return accounting.sacct_report(sacct_mains(spark, d)).select(*SACCT_BASE, *REPORT_COLS)


@query("sacct_split", o.ACCOUNTING + " SELECT job_id, CASE WHEN array_job_id <> 0 THEN 'array' WHEN het_job_id <> 0 THEN 'het' ELSE 'regular' END AS kind FROM sjobs")
def sacct_split(spark, d):
    mains = sacct_mains(spark, d)
    parts = [accounting.sacct_split(mains, k).select("job_id", F.lit(k).alias("kind")) for k in ("array", "het", "regular")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("sacct_arrays", o.ACCOUNTING + ' SELECT array_job_id, count(*) AS elements, arg_min("user", job_id) AS "user", arg_min(state, job_id) AS state FROM sjobs WHERE array_job_id <> 0 GROUP BY array_job_id')
def sacct_arrays(spark, d):
    return accounting.sacct_arrays(sacct_mains(spark, d))[0]


@query("sacct_array_members", o.ACCOUNTING + " SELECT array_job_id, job_id, rcpu, rmem FROM report WHERE array_job_id <> 0")
def sacct_array_members(spark, d):
    return accounting.sacct_arrays(sacct_mains(spark, d))[1].select("array_job_id", "job_id", "rcpu", "rmem")


@query(
    "filter_sacct",
    o.ACCOUNTING + f""" SELECT {SACCT_BASE_SQL} FROM sjobs WHERE state IN ('COMPLETED', 'TIMEOUT') AND account IN ('a1', 'a2', 'a3')
    AND "partition" IN ('5-LOW', '1-URGENT') AND starts_with(req_gpus, 'a100') AND req_gpus <> '' AND elapsed >= 600 AND elapsed <= 80000""",
)
def filter_sacct(spark, d):
    return filters.filter_sacct(
        sacct_mains(spark, d), states=["COMPLETED", "TIMEOUT"], accounts=["a1", "a2", "a3"], partitions=["5-LOW", "1-URGENT"],
        gpu_types=["a100"], some_gpu=True, min_runtime=600, max_runtime=80000,
    ).select(*SACCT_BASE)


@query("filter_sacct_job", o.ACCOUNTING + f" SELECT {SACCT_BASE_SQL} FROM sjobs WHERE job_id IN (260, 340, 7) OR array_job_id IN (260, 340, 7) OR het_job_id IN (260, 340, 7)")
def filter_sacct_job(spark, d):
    return filters.filter_sacct(sacct_mains(spark, d), job_ids=[260, 340, 7]).select(*SACCT_BASE)


@query("filter_sacct_hosts", o.ACCOUNTING + " SELECT job_id, node_list FROM sjobs WHERE job_id % 4 IN (0, 3)")
def filter_sacct_hosts(spark, d):
    return filters.filter_sacct_hosts(sacct_mains(spark, d), ["n0", "n5*"]).select("job_id", "node_list")


@query("filter_reserved", o.ACCOUNTING + f" SELECT {SACCT_BASE_SQL} FROM sjobs WHERE req_mem >= 10 * 1048576 AND req_mem <= 30 * 1048576 AND req_cpus * req_nodes BETWEEN 16 AND 100")
def filter_reserved(spark, d):
    return filters.filter_reserved(sacct_mains(spark, d), 10, 30, 16, 100).select(*SACCT_BASE)


@query(
    "synth_accounting",
    o.JOBS + f""", tasks AS (
      SELECT CASE WHEN job <> 0 AND epoch = 0 THEN NULL ELSE host END AS mh, job, {o.SOLO} AS solo, host, pid, cmd,
        arg_max(cputime_sec, t) AS cpu, CAST(sum(rss_kb) AS BIGINT) // count(*) AS rss, CAST(sum(cpu_kb) AS BIGINT) // count(*) AS vm,
        max(rss_kb) AS max_rss, max(cpu_kb) AS max_vm FROM clean GROUP BY 1, 2, 3, 4, 5, 6),
    per AS (SELECT mh AS host, job, solo, min(cpu) AS min_cpu, CAST(sum(rss) AS BIGINT) // count(*) AS ave_rss, CAST(sum(vm) AS BIGINT) // count(*) AS ave_vmsize,
        max(max_rss) AS max_rss, max(max_vm) AS max_vmsize, count(*) AS n FROM tasks GROUP BY 1, 2, 3)
    SELECT job, array_to_string(hosts, ',') AS hosts, CASE WHEN live_at_end THEN 'RUNNING' ELSE 'COMPLETED' END AS state, "user" || ': ' || cmd AS job_name,
      duration AS elapsed, cputime_sec // n AS ave_cpu, read_kb // n AS ave_disk_read, min_cpu, ave_rss, ave_vmsize, max_rss, max_vmsize, threads_peak AS req_cpus,
      CASE WHEN gpus = 2147483648 THEN '*=1' WHEN gpus <> 0 THEN '*=' || CAST(bit_count(gpus) AS VARCHAR) ELSE '' END AS req_gpus
    FROM jobs a JOIN per b ON {o.ON_JOB}""".replace("SELECT job, array", "SELECT a.job, array"),
)
def synth_accounting(spark, d):
    out = j.synth_accounting(unsorted(spark, d), clean(spark, d))
    return out.select(
        "job", F.array_join("hosts", ",").alias("hosts"), "state", "job_name", "elapsed", "ave_cpu", "ave_disk_read", "min_cpu",
        "ave_rss", "ave_vmsize", "max_rss", "max_vmsize", "req_cpus", "req_gpus",
    )


@query(
    "attach_accounting",
    o.JOBS + o.ACCOUNTING.replace("WITH sacct", ", sacct", 1) + f""" SELECT a.job, array_to_string(a.hosts, ',') AS hosts, a."user", a.cmd, s.account, s.state
    FROM jobs a LEFT JOIN sjobs s ON a.job = s.job_id WHERE s.job_id IS NULL OR s.state IN ('COMPLETED', 'RUNNING')""",
)
def attach_accounting(spark, d):
    out = j.attach_accounting(unsorted(spark, d), sacct_mains(spark, d), {"states": ["COMPLETED", "RUNNING"]})
    return out.select(*ids(), F.col("accounting.account").alias("account"), F.col("accounting.state").alias("state"))


@query(
    "alloc_log",
    o.ACCOUNTING + """ SELECT job_id, job_step, state, CASE WHEN contains("partition", 'accel') THEN 'accel' WHEN "partition" = '' THEN '' ELSE 'other' END AS "partition",
    TRY_CAST(nullif(regexp_extract(alloc_res, 'cpu=([0-9]+)', 1), '') AS BIGINT) AS cpus,
    TRY_CAST(nullif(regexp_extract(alloc_res, 'gres/gpu[^=]*=([0-9]+)', 1), '') AS BIGINT) AS gpus,
    CASE WHEN contains(alloc_res, 'gres/gpu:a100') THEN 'a100' WHEN contains(alloc_res, 'gres/gpu=') AND job_id % 4 = 1 THEN 'h100' ELSE '' END AS gpu_type
    FROM records WHERE state NOT IN ('RUNNING', 'PENDING') AND job_step NOT IN ('interactive', 'batch', 'extern')""",
)
def alloc_log(spark, d):
    records = accounting.sacct_dedup(inputs.sacct(spark, d))
    kinds = records.filter("node_list LIKE 'n[1-%'").select(F.col("node_list").alias("node"), F.lit("h100").alias("kind")).distinct()
    return accounting.alloc_log(records, kinds).select("job_id", "job_step", "state", "partition", "cpus", "gpus", "gpu_type")


