"""Queries on filters, streams and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.operators import filters, merge, streams
from usagelens.plans import oracle as o
from usagelens.plans.driver_tables import EVENTS_START, samples
from usagelens.plans.inputs import CLUSTER, clean, clean_dense
from usagelens.plans.registry import query, rounded, sql_round

R = sql_round
FROM, TO = EVENTS_START + 5 * 86400, EVENTS_START + 12 * 86400 - 1
BASIC = ["event_id", "t", "host", "user", "job", "cmd"]
BASIC_SQL = 'event_id, t, host, "user", job, cmd'


@query(
    "filter_samples",
    o.SAMPLES + f""" SELECT {BASIC_SQL} FROM samples WHERE job IN (1, 2, 3, 10, 20, 30) AND "user" NOT IN ('u1', 'u10')
    AND cmd <> 'signup' AND regexp_matches(host, '^n[1-6]$') AND pid >= 1002 AND t BETWEEN {FROM} AND {TO}""",
)
def filter_samples(spark, d):
    return filters.filter_samples(
        samples(spark, d), jobs=[1, 2, 3, 10, 20, 30], exclude_users=["u1", "u10"], exclude_commands=["signup"],
        hosts=["n[1-6]"], min_pid=1002, from_t=FROM, to_t=TO,
    ).select(*BASIC)


def _as_system(df):
    """Some streams renamed to what the default exclusions look for."""
    cmd = F.when(F.col("cmd") == "click", "bash").when(F.col("cmd") == "view", "_heartbeat_").otherwise(F.col("cmd"))
    user = F.when(F.col("job") == 5, "root").otherwise(F.col("user"))
    return df.withColumn("cmd", cmd).withColumn("user", user).withColumn("cluster", F.lit(CLUSTER))


@query(
    "system_exclusions",
    o.SAMPLES + f""" SELECT {BASIC_SQL} FROM samples WHERE job <> 5 AND cmd NOT IN ('click', 'view') AND pid >= 1000
    AND "user" NOT IN (SELECT DISTINCT "user" FROM samples WHERE job = 7 AND pid < 1100)""",
)
def system_exclusions(spark, d):
    df = _as_system(samples(spark, d))
    excluded = df.filter("job = 7 AND pid < 1100").groupBy("cluster").agg(F.collect_set("user").alias("exclude_users"))
    return filters.system_exclusions(df, system_jobs=True, clusters=excluded).select(*BASIC)


@query("default_filters", o.SAMPLES + f" SELECT {BASIC_SQL} FROM samples WHERE cmd NOT IN ('click', 'view') AND job IN (4, 5, 6) AND job <> 5")
def default_filters(spark, d):
    criteria = filters.default_filters("jobs", filters.Criteria(jobs=[4, 5, 6]))
    return filters.apply_criteria(_as_system(samples(spark, d)), criteria).select(*BASIC)


@query("filter_time_host", o.SAMPLES + f" SELECT event_id, t, host FROM samples WHERE t BETWEEN {FROM} AND {TO} AND host IN ('n0', 'n3')")
def filter_time_host(spark, d):
    return filters.filter_time_host(samples(spark, d), FROM, TO, ["n0", "n3"]).select("event_id", "t", "host")


@query("where", o.SAMPLES + " SELECT event_id, cpu_pct, cmd FROM samples WHERE (cpu_pct >= 20 AND regexp_matches(cmd, 'i.w$')) OR NOT gpus <= 8")
def where(spark, d):
    df = filters.where(samples(spark, d), "(cpu_pct >= 20 AND cmd RLIKE 'i.w$') OR NOT gpus <= 8")
    return df.select("event_id", "cpu_pct", "cmd")


_SHOWN = "((cputime_sec + 30) // 60)"


@query(
    "where_typed",
    o.SAMPLES + f""" SELECT event_id FROM samples WHERE (regexp_matches(({_SHOWN} // 1440) || 'd' || (({_SHOWN} // 60) % 24) || 'h' || ({_SHOWN} % 60) || 'm', '^0d[0-9]+h1')
    OR cputime_sec >= 5400) AND host IN ('n1', 'n2', 'n3', 'n5') AND NOT (gpus < 2147483648 AND gpus & 2 = 2) AND t >= {EVENTS_START + 2 * 86400} AND cpu_pct < 90.5""",
)
def where_typed(spark, d):
    """A match on a shown duration, and comparisons of a duration, a host set, a GPU set, a time and a number."""
    c = filters.field_condition
    shown = c("cputime_sec", "match", "^0d[0-9]+h1", "duration") | c("cputime_sec", ">=", "1h30m", "duration")
    sets = c("members", "<=", "n[1-3],n5", "hosts") & ~c("gpus", ">=", "1", "gpus")
    rest = c("t", ">=", "2024-01-03 00:00", "time") & c("cpu_pct", "<", "90.5", "number")
    return filters.where(samples(spark, d).withColumn("members", F.array("host")), shown & sets & rest).select("event_id")


_ROLLED = "CASE WHEN event_id % 4 = 0 THEN 0 ELSE pid END"


@query(
    "stream_key",
    o.SAMPLES + f""" SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 8 = 0 THEN 10000000 + job
    WHEN event_id % 4 = 0 THEN 0 ELSE pid END AS stream_id FROM samples""",
)
def stream_key(spark, d):
    df = samples(spark, d).withColumn("pid", F.expr(_ROLLED)).withColumn("rolledup", F.expr("IF(event_id % 8 = 0, 3, 0)"))
    return streams.stream_key(df).select("event_id", "stream_id")


def _coarse(df):
    """Many samples of a stream at the same hour, so that there is something to drop."""
    return df.withColumn("t", F.col("t") - F.col("t") % 21600)


@query(
    "dedup_streams",
    o.SAMPLES + """ SELECT event_id, host, pid AS stream_id, cmd, t6 AS t FROM (
    SELECT *, t - t % 21600 AS t6, row_number() OVER (PARTITION BY host, pid, cmd, t - t % 21600 ORDER BY event_id) AS rn FROM samples) WHERE rn = 1""",
)
def dedup_streams(spark, d):
    return streams.dedup_streams(_coarse(samples(spark, d)), ["event_id"]).select("event_id", "host", "stream_id", "cmd", "t")


@query("cpu_util", o.CLEAN + f" SELECT event_id, host, pid, cmd, t, {R('cpu_util_pct')} AS cpu_util_pct, is_first, is_last, prev_t FROM clean")
def cpu_util(spark, d):
    return clean(spark, d).select(
        "event_id", "host", "pid", "cmd", "t", rounded("cpu_util_pct").alias("cpu_util_pct"), "is_first", "is_last", "prev_t"
    )


@query("host_bounds", o.SAMPLES + " SELECT host, min(t) AS earliest, max(t) AS latest FROM samples GROUP BY host")
def host_bounds(spark, d):
    return streams.host_bounds(samples(spark, d))


@query(
    "merged_bounds",
    o.CLEAN + """, b AS (SELECT host, min(t) AS earliest, max(t) AS latest FROM samples GROUP BY host)
    SELECT job, min(earliest) AS earliest, max(latest) AS latest FROM (SELECT DISTINCT job, host FROM clean) JOIN b USING (host) GROUP BY job""",
)
def merged_bounds(spark, d):
    sets = clean(spark, d).groupBy(F.col("stream_job").alias("job")).agg(F.collect_set("host").alias("hosts"))
    return streams.merged_bounds(streams.host_bounds(samples(spark, d)), sets, ["job"])


@query("interval_bounds", o.SAMPLES + f" SELECT {FROM} AS from_t, max(t) AS to_t FROM samples")
def interval_bounds(spark, d):
    return streams.interval_bounds(streams.host_bounds(samples(spark, d)), from_t=FROM)


@query(
    "last_n",
    o.CLEAN + """ SELECT event_id, host, pid, cmd, t FROM (SELECT *, row_number() OVER (PARTITION BY host, pid, cmd ORDER BY t DESC) AS rn FROM clean) WHERE rn <= 3""",
)
def last_n(spark, d):
    return streams.last_n(clean(spark, d), 3).select("event_id", "host", "pid", "cmd", "t")


@query("export_samples_raw", o.SAMPLES + f" SELECT {BASIC_SQL}, cpu_kb, gpus FROM samples")
def export_samples_raw(spark, d):
    return streams.export_samples(samples(spark, d), "raw").select(*BASIC, "cpu_kb", "gpus")


@query("export_samples_clean", o.CLEAN + f" SELECT {BASIC_SQL}, stream_start, {R('cpu_util_pct')} AS cpu_util_pct FROM clean")
def export_samples_clean(spark, d):
    df = streams.export_samples(samples(spark, d), "clean", ["event_id"])
    return df.select(*BASIC, "stream_start", rounded("cpu_util_pct").alias("cpu_util_pct"))


STEP_COLS = [
    "t", "cpu_kb", "rss_kb", "gpu_kb", "cputime_sec", "threads", "data_read_kb", "data_written_kb", "gpus", "gpu_fail", "n_selected",
]
STEP_SQL = ", ".join(STEP_COLS)


def step_view(df, *keys):
    return df.select(
        *keys, *STEP_COLS, rounded("cpu_pct").alias("cpu_pct"), rounded("cpu_util_pct").alias("cpu_util_pct"),
        rounded("gpu_pct").alias("gpu_pct"),
    )


def step_sql(keys: str, relation: str = "steps") -> str:
    return f" SELECT {keys}, {STEP_SQL}, {R('cpu_pct')} AS cpu_pct, {R('cpu_util_pct')} AS cpu_util_pct, {R('gpu_pct')} AS gpu_pct FROM {relation}"


@query("export_samples_merged", o.CLEAN + o.job_steps("FALSE") + f""" SELECT a.host, a.job, b.cmd, a.t, a.cpu_kb FROM steps a JOIN names b ON {o.ON_JOB}""")
def export_samples_merged(spark, d):
    return streams.export_samples(samples(spark, d), "merged", ["event_id"]).select("host", "job", "cmd", "t", "cpu_kb")


# Every stream keeps its own offset in the 10 s grid, so steps hold several instants of different streams.
_DENSE_STEPS = (
    o.SAMPLES.replace("WITH", "WITH RECURSIVE", 1) + o._DENSE + o._clean("dense") + """,
times AS (SELECT DISTINCT host, t FROM clean),
fold AS (
  SELECT host, min(t) AS step FROM times GROUP BY host
  UNION ALL
  SELECT f.host, (SELECT min(t) FROM times x WHERE x.host = f.host AND x.t >= f.step + 10) AS step FROM fold f WHERE f.step IS NOT NULL),
assigned AS (SELECT x.host, x.t, max(f.step) AS step FROM times x JOIN fold f ON f.host = x.host AND f.step <= x.t GROUP BY 1, 2)"""
    + o.steps({"host": "host"}, assigned="assigned")
)


@query("merge_streams", _DENSE_STEPS + step_sql("host"))
def merge_streams(spark, d):
    return step_view(merge.merge_streams(clean_dense(spark, d), ["host"]), "host")


@query("merge_by_host_job", o.CLEAN + o.job_steps("FALSE") + f""", s AS (SELECT a.*, b.cmd, b."user" FROM steps a JOIN names b ON {o.ON_JOB})""" + step_sql('host, job, cmd, "user"', "s"))
def merge_by_host_job(spark, d):
    return step_view(merge.merge_by_host_job(clean(spark, d)), "host", "job", "cmd", "user")


_HOSTS = "array_to_string(b.hosts, ',') AS hosts"


@query("merge_by_job", o.CLEAN + o.job_steps("TRUE") + f""", s AS (SELECT a.*, b.cmd, {_HOSTS} FROM steps a JOIN names b ON {o.ON_JOB})""" + step_sql("job, cmd, hosts", "s"))
def merge_by_job(spark, d):
    return step_view(merge.merge_by_job(clean(spark, d)), "job", "cmd", F.array_join("hosts", ",").alias("hosts"))


@query("merge_by_epoch", o.EPOCH_STEPS + f""", s AS (SELECT a.*, b.cmd, {_HOSTS} FROM steps a JOIN names b ON {o.ON_JOB})""" + step_sql("job, cmd, hosts", "s"))
def merge_by_epoch(spark, d):
    return step_view(merge.merge_by_epoch(clean(spark, d)), "job", "cmd", F.array_join("hosts", ",").alias("hosts"))


@query("merge_by_host", o.HOST_STEPS + step_sql("host, '_merged_' AS cmd"))
def merge_by_host(spark, d):
    return step_view(merge.merge_by_host(clean(spark, d)), "host", "cmd")


@query(
    "merge_across_hosts",
    o.HOST_STEPS + """, series AS (SELECT *, lead(t) OVER (PARTITION BY host ORDER BY t) IS NULL AS is_last, 0 AS g FROM steps)"""
    + o.steps({"g": "g"}, "series", "across") + step_sql("0 AS g", "across"),
)
def merge_across_hosts(spark, d):
    df = merge.merge_across_hosts(merge.merge_by_host(clean(spark, d)), folded=False)
    return step_view(df.withColumn("g", F.lit(0)), "g")


WIDTH = {"half-hour": 1800, "hour": 3600, "half-day": 43200, "day": 86400}
FOLD_SELECT = f"""{R('avg(cpu_util_pct)')} AS cpu_util_pct, {R('avg(gpu_pct)')} AS gpu_pct,
  CAST(sum(cpu_kb) AS BIGINT) // count(*) AS cpu_kb, CAST(sum(rss_kb) AS BIGINT) // count(*) AS rss_kb,
  CAST(sum(gpu_kb) AS BIGINT) // count(*) AS gpu_kb, CAST(sum(cputime_sec) AS BIGINT) // count(*) AS cputime_sec,
  CAST(sum(threads) AS BIGINT) AS threads, CAST(sum(data_read_kb) AS BIGINT) AS data_read_kb, {o.unknown_absorbs('gpus')} AS gpus"""
FOLD_COLS = ["cpu_kb", "rss_kb", "gpu_kb", "cputime_sec", "threads", "data_read_kb", "gpus"]


def fold_view(df, *keys):
    return df.select(*keys, "t", *FOLD_COLS, rounded("cpu_util_pct").alias("cpu_util_pct"), rounded("gpu_pct").alias("gpu_pct"))


@query("fold_time", o.HOST_STEPS + f" SELECT host, t - t % 43200 AS t, {FOLD_SELECT} FROM steps GROUP BY host, t - t % 43200")
def fold_time(spark, d):
    return fold_view(merge.fold_time(merge.merge_by_host(clean(spark, d)), "half-day", ["host"]), "host")


@query("fold_time_week", o.HOST_STEPS + f" SELECT host, t - (t - 345600) % 604800 AS t, {FOLD_SELECT} FROM steps GROUP BY 1, 2")
def fold_time_week(spark, d):
    return fold_view(merge.fold_time(merge.merge_by_host(clean(spark, d)), "week", ["host"]), "host")


@query(
    "fill_gaps",
    o.HOST_STEPS + f""", folded AS (SELECT host, t - t % 1800 AS t, {FOLD_SELECT} FROM steps GROUP BY host, t - t % 1800),
    ends AS (SELECT min(t) - min(t) % 1800 AS lo, max(t) - max(t) % 1800 AS hi FROM samples),
    grid AS (SELECT host, unnest(range(lo, hi + 1, 1800)) AS t FROM (SELECT DISTINCT host FROM folded), ends)
    SELECT host, t, {', '.join(f'coalesce({c}, 0) AS {c}' for c in FOLD_COLS + ['cpu_util_pct', 'gpu_pct'])} FROM grid LEFT JOIN folded USING (host, t)""",
)
def fill_gaps(spark, d):
    folded = merge.fold_time(merge.merge_by_host(clean(spark, d)), "half-hour", ["host"])
    interval = streams.interval_bounds(streams.host_bounds(samples(spark, d)))
    return fold_view(merge.fill_gaps(folded, "half-hour", interval, ["host"]), "host")
