"""Queries on violations, the at-a-glance report and usage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.operators import accounting, config, glance, jobs as j, profile as pr, usage_reports as x, violations as v
from usagelens.operators.filters import Criteria
from usagelens.plans import inputs
from usagelens.plans import oracle as o
from usagelens.plans.catalog_jobs import IDS_SQL, RELATIVE_JOBS, ids, relative, sacct_mains, unsorted
from usagelens.plans.catalog_time import LOAD_HOUR, TO, UPTIME, _BUCKETED, _load, load_by, load_rollups, profiles, uptime_lines
from usagelens.plans.driver_tables import EVENTS_START, samples
from usagelens.plans.registry import ORACLE, query, rounded, sql_round

R = sql_round
DAY = 86400

# --- violations ------------------------------------------------------------------------------------


@query("cpu_hogs", RELATIVE_JOBS + f" SELECT {IDS_SQL}, {R('rcpu_peak')} AS rcpu_peak, duration FROM rel WHERE rcpu_peak >= 10 AND duration >= 600 AND (job % 2 = 1 OR gpus = 0) AND last >= {TO}")
def cpu_hogs(spark, d):
    """Jobs with odd numbers are taken to use no GPU."""
    df = samples(spark, d).withColumn("gpus", F.when(F.col("job") % 2 == 1, 0).otherwise(F.col("gpus")))
    summary = j.jobs(
        df, inputs.node_config(spark, d), inputs.static_config(spark, d), criteria=Criteria(all_users=True), tie=["event_id"], sort=False
    )
    return v.cpu_hogs(summary, TO).select(*ids(), rounded("rcpu_peak").alias("rcpu_peak"), "duration")


@query("deadweight_jobs", o.JOBS + f" SELECT {IDS_SQL} FROM jobs WHERE contains(cmd, 'error')")
def deadweight_jobs(spark, d):
    df = samples(spark, d).withColumn("cmd", F.when(F.col("cmd") == "error", "error <defunct>").otherwise(F.col("cmd")))
    summary = j.jobs(df, criteria=Criteria(all_users=True), tie=["event_id"], sort=False)
    return v.deadweight_jobs(summary).withColumn("cmd", F.replace("cmd", F.lit(" <defunct>"))).select(*ids())


def violation_log(spark, d):
    """Twice-daily reports of the jobs with errors in that half-day."""
    return samples(spark, d).filter("cmd = 'error'").select(
        (F.col("t") - F.col("t") % 43200 + 43200).alias("now"), F.col("job").alias("id"), "host", "user", "cmd", F.col("t").alias("start"),
        (F.col("t") + 100).alias("end"), F.col("cpu_pct").alias("cpu_peak"), (F.col("cpu_pct") / 2).alias("rcpu_avg"),
    )


_LOG = """,
vlog AS (SELECT t - t % 43200 + 43200 AS now, job AS id, host, "user", cmd, t AS start, t + 100 AS "end", cpu_pct AS cpu_peak, cpu_pct / 2 AS rcpu_avg FROM samples WHERE cmd = 'error')"""


def _runs(name: str, where: str = "TRUE") -> str:
    return f""",
{name}_once AS (SELECT host, id, now, max("user") AS "user", min(start) AS start, max("end") AS "end", max(cpu_peak) AS cpu_peak, max(rcpu_avg) AS rcpu_avg FROM vlog WHERE {where} GROUP BY host, id, now),
{name}_isl AS (SELECT *, dense_rank() OVER (PARTITION BY host ORDER BY now) - row_number() OVER (PARTITION BY host, id ORDER BY now) AS isl FROM {name}_once),
{name} AS (SELECT *, row_number() OVER (PARTITION BY host, id ORDER BY last_seen DESC) > 1 AS expired FROM (
  SELECT host, id, arg_max("user", now) AS "user", min(now) AS first_seen, max(now) AS last_seen, min(start) AS start, max("end") AS "end", max(cpu_peak) AS cpu_peak, max(rcpu_avg) AS rcpu_avg
  FROM {name}_isl GROUP BY host, id, isl))"""


# In the islands the ranks are those of the distinct report times of a host.
_RUNS = o.SAMPLES + _LOG + _runs("runs")


@query("consolidate_runs", _RUNS + ' SELECT host, id, "user", first_seen, last_seen, start, "end", cpu_peak, rcpu_avg, expired FROM runs')
def consolidate_runs(spark, d):
    return v.consolidate_runs(violation_log(spark, d)).drop("cmd")


SPLIT, BACK = EVENTS_START + 10 * DAY, EVENTS_START + 9 * DAY
NOW1, NOW2 = SPLIT, EVENTS_START + 30 * DAY
_SEEN = "CASE WHEN {e} THEN {t}.last_seen ELSE -1 END"


def _merge(new: str, state: str, runs: str, now: int) -> str:
    return f""",
{new} AS (
  SELECT coalesce(s.id, r.id) AS id, coalesce(s.host, r.host) AS host,
         CASE WHEN s.id IS NOT NULL THEN s.started_on_or_before ELSE r.start END AS started_on_or_before,
         CASE WHEN s.id IS NOT NULL THEN s.first_violation ELSE {now} END AS first_violation,
         coalesce(r.last_seen, s.last_seen) AS last_seen, coalesce(s.is_reported, FALSE) AS is_reported, coalesce(s.is_expired, r.expired) AS is_expired
  FROM {state} s FULL JOIN {runs} r ON s.id = r.id AND s.host = r.host
    AND {_SEEN.format(e='s.is_expired', t='s')} = {_SEEN.format(e='r.expired', t='r')})"""


_STATE = (
    o.SAMPLES + _LOG + _runs("runs1", f"now < {SPLIT}") + _runs("runs2", f"now >= {BACK}")
    + ", state0 AS (SELECT id, host, start AS started_on_or_before, 0 AS first_violation, last_seen, FALSE AS is_reported, expired AS is_expired FROM runs1 WHERE FALSE)"
    + _merge("state1", "state0", "runs1", NOW1)
    + ", reported1 AS (SELECT * REPLACE (TRUE AS is_reported) FROM state1)"
    + _merge("state2", "reported1", "runs2", NOW2)
)


def _state(spark, d):
    log = violation_log(spark, d)
    runs1 = v.consolidate_runs(log.filter(F.col("now") < SPLIT))
    runs2 = v.consolidate_runs(log.filter(F.col("now") >= BACK))
    state1 = v.merge_state(v.read_state(spark, ""), runs1, NOW1)
    state1 = v.mark_reported(state1, v.new_violations(state1, runs1))
    return v.merge_state(state1, runs2, NOW2), runs2


_STATE_COLS = "id, host, started_on_or_before, first_violation, last_seen, is_reported, is_expired"


@query("merge_state", _STATE + f" SELECT {_STATE_COLS} FROM state2")
def merge_state(spark, d):
    return _state(spark, d)[0]


_CUT = EVENTS_START + 8 * DAY


@query("purge_state", _STATE + f" SELECT {_STATE_COLS} FROM state2 WHERE NOT (is_reported AND last_seen < {_CUT})")
def purge_state(spark, d):
    return v.purge_state(_state(spark, d)[0], v.purge_cutoff(_CUT, NOW2))


_NEW = f"SELECT s.id, s.host, s.first_violation, r.last_seen, r.\"user\", r.cpu_peak FROM state2 s JOIN runs2 r ON s.id = r.id AND s.host = r.host AND {_SEEN.format(e='s.is_expired', t='s')} = {_SEEN.format(e='r.expired', t='r')}"


@query("new_violations", _STATE + f" {_NEW} WHERE NOT s.is_reported")
def new_violations(spark, d):
    state, runs = _state(spark, d)
    return v.new_violations(state, runs).select("id", "host", "first_violation", "last_seen", "user", "cpu_peak")


@query("all_violations", _STATE + f" {_NEW}")
def all_violations(spark, d):
    state, runs = _state(spark, d)
    return v.new_violations(state, runs, everything=True).select("id", "host", "first_violation", "last_seen", "user", "cpu_peak")


@query("violations_by_host", _STATE + f" SELECT host, count(*) AS violations FROM state2 WHERE first_violation > {NOW2 + 3600 - DAY} GROUP BY host")
def violations_by_host(spark, d):
    return v.violations_by_host(_state(spark, d)[0], NOW2 + 3600)


# --- at a glance -----------------------------------------------------------------------------------

NOW = EVENTS_START + 29 * DAY + 12 * 3600
_USERS = f""",
uj AS (SELECT unnest(hosts) AS host, "user", live_at_end OR last > {NOW} - 1800 AS rec, live_at_end OR last > {NOW} - 43200 AS lon FROM jobs),
users_jobs AS (SELECT host, count(*) FILTER (WHERE rec) AS jobs_recent, count(*) FILTER (WHERE lon) AS jobs_longer,
  count(DISTINCT CASE WHEN rec THEN "user" END) AS users_recent, count(DISTINCT CASE WHEN lon THEN "user" END) AS users_longer FROM uj GROUP BY host)"""


@query("users_jobs_by_host", o.JOBS + _USERS + " SELECT * FROM users_jobs")
def users_jobs_by_host(spark, d):
    return glance.users_jobs_by_host(unsorted(spark, d), NOW)


_STATUS = """,
status AS (SELECT host, CAST(state = 'down' AND device = 'host' AS BIGINT) AS cpu_status, CAST(state = 'down' AS BIGINT) AS gpu_status FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY start DESC, CASE WHEN device = 'host' THEN 0 ELSE 1 END DESC, "end" DESC, state DESC) AS rn FROM lines) WHERE rn = 1)"""


@query("status_by_host", UPTIME + _STATUS + " SELECT * FROM status")
def status_by_host(spark, d):
    return glance.status_by_host(uptime_lines(spark, d, sort=False))


_LAST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t DESC) AS rn FROM {src}) WHERE rn = 1"
_AVERAGES = (
    LOAD_HOUR.replace("% 3600", "% 1800").replace("first AS", "first30 AS").replace("FROM first x", "FROM first30 x")
    .replace("folded", "folded30").replace("loads AS", "loads30 AS").replace("cap AS", "cap30 AS").replace("JOIN cap c", "JOIN cap30 c")
    + _load(43200)[len(_load(43200).split(", folded AS")[0]):].replace("folded", "folded12").replace("first AS", "first12 AS").replace("FROM first x", "FROM first12 x")
    .replace("loads AS", "loads12 AS").replace("cap AS", "cap12 AS").replace("JOIN cap c", "JOIN cap12 c")
    + f""",
l30 AS ({_LAST.format(src='loads30')}), l12 AS ({_LAST.format(src='loads12')}),
averages AS (SELECT host, {', '.join(f'coalesce(l30.r{a}, 0) AS {n}_recent, coalesce(l12.r{a}, 0) AS {n}_longer' for a, n in (('cpu', 'cpu'), ('mem', 'mem'), ('res', 'resident'), ('gpu', 'gpu'), ('gpumem', 'gpumem')))}
  FROM l30 FULL JOIN l12 USING (host))"""
)


def averages(spark, d):
    return glance.load_averages(load_rollups(spark, d))


@query("load_averages", _AVERAGES + " SELECT * FROM averages")
def load_averages(spark, d):
    return averages(spark, d)


_CURRENT_FROM = NOW - 14 * DAY


@query("host_names", o.SAMPLES + o.REPORTS + f" SELECT DISTINCT host FROM reports WHERE t BETWEEN {_CURRENT_FROM} AND {NOW}")
def host_names(spark, d):
    return glance.host_names(inputs.nodes(spark, d), NOW)


_NEWEST = "newest AS (SELECT host, gpu_cards, description FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY valid_from DESC) AS rn FROM config) WHERE rn = 1)"
_COUNT = f"SELECT host, count(*) AS n FROM state2 WHERE first_violation > {NOW2 + 3600 - DAY} AND"


def _glance_sql() -> str:
    """The parts have SQL of their own; each becomes a table here."""
    whole = ["jobs_recent", "jobs_longer", "users_recent", "users_longer"]
    loads = [f"{n}_{s}" for n in ("cpu", "mem", "resident", "gpu", "gpumem") for s in ("recent", "longer")]
    value = lambda c: f"CAST(coalesce({c}, 0) AS BIGINT)"
    carded = lambda c: f"CASE WHEN gpu_cards > 0 THEN {value(c)} ELSE 0 END" if c.startswith(("gpu_", "gpumem_")) else value(c)
    return f"""WITH users_jobs AS ({ORACLE['users_jobs_by_host']}), st AS ({ORACLE['status_by_host']}), av AS ({ORACLE['load_averages']}),
    hogs AS ({_STATE} {_COUNT} NOT is_expired GROUP BY host), dead AS ({_STATE} {_COUNT} is_expired GROUP BY host), cur AS ({ORACLE['host_names']}),
    known AS ({o.SAMPLES} {o.REPORTS}, {_NEWEST} SELECT * FROM newest)
    SELECT host, coalesce(description, '') AS description, {', '.join(f'{value(c)} AS {c}' for c in [*whole, 'cpu_status', 'gpu_status'])},
      {', '.join(f'{carded(c)} AS {c}' for c in loads)}, {value('hogs.n')} AS violators, {value('dead.n')} AS deadweights
    FROM users_jobs FULL JOIN (SELECT st.* FROM st SEMI JOIN cur USING (host)) s USING (host) FULL JOIN av USING (host) FULL JOIN hogs USING (host) FULL JOIN dead USING (host)
    LEFT JOIN (SELECT known.* FROM known SEMI JOIN cur USING (host)) k USING (host)"""


@query("at_a_glance", _glance_sql())
def at_a_glance(spark, d):
    newest = config.newest_per_host(inputs.node_config(spark, d))
    current = glance.host_names(inputs.nodes(spark, d), NOW)
    state = _state(spark, d)[0]
    hogs = v.violations_by_host(state.filter("NOT is_expired"), NOW2 + 3600)
    dead = v.violations_by_host(state.filter("is_expired"), NOW2 + 3600)
    return glance.at_a_glance(
        glance.users_jobs_by_host(unsorted(spark, d), NOW), glance.status_by_host(uptime_lines(spark, d, sort=False)),
        averages(spark, d), hogs, dead, newest, current,
    )


@query(
    "at_a_glance_violations",
    _STATE + o.REPORTS + f""", hogs AS (SELECT host, count(*) AS violators FROM state2 WHERE first_violation > {NOW2 + 3600 - DAY} AND NOT is_expired GROUP BY host),
    dead AS (SELECT host, count(*) AS deadweights FROM state2 WHERE first_violation > {NOW2 + 3600 - DAY} AND is_expired GROUP BY host),
    cur AS (SELECT DISTINCT host FROM reports WHERE t BETWEEN {_CURRENT_FROM} AND {NOW}),
    uj AS (SELECT host, count(*) AS jobs_recent FROM samples GROUP BY host),
    av AS (SELECT host, CAST(max(h) AS BIGINT) AS gpu_recent FROM reports GROUP BY host),
    newest AS (SELECT host, gpu_cards, description FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY valid_from DESC) AS rn FROM config) WHERE rn = 1)
    SELECT host, CASE WHEN cur.host IS NOT NULL THEN coalesce(description, '') ELSE '' END AS description, coalesce(jobs_recent, 0) AS jobs_recent,
      CASE WHEN cur.host IS NOT NULL THEN 1 ELSE 0 END AS cpu_status, CASE WHEN cur.host IS NOT NULL AND gpu_cards > 0 THEN coalesce(gpu_recent, 0) ELSE 0 END AS gpu_recent,
      coalesce(violators, 0) AS violators, coalesce(deadweights, 0) AS deadweights
    FROM uj FULL JOIN av USING (host) FULL JOIN hogs USING (host) FULL JOIN dead USING (host) LEFT JOIN cur USING (host) LEFT JOIN newest USING (host)""",
)
def at_a_glance_violations(spark, d):
    """The outer join of the parts, with simple parts so that SQL can say them shortly."""
    state = _state(spark, d)[0]
    hogs = v.violations_by_host(state.filter("NOT is_expired"), NOW2 + 3600)
    dead = v.violations_by_host(state.filter("is_expired"), NOW2 + 3600)
    users = samples(spark, d).groupBy("host").agg(F.count(F.lit(1)).alias("jobs_recent"))
    status = samples(spark, d).select("host", F.lit(1).alias("cpu_status")).distinct()
    load = inputs.reports(spark, d).groupBy("host").agg(F.max("h").alias("gpu_recent"))
    return glance.at_a_glance(
        users, status, load, hogs, dead, config.newest_per_host(inputs.node_config(spark, d)), glance.host_names(inputs.nodes(spark, d), NOW)
    )


_DOWN = f""",
down AS (SELECT * FROM lines WHERE state = 'down'),
marked_load AS (SELECT l.host, l.t, l.rcpu, l.rgpu,
  coalesce(max(CASE WHEN d.device = 'host' THEN 1 END), 0) AS down_host, coalesce(max(CASE WHEN d.device = 'gpu' THEN 1 END), 0) AS down_gpu
  FROM loads l LEFT JOIN down d ON d.host = l.host AND ((l.t <= d.start AND d.start < l.t + 3600) OR (l.t > d.start AND l.t < d."end")) GROUP BY ALL)"""
_LOAD_DOWN = LOAD_HOUR + UPTIME.replace(o.SAMPLES + o.REPORTS, "", 1) .replace("known AS", "known_hosts AS").replace("FROM known\n", "FROM known_hosts\n") + _DOWN


def loaded_down(spark, d):
    return glance.load_with_downtime(load_by(spark, d, "hour"), uptime_lines(spark, d, sort=False), "hour")


@query("load_with_downtime", _LOAD_DOWN + " SELECT host, t, rcpu, rgpu, down_host, down_gpu FROM marked_load")
def load_with_downtime(spark, d):
    return loaded_down(spark, d).select("host", "t", "rcpu", "rgpu", "down_host", "down_gpu")


@query(
    "load_arrays",
    LOAD_HOUR + """, cards_now AS (SELECT host, gpu_cards FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY valid_from DESC) AS rn FROM config) WHERE rn = 1)
    SELECT l.host, string_agg(strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M'), ',' ORDER BY t) AS labels, string_agg(CAST(rcpu AS VARCHAR), ',' ORDER BY t) AS rcpu,
    CASE WHEN coalesce(any_value(gpu_cards), 0) > 0 THEN string_agg(CAST(rgpu AS VARCHAR), ',' ORDER BY t) END AS rgpu FROM loads l LEFT JOIN cards_now c ON c.host = l.host GROUP BY l.host""",
)
def load_arrays(spark, d):
    out = glance.load_arrays(load_by(spark, d, "hour"), config.newest_per_host(inputs.node_config(spark, d)))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("host", join("labels"), join("rcpu"), join("rgpu"))


# --- usage reports ---------------------------------------------------------------------------------


def _share(q: str, total: str) -> str:
    return R(f"{q} * 1e2 / {total}", 4)


def _by(key: str, qs: list[str], where: str = "TRUE") -> str:
    cols = ", ".join(f"CAST(sum({q}) AS BIGINT) AS {q}" for q in qs)
    return f""", sums AS (SELECT {key}, {cols} FROM jobs WHERE {where} GROUP BY {key}),
    shares AS (SELECT {key}, {', '.join(f'{q}, CASE WHEN sum({q}) OVER () <> 0 THEN ' + _share(q, f'CAST(sum({q}) OVER () AS DOUBLE)') + f' ELSE 0 END AS {q}_share' for q in qs)} FROM sums)"""


@query("top_commands", o.JOBS + _by("cmd", ["cputime_sec"]) + " SELECT * FROM shares WHERE cputime_sec <> 0 ORDER BY cputime_sec DESC, cmd LIMIT 3")
def top_commands(spark, d):
    return x.top_commands(unsorted(spark, d), 3).withColumn("cputime_sec_share", rounded("cputime_sec_share", 4))


@query("top_consumers", o.JOBS + _by('"user"', ["cputime_sec", "gputime_sec"]) + ' SELECT * FROM shares ORDER BY gputime_sec DESC, "user" LIMIT 20')
def top_consumers(spark, d):
    out = x.top_consumers(unsorted(spark, d), 20, "gputime_sec")
    return out.withColumn("cputime_sec_share", rounded("cputime_sec_share", 4)).withColumn("gputime_sec_share", rounded("gputime_sec_share", 4))


@query("user_total_load", o.JOBS + _by('"user"', ["read_kb"]) + " SELECT * FROM shares WHERE read_kb <> 0")
def user_total_load(spark, d):
    return x.user_total_load(unsorted(spark, d), "read_kb").withColumn("read_kb_share", rounded("read_kb_share", 4))


@query("worst_violators", o.JOBS + _by('"user"', ["cputime_sec"], "gpus = 0") + ' SELECT * FROM shares WHERE cputime_sec <> 0 ORDER BY cputime_sec DESC, "user" LIMIT 5')
def worst_violators(spark, d):
    return x.worst_violators(unsorted(spark, d), 5).withColumn("cputime_sec_share", rounded("cputime_sec_share", 4))


@query("user_load_by_command", o.JOBS + " SELECT cmd, CAST(sum(cputime_sec) AS BIGINT) AS cputime_sec, CAST(sum(gputime_sec) AS BIGINT) AS gputime_sec FROM jobs WHERE \"user\" = 'u50' GROUP BY cmd ORDER BY cputime_sec DESC, cmd LIMIT 10")
def user_load_by_command(spark, d):
    return x.user_load_by_command(unsorted(spark, d), "u50", 10)


_FULL, _RUN = 60, 3


@query(
    "heavy_gpu_users",
    _BUCKETED.replace("clean AS", "pclean AS").replace("FROM clean ", "FROM pclean ").replace("dedup", "pdedup").replace("lagged", "plagged")
    + o._clean() + o.job_steps("epoch = 0") + o._JOB_SUMMARIES + f""",
    busy AS (SELECT job, minute, row_number() OVER (PARTITION BY job ORDER BY minute) AS n, sum(floor(gpu_pct)) >= {_FULL} AS b FROM buck GROUP BY job, minute),
    isl AS (SELECT job, n - row_number() OVER (PARTITION BY job ORDER BY n) AS i FROM busy WHERE b),
    star AS (SELECT DISTINCT job FROM (SELECT job, i, count(*) AS c FROM isl GROUP BY job, i) WHERE c >= {_RUN})
    SELECT CASE WHEN star.job IS NOT NULL THEN '*' ELSE '' END AS mark, jobs.job, "user", gputime_sec, CAST(floor(gputime_sec / CAST(duration AS DOUBLE) * 100) AS BIGINT) AS gpu_share,
      array_to_string(hosts, ',') AS hosts, cmd FROM jobs LEFT JOIN star USING (job) WHERE jobs.job <> 0 AND duration >= 86400 AND gputime_sec >= 86400""",
)
def heavy_gpu_users(spark, d):
    return x.heavy_gpu_users(unsorted(spark, d), pr.profile_buckets(profiles(spark, d), 4), buckets_per_period=_RUN, full=_FULL)


@query(
    "underused_gpu_jobs",
    RELATIVE_JOBS + o.ACCOUNTING.replace("WITH sacct", ", sacct", 1)
    + """, low AS (SELECT * FROM rel SEMI JOIN (SELECT job_id FROM sjobs WHERE job_name = 'run') s ON rel.job = s.job_id WHERE duration >= 7200 AND ceil(sgpu_peak) < 101 AND ceil(sgpumem_peak) < 101)
    SELECT cmd, count(*) AS jobs FROM (SELECT unnest(string_split(cmd, ',')) AS cmd FROM low) GROUP BY cmd""",
)
def underused_gpu_jobs(spark, d):
    return x.underused_gpu_jobs(relative(spark, d), sacct_mains(spark, d), limit=101)


def report(spark, d):
    return accounting.sacct_report(sacct_mains(spark, d))


_SERIOUS = "elapsed >= 7200 AND req_mem >= 20 * 1048576 AND req_cpus * req_nodes >= 32"
_LARGE = "elapsed >= 86400 AND req_mem >= 20 * 1048576 AND req_cpus * req_nodes >= 32"
_BATCH = "job_name NOT IN ('interactive', 'OOD desktop')"


@query("blame", o.ACCOUNTING + f' SELECT "user", count(*) AS jobs FROM report WHERE {_SERIOUS} AND {_BATCH} AND state <> \'TIMEOUT\' AND rcpu <= 25 AND rmem <= 25 GROUP BY "user"')
def blame(spark, d):
    return x.blame(report(spark, d), "user")


@query("blame_account", o.ACCOUNTING + f" SELECT account, count(*) AS jobs FROM report WHERE {_SERIOUS} AND {_BATCH} AND state <> 'TIMEOUT' AND rcpu <= 25 AND rmem <= 25 GROUP BY account")
def blame_account(spark, d):
    return x.blame(report(spark, d), "account")


def _cell(c: str, width: int) -> str:
    return f"(CAST(greatest(1, least(100, floor({c}))) AS BIGINT) - 1) // {width}"


@query("heatmap", o.ACCOUNTING + f" SELECT {_cell('rcpu', 10)} AS x, {_cell('rmem', 10)} AS y, count(*) AS n FROM report GROUP BY 1, 2")
def heatmap(spark, d):
    return x.heatmap(report(spark, d), "rcpu", "rmem", 10)


@query(
    "heatmap_grid",
    o.ACCOUNTING + f", c AS (SELECT {_cell('rcpu', 20)} AS x, {_cell('rmem', 20)} AS y FROM report) SELECT y, {', '.join(f'count(*) FILTER (WHERE x = {i}) AS x{i}' for i in range(5))} FROM c GROUP BY y",
)
def heatmap_grid(spark, d):
    return x.heatmap_grid(x.heatmap(report(spark, d), "rcpu", "rmem", 5), 5)


_COHORTS = {
    "all": "TRUE", "serious": _SERIOUS, "serious-noninteractive": f"{_SERIOUS} AND {_BATCH}",
    "serious-timeout": f"{_SERIOUS} AND {_BATCH} AND state = 'TIMEOUT'", "serious-nontimeout": f"{_SERIOUS} AND {_BATCH} AND state <> 'TIMEOUT'",
    "large": f"{_LARGE} AND {_BATCH} AND state <> 'TIMEOUT'", "large-noncancelled": f"{_LARGE} AND {_BATCH} AND state <> 'TIMEOUT'",
}


@query("right_size_maps", o.ACCOUNTING + " UNION ALL ".join(f" SELECT '{n}' AS cohort, {_cell('rcpu', 10)} AS x, {_cell('rmem', 10)} AS y, count(*) AS n FROM report WHERE {c} GROUP BY 2, 3" for n, c in _COHORTS.items()))
def right_size_maps(spark, d):
    return x.right_size_maps(report(spark, d))


@query(
    "gpu_class_maps",
    RELATIVE_JOBS + f""", cls AS (SELECT *, 'small' AS host_class FROM rel WHERE len(list_filter(hosts, lambda h: h IN ('n1', 'n2', 'n3'))) > 0
      UNION ALL SELECT *, 'large' AS host_class FROM rel WHERE len(list_filter(hosts, lambda h: h IN ('n4', 'n5', 'n6'))) > 0)
    SELECT host_class, {_cell('ceil(sgpu_peak)', 20)} AS x, {_cell('ceil(sgpumem_peak)', 20)} AS y, count(*) AS n FROM cls WHERE gpus <> 0 AND duration >= 7200 GROUP BY 1, 2, 3""",
)
def gpu_class_maps(spark, d):
    return x.gpu_class_maps(relative(spark, d), {"small": "n[1-3]", "large": "n[4-6]"}, 5)


@query(
    "waste_trend",
    o.ACCOUNTING + f""", days AS (SELECT cutoff, "end" // 86400 AS day, count(*) FILTER (WHERE rcpu <= cutoff AND rmem <= cutoff) / CAST(count(*) AS DOUBLE) AS share
      FROM report, (SELECT unnest([25, 50]) AS cutoff) GROUP BY 1, 2)
    SELECT CAST(cutoff AS BIGINT) AS cutoff, day, {R('share')} AS share, CAST(floor(avg(share) OVER (PARTITION BY cutoff ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) * 100 + 1e-9) AS BIGINT) AS trend FROM days""",
)
def waste_trend(spark, d):
    return x.waste_trend(report(spark, d), [25, 50]).withColumn("share", rounded("share"))


@query(
    "wait_histogram",
    o.ACCOUNTING + """, h AS (SELECT wait // 3600 AS h FROM report)
    SELECT count(*) AS jobs, count(*) FILTER (WHERE h = 0) AS h0, count(*) FILTER (WHERE h = 1) AS h1, count(*) FILTER (WHERE h = 2) AS h2, count(*) FILTER (WHERE h = 3) AS h3,
    count(*) FILTER (WHERE h BETWEEN 4 AND 11) AS h4_11, count(*) FILTER (WHERE h BETWEEN 12 AND 23) AS h12_23, count(*) FILTER (WHERE h BETWEEN 24 AND 167) AS d1_6, count(*) FILTER (WHERE h >= 168) AS longer FROM h""",
)
def wait_histogram(spark, d):
    return x.wait_histogram(report(spark, d))


@query("gpu_utilization_days", _load(86400) + f" SELECT {R('avg(rgpu)')} AS mean, count(*) FILTER (WHERE rgpu < 40) AS below_40, count(*) FILTER (WHERE rgpu > 80) AS above_80 FROM loads")
def gpu_utilization_days(spark, d):
    return x.gpu_utilization_days(load_by(spark, d, "day")).withColumn("mean", rounded("mean"))


@query(
    "interactive_utilization",
    o.JOBS + o.ACCOUNTING.replace("WITH sacct", ", sacct", 1) + f""" SELECT a.job, s.job_name, duration, req_cpus, {R('cpu_avg / req_cpus')} AS avg_per_core, {R('cpu_peak / req_cpus')} AS peak_per_core, cmd
    FROM jobs a JOIN sjobs s ON a.job = s.job_id WHERE contains(s.job_name, 'OOD') AND duration >= 7200 AND req_cpus > 0""",
)
def interactive_utilization(spark, d):
    out = x.interactive_utilization(j.attach_accounting(unsorted(spark, d), sacct_mains(spark, d)))
    return out.withColumn("avg_per_core", rounded("avg_per_core")).withColumn("peak_per_core", rounded("peak_per_core"))


