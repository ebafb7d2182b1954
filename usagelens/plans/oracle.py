"""Common table expressions of the check SQL (DuckDB), built up in the order of the pipeline."""

from __future__ import annotations

START = 1704067200

_EVENTS = """
raw AS (
  SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS rt, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts
  FROM events),
samples AS (
  SELECT event_id, rt - rt % 10 AS t, 'n' || CAST(user_id % 8 AS VARCHAR) AS host,
         'u' || CAST(user_id AS VARCHAR) AS "user", user_id % 50 AS job, user_id + 1000 AS pid,
         event_type AS cmd, user_id % 2 AS epoch, value AS cpu_pct,
         (rt - 1704067200) // 400 + CAST(floor(value) AS BIGINT) AS cputime_sec,
         CAST(floor(value * 1048576) AS BIGINT) AS cpu_kb, CAST(floor(value * 524288) AS BIGINT) AS rss_kb,
         CASE WHEN event_type = 'error' THEN 2147483648
              WHEN event_type IN ('purchase', 'view') THEN CAST(power(2, user_id % 4) AS BIGINT) ELSE 0 END AS gpus,
         CAST(CASE WHEN event_type IN ('purchase', 'view') THEN k ELSE 0 END AS DOUBLE) AS gpu_pct,
         CASE WHEN event_type IN ('purchase', 'view') THEN k * 16384 ELSE 0 END AS gpu_kb,
         CASE WHEN event_type = 'error' AND k >= 90 THEN 1 ELSE 0 END AS gpu_fail,
         1 + user_id % 3 AS threads, k * 1024 AS data_read_kb, k * 512 AS data_written_kb
  FROM raw)"""

_DENSE = f""",
samples0 AS (SELECT * FROM samples),
dense AS (
  SELECT * REPLACE ({START} + (t - {START}) // 20 - ((t - {START}) // 20) % 10 + pid % 7 AS t) FROM samples0)"""


def _clean(source: str = "samples", where: str = "TRUE") -> str:
    return f""",
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY host, pid, cmd, t ORDER BY event_id) AS rn FROM {source} WHERE {where})
  WHERE rn = 1),
lagged AS (
  SELECT *, lag(t) OVER w AS raw_t, lag(cputime_sec) OVER w AS raw_cpu
  FROM dedup WINDOW w AS (PARTITION BY host, pid, cmd ORDER BY t)),
clean AS (
  SELECT *, lag(t) OVER w AS prev_t, lag(t) OVER w IS NULL AS is_first, lead(t) OVER w IS NULL AS is_last,
         first_value(t) OVER w AS stream_start
  FROM (SELECT *, CASE WHEN raw_t IS NULL THEN cpu_pct
                       ELSE CAST(cputime_sec - raw_cpu AS DOUBLE) / (t - raw_t) * 100 END AS cpu_util_pct
        FROM lagged WHERE raw_t IS NULL OR cputime_sec >= raw_cpu)
  WINDOW w AS (PARTITION BY host, pid, cmd ORDER BY t))"""


SAMPLES = "WITH" + _EVENTS
CLEAN = SAMPLES + _clean()

_VALUES = [
    "cpu_pct", "cpu_util_pct", "cpu_kb", "rss_kb", "gpu_pct", "gpu_kb", "gpu_fail", "cputime_sec", "threads",
    "data_read_kb", "data_written_kb", "gpus",
]


def unknown_absorbs(c: str) -> str:
    return f"CASE WHEN bit_or({c}) & 2147483648 <> 0 THEN 2147483648 ELSE bit_or({c}) END"


def steps(keys: dict[str, str], source: str = "clean", name: str = "steps", assigned: str | None = None) -> str:
    """Merged steps for series whose instants are ten seconds apart or the same.

    ``keys`` names the key columns and their expressions.  ``assigned`` is a relation (keys, t, step) where
    a step may hold several instants.
    """
    ks = ", ".join(keys)
    sel = ", ".join(f"{e} AS {k}" for k, e in keys.items())
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys)
    vals = ", ".join(_VALUES)
    if assigned:
        main = f"SELECT {', '.join('a.' + k for k in keys)}, b.step, {vals} FROM {name}_in a JOIN {assigned} b ON {same} AND a.t = b.t"
        starts = f"SELECT DISTINCT {ks}, step FROM {assigned}"
    else:
        main = f"SELECT {ks}, t AS step, {vals} FROM {name}_in"
        starts = f"SELECT DISTINCT {ks}, t AS step FROM {name}_in"
    return f""",
{name}_in AS (SELECT {sel}, t, is_last, {vals} FROM {source}),
{name}_at AS ({starts}),
{name}_all AS (
  {main}
  UNION ALL
  SELECT {', '.join('a.' + k for k in keys)}, b.step, {vals} FROM {name}_in a JOIN {name}_at b
    ON {same} AND a.is_last AND a.t < b.step AND b.step <= a.t + 60),
{name} AS (
  SELECT {ks}, step AS t, sum(cpu_pct) AS cpu_pct, sum(cpu_util_pct) AS cpu_util_pct,
         CAST(sum(cpu_kb) AS BIGINT) AS cpu_kb, CAST(sum(rss_kb) AS BIGINT) AS rss_kb, sum(gpu_pct) AS gpu_pct,
         CAST(sum(gpu_kb) AS BIGINT) AS gpu_kb, CAST(sum(cputime_sec) AS BIGINT) AS cputime_sec,
         CAST(sum(threads) AS BIGINT) AS threads, CAST(sum(data_read_kb) AS BIGINT) AS data_read_kb,
         CAST(sum(data_written_kb) AS BIGINT) AS data_written_kb, {unknown_absorbs('gpus')} AS gpus,
         max(gpu_fail) AS gpu_fail, count(*) AS n_selected
  FROM {name}_all GROUP BY {ks}, step)"""


HOST_STEPS = CLEAN + steps({"host": "host"})
SOLO = "CASE WHEN job = 0 THEN host || '/' || CAST(pid AS VARCHAR) || '/' || cmd END"


def job_steps(across: str, source: str = "clean") -> str:
    """Steps per job; ``across`` says where a job spans hosts.  ``names`` has cmd, user and hosts of each job."""
    host = f"CASE WHEN job <> 0 AND ({across}) THEN NULL ELSE host END"
    keys = {"host": host, "job": "job", "solo": SOLO}
    return steps(keys, source) + f""",
names AS (
  SELECT {host} AS host, job, {SOLO} AS solo, array_to_string(list_sort(list(DISTINCT cmd)), ',') AS cmd,
         array_to_string(list_sort(list(DISTINCT "user")), ',') AS "user",
         list_sort(list(DISTINCT host)) AS hosts
  FROM (SELECT host, job, pid, cmd, "user", epoch FROM {source} WHERE is_first) GROUP BY 1, 2, 3)"""


EPOCH_STEPS = CLEAN + job_steps("epoch = 0")

# Summaries per job from the steps; conditions on the key are null-safe.
ON_JOB = "a.host IS NOT DISTINCT FROM b.host AND a.job = b.job AND a.solo IS NOT DISTINCT FROM b.solo"
_JOB_SUMMARIES = f""",
agg AS (
  SELECT host, job, solo, avg(cpu_util_pct) AS cpu_avg, max(cpu_util_pct) AS cpu_peak,
         avg(cpu_kb / 1048576.0::DOUBLE) AS mem_avg, max(cpu_kb / 1048576.0::DOUBLE) AS mem_peak,
         avg(rss_kb / 1048576.0::DOUBLE) AS res_avg, max(rss_kb / 1048576.0::DOUBLE) AS res_peak,
         avg(gpu_pct) AS gpu_avg, max(gpu_pct) AS gpu_peak,
         avg(gpu_kb / 1048576.0::DOUBLE) AS gpumem_avg, max(gpu_kb / 1048576.0::DOUBLE) AS gpumem_peak,
         avg(threads) AS threads_avg, max(threads) AS threads_peak,
         CAST(sum(cputime_sec) AS BIGINT) AS cputime_sec, CAST(sum(data_read_kb) AS BIGINT) AS read_kb,
         CAST(sum(data_written_kb) AS BIGINT) AS written_kb, max(cpu_kb) AS vm_kb_peak, max(rss_kb) AS rss_kb_peak,
         {unknown_absorbs('gpus')} AS gpus, max(gpu_fail) AS gpu_fail, count(*) AS n_samples,
         min(t) AS first, max(t) AS last
  FROM steps GROUP BY host, job, solo),
bounds AS (SELECT host, min(t) AS earliest, max(t) AS latest FROM samples GROUP BY host),
job_bounds AS (
  SELECT n.host, n.job, n.solo, min(earliest) AS earliest, max(latest) AS latest
  FROM (SELECT host, job, solo, unnest(hosts) AS h FROM names) n JOIN bounds b ON n.h = b.host GROUP BY 1, 2, 3),
jobs AS (
  SELECT a.*, b.cmd, b."user", b.hosts, last - first AS duration,
         CAST(floor(gpu_avg * (last - first) / 100 + 0.5) AS BIGINT) AS gputime_sec,
         first = earliest AS live_at_start, last = latest AS live_at_end,
         a.read_kb // 1048576 AS read_gb, a.written_kb // 1048576 AS written_gb
  FROM agg a JOIN names b ON {ON_JOB} JOIN job_bounds c
    ON a.host IS NOT DISTINCT FROM c.host AND a.job = c.job AND a.solo IS NOT DISTINCT FROM c.solo)"""
JOBS = EPOCH_STEPS + _JOB_SUMMARIES

_REPORTS = f""",
seen_days AS (SELECT DISTINCT host, t - t % 86400 AS t, CAST(substr(host, 2) AS BIGINT) AS h FROM samples),
reports AS (
  SELECT host, t, h, (t - {START}) // 86400 AS day FROM seen_days
  WHERE h <> 7 AND ((h % 2 = 0 AND ((t - {START}) // 86400) % 5 = 0)
                    OR (h % 2 = 1 AND (t - {START}) // 86400 IN (0, 1, 22)))),
config AS (
  SELECT host, t AS valid_from, 2 * (h + 4) * (h % 2 + 1) AS cores, 64 + 16 * h + 8 * (day // 10) AS mem_gb,
         h % 4 AS gpu_cards, (h % 4) * 8 * (1 + day // 10) AS gpumem_gb,
         '2x' || CAST(h + 4 AS VARCHAR) || CASE WHEN h % 2 = 1 THEN ' (hyperthreaded)' ELSE '' END || ' X' ||
         CAST(h AS VARCHAR) || ', ' || CAST(64 + 16 * h + 8 * (day // 10) AS VARCHAR) || ' GiB' ||
         CASE WHEN h % 4 > 0 THEN ', ' || CAST(h % 4 AS VARCHAR) || 'x G' || CAST(h % 3 AS VARCHAR) || ' @ ' ||
           CAST(8 * (1 + day // 10) AS VARCHAR) || 'GiB' ELSE '' END AS description
  FROM reports),
cards AS (
  SELECT host AS node, t, CAST(i AS BIGINT) AS index, host || '/' || CAST(i AS VARCHAR) AS uuid,
         'G' || CAST(h % 3 AS VARCHAR) AS model, 8 * 1048576 * (1 + day // 10) AS memory
  FROM (SELECT *, unnest(range(1, h % 4 + 1)) AS i FROM reports WHERE h % 4 > 0)),
static AS (
  SELECT DISTINCT host, 4 AS cores, 32 AS mem_gb, 1 AS gpu_cards, 16 AS gpumem_gb, 'static ' || host AS description
  FROM samples WHERE host IN ('n1', 'n3'))"""

REPORTS = _REPORTS


def asof(left: str, name: str, time: str = "t", host: str = "host", keep: str = "l.*", inner: bool = False) -> str:
    """``left`` with the configuration of its host: newest at or before the time within 14 days, else static."""
    fields = ["cores", "mem_gb", "gpu_cards", "gpumem_gb", "description"]
    picks = ", ".join(f"CASE WHEN c.host IS NOT NULL THEN c.{f} ELSE s.{f} END AS {f}" for f in fields)
    return f""",
{name} AS (
  SELECT {keep}, {picks}, c.valid_from AS config_from
  FROM (SELECT x.*, (SELECT max(valid_from) FROM config k WHERE k.host = x.{host} AND k.valid_from <= x.{time}
                     AND k.valid_from >= x.{time} - 1209600) AS _vf FROM {left} x) l
  LEFT JOIN config c ON c.host = l.{host} AND c.valid_from = l._vf
  LEFT JOIN static s ON s.host = l.{host}
  {"WHERE c.host IS NOT NULL OR s.host IS NOT NULL" if inner else ""})"""


# Clean streams of hosts with a configuration at the stream's start.
CONFIGURED = (
    SAMPLES + _REPORTS + _clean()
    + ", starts AS (SELECT DISTINCT host, stream_start FROM clean)"
    + asof("starts", "known", "stream_start", keep="l.host, l.stream_start", inner=True)
    + ", conf AS (SELECT c.* FROM clean c SEMI JOIN known k ON c.host = k.host AND c.stream_start = k.stream_start)"
)
CONFIGURED_JOBS = CONFIGURED + job_steps("epoch = 0", "conf") + _JOB_SUMMARIES

ACCOUNTING = """WITH sacct AS (
  SELECT o_orderkey AS job_id, '' AS job_step, 'u' || CAST(o_custkey AS VARCHAR) AS "user",
         'a' || CAST(o_custkey % 7 AS VARCHAR) AS account,
         CASE o_orderkey % 5 WHEN 0 THEN 'interactive' WHEN 1 THEN 'OOD desktop' ELSE 'run' END AS job_name,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 = 0 THEN 'TIMEOUT' WHEN o_orderstatus = 'F' THEN 'COMPLETED'
              WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE 'PENDING' END AS state,
         o_orderpriority AS "partition", CAST(floor(epoch(o_orderdate)) AS BIGINT) AS submit,
         CAST(floor(epoch(o_orderdate)) AS BIGINT) + (o_orderkey % 200) * 1800 AS start,
         CAST(floor(epoch(o_orderdate)) AS BIGINT) + (o_orderkey % 200) * 1800 + o_orderkey % 90000 AS "end",
         o_orderkey % 90000 AS elapsed, 1 + o_orderkey % 64 AS req_cpus, 1 + o_orderkey % 4 AS req_nodes,
         CAST(floor(o_totalprice * 100) AS BIGINT) AS req_mem,
         CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey - o_orderkey % 130 ELSE 0 END AS array_job_id,
         CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey - o_orderkey % 34 ELSE 0 END AS het_job_id,
         o_orderkey % 90000 * (o_orderkey % 40) AS user_cpu, o_orderkey % 1000 AS system_cpu,
         'n[' || CAST(o_orderkey % 4 AS VARCHAR) || '-' || CAST(o_orderkey % 4 + 2 AS VARCHAR) || '].x' AS node_list,
         'cpu=' || CAST(1 + o_orderkey % 64 AS VARCHAR) || ',mem=4G' ||
           CASE o_orderkey % 3 WHEN 0 THEN ',gres/gpu:a100=' || CAST(1 + o_orderkey % 4 AS VARCHAR)
                WHEN 1 THEN ',gres/gpu=2' ELSE '' END AS alloc_res,
         CASE o_orderkey % 3 WHEN 0 THEN 'a100=' || CAST(1 + o_orderkey % 4 AS VARCHAR) WHEN 1 THEN '*=2' ELSE '' END AS req_gpus,
         CAST(0 AS BIGINT) AS max_rss, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t
  FROM orders
  UNION ALL
  SELECT l_orderkey, CAST(l_linenumber AS VARCHAR), '', '', '', '', '', 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, '', '', '',
         CAST(floor(l_extendedprice * 100) AS BIGINT), CAST(floor(epoch(l_shipdate)) AS BIGINT)
  FROM lineitem),
records AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY job_id, job_step ORDER BY t DESC,
    CASE state WHEN 'PENDING' THEN 0 WHEN 'RUNNING' THEN 1 ELSE 2 END DESC, max_rss) AS rn FROM sacct) WHERE rn = 1),
per_job AS (SELECT job_id, count(*) AS n, max(max_rss) AS job_max_rss FROM records GROUP BY job_id),
sjobs AS (SELECT r.*, n - 1 AS n_steps, p.job_max_rss FROM records r JOIN per_job p USING (job_id) WHERE r."user" <> ''),
report AS (
  SELECT *, req_cpus * req_nodes * elapsed AS requested_cpu, user_cpu + system_cpu AS used_cpu,
         CASE WHEN req_cpus * req_nodes * elapsed > 0 THEN CAST(floor(100 * (user_cpu + system_cpu) / CAST(req_cpus * req_nodes * elapsed AS DOUBLE) + 0.5) AS BIGINT) ELSE 0 END AS rcpu,
         CASE WHEN req_mem > 0 THEN CAST(floor(100 * job_max_rss / CAST(req_mem AS DOUBLE) + 0.5) AS BIGINT) ELSE 0 END AS rmem,
         CASE WHEN start > 0 THEN start - submit ELSE 0 END AS wait
  FROM sjobs)"""
