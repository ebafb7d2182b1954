"""Queries on load, uptime, profiles and time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelens.operators import filters, load as ld, profile as pr, series as se, streams, uptime as up
from usagelens.plans import inputs
from usagelens.plans import oracle as o
from usagelens.plans.driver_tables import EVENTS_START, samples
from usagelens.plans.inputs import clean, clean_dense
from usagelens.plans.registry import query, rounded, sql_round
from usagelens.schemas import DISK_COUNTERS

R = sql_round
ALL = filters.Criteria(all_users=True)
DAY = 86400


def _share(v: str, cap: str) -> str:
    return f"CASE WHEN coalesce({cap}, 0) > 0 THEN CAST(floor({v} / {cap} + 0.5) AS BIGINT) ELSE 0 END"


_LOAD_COLS = f"""CAST(floor(cpu_util_pct + 1e-9) AS BIGINT) AS cpu, {_share('cpu_util_pct', 'cores')} AS rcpu,
 cpu_kb // 1048576 AS mem, {_share("cpu_kb / 1048576.0::DOUBLE * 100", 'mem_gb')} AS rmem,
 rss_kb // 1048576 AS res, {_share("rss_kb / 1048576.0::DOUBLE * 100", 'mem_gb')} AS rres,
 CAST(floor(gpu_pct + 1e-9) AS BIGINT) AS gpu, {_share('gpu_pct', 'gpu_cards')} AS rgpu,
 gpu_kb // 1048576 AS gpumem, {_share("gpu_kb / 1048576.0::DOUBLE * 100", 'gpumem_gb')} AS rgpumem, gpus"""
_FOLD_RAW = f"""avg(cpu_util_pct) AS cpu_util_pct, avg(gpu_pct) AS gpu_pct, CAST(sum(cpu_kb) AS BIGINT) // count(*) AS cpu_kb,
 CAST(sum(rss_kb) AS BIGINT) // count(*) AS rss_kb, CAST(sum(gpu_kb) AS BIGINT) // count(*) AS gpu_kb, {o.unknown_absorbs('gpus')} AS gpus"""
_NOCAP = "CAST(NULL AS BIGINT) AS cores, CAST(NULL AS BIGINT) AS mem_gb, CAST(NULL AS BIGINT) AS gpu_cards, CAST(NULL AS BIGINT) AS gpumem_gb"
# Load leaves out system commands by default; none of the event types is one.
_CONF_STEPS = o.CONFIGURED + o.steps({"host": "host"}, "conf")


def _load(width: int) -> str:
    return (
        _CONF_STEPS + f", folded AS (SELECT host, t - t % {width} AS t, {_FOLD_RAW} FROM steps GROUP BY 1, 2)"
        + ", first AS (SELECT host, min(t) AS t FROM folded GROUP BY host)"
        + o.asof("first", "cap", keep="l.host")
        + f", loads AS (SELECT f.host, f.t, {_LOAD_COLS} FROM folded f JOIN cap c ON f.host = c.host)"
    )


LOAD_HOUR = _load(3600)


def load_by(spark, d, unit, **kw):
    return ld.load(samples(spark, d), inputs.node_config(spark, d), inputs.static_config(spark, d), unit, criteria=ALL, tie=["event_id"], **kw)


def load_rollups(spark, d, units=("half-hour", "half-day")):
    return ld.load_rollups(samples(spark, d), inputs.node_config(spark, d), inputs.static_config(spark, d), units, criteria=ALL, tie=["event_id"])


@query(
    "load_rollups",
    " UNION ALL ".join(f"SELECT '{u}' AS unit, * FROM ({_load(w)} SELECT * FROM loads)" for u, w in (("half-hour", 1800), ("half-day", 43200), ("day", 86400))),
)
def load_in_several_units(spark, d):
    """Three units from one merge, against a fold of its own for each."""
    return load_rollups(spark, d, ("half-hour", "half-day", "day"))


@query("load", LOAD_HOUR + " SELECT * FROM loads")
def load(spark, d):
    return load_by(spark, d, "hour")


@query(
    "load_unbucketed",
    o.HOST_STEPS + f", s AS (SELECT *, {_NOCAP} FROM steps) SELECT host, t, {_LOAD_COLS} FROM s",
)
def load_unbucketed(spark, d):
    return ld.load(samples(spark, d), unit=None, criteria=ALL, tie=["event_id"])


@query(
    "load_filled",
    _CONF_STEPS + f""", folded AS (SELECT host, t - t % 43200 AS t, {_FOLD_RAW} FROM steps GROUP BY 1, 2),
    grid AS (SELECT host, unnest(range((SELECT min(t) - min(t) % 43200 FROM samples), (SELECT max(t) + 1 FROM samples), 43200)) AS t FROM (SELECT DISTINCT host FROM folded)),
    filled AS (SELECT host, t, coalesce(cpu_util_pct, 0) AS cpu_util_pct, coalesce(gpu_pct, 0) AS gpu_pct, coalesce(cpu_kb, 0) AS cpu_kb, coalesce(rss_kb, 0) AS rss_kb,
      coalesce(gpu_kb, 0) AS gpu_kb, coalesce(gpus, 0) AS gpus FROM grid LEFT JOIN folded USING (host, t)),
    first AS (SELECT host, min(t) AS t FROM filled GROUP BY host)"""
    + o.asof("first", "cap", keep="l.host") + f" SELECT f.host, f.t, {_LOAD_COLS} FROM filled f LEFT JOIN cap c ON f.host = c.host",
)
def load_filled(spark, d):
    return load_by(spark, d, "half-day", fill=True)


@query(
    "load_group",
    _CONF_STEPS + f""", folded AS (SELECT host, t - t % 86400 AS t, {_FOLD_RAW} FROM steps GROUP BY 1, 2),
    first AS (SELECT host, min(t) AS t FROM folded GROUP BY host)""" + o.asof("first", "cap", keep="l.host", inner=True)
    + """, total AS (SELECT CAST(sum(cores) AS BIGINT) AS cores, CAST(sum(mem_gb) AS BIGINT) AS mem_gb, CAST(sum(gpu_cards) AS BIGINT) AS gpu_cards, CAST(sum(gpumem_gb) AS BIGINT) AS gpumem_gb FROM cap),
    grouped AS (SELECT t, sum(cpu_util_pct) AS cpu_util_pct, sum(gpu_pct) AS gpu_pct, CAST(sum(cpu_kb) AS BIGINT) AS cpu_kb, CAST(sum(rss_kb) AS BIGINT) AS rss_kb, CAST(sum(gpu_kb) AS BIGINT) AS gpu_kb, """
    + f"{o.unknown_absorbs('gpus')} AS gpus FROM folded GROUP BY t) SELECT t, {_LOAD_COLS} FROM grouped, total",
)
def load_group(spark, d):
    return load_by(spark, d, "day", group=True)


@query(
    "group_capacity",
    o.SAMPLES + o.REPORTS + ", first AS (SELECT host, min(t) AS t FROM samples GROUP BY host)" + o.asof("first", "cap", keep="l.host", inner=True)
    + """ SELECT string_agg(description, '|||' ORDER BY host) AS description, CAST(sum(cores) AS BIGINT) AS cores, CAST(sum(mem_gb) AS BIGINT) AS mem_gb,
    CAST(sum(gpu_cards) AS BIGINT) AS gpu_cards, CAST(sum(gpumem_gb) AS BIGINT) AS gpumem_gb FROM cap""",
)
def group_capacity(spark, d):
    first = samples(spark, d).groupBy("host").agg(F.min("t").alias("t"))
    return ld.group_capacity(first, inputs.node_config(spark, d), inputs.static_config(spark, d))


@query("load_last", LOAD_HOUR + " SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t DESC) AS rn FROM loads) WHERE rn = 1")
def load_last(spark, d):
    return ld.load_last(load_by(spark, d, "hour"))


# --- uptime ----------------------------------------------------------------------------------------

FROM, TO, INTERVAL = EVENTS_START + 2 * DAY + 100, EVENTS_START + 20 * DAY, 45
_CUT = INTERVAL * 120
UPTIME = o.SAMPLES + o.REPORTS + f""",
inst AS (SELECT host, t, max(gpu_fail) AS gpu_fail FROM samples WHERE t BETWEEN {FROM} AND {TO} GROUP BY host, t),
marked AS (
  SELECT *, max(CASE WHEN op THEN t END) OVER (PARTITION BY host ORDER BY t) AS ws FROM (
    SELECT *, coalesce(t - lag(t) OVER (PARTITION BY host ORDER BY t) > {_CUT}, TRUE) AS op FROM inst)),
win AS (
  SELECT *, lead(ws) OVER (PARTITION BY host ORDER BY ws) AS nxt, lag(ws) OVER (PARTITION BY host ORDER BY ws) AS prv
  FROM (SELECT host, ws, max(t) AS we FROM marked GROUP BY host, ws)),
host_win AS (
  SELECT host, 'host' AS device, 'up' AS state, ws AS start, we AS "end" FROM win
  UNION ALL SELECT host, 'host', 'down', we, coalesce(nxt, {TO}) FROM win WHERE nxt IS NOT NULL OR {TO} - we > {_CUT}
  UNION ALL SELECT host, 'host', 'down', {FROM}, ws FROM win WHERE prv IS NULL AND ws - {FROM} > {_CUT}),
runs AS (
  SELECT host, ws, run, max(t) AS last, max(gpu_fail) AS fail FROM (
    SELECT *, max(CASE WHEN ch THEN t END) OVER (PARTITION BY host, ws ORDER BY t) AS run FROM (
      SELECT *, coalesce(lag(gpu_fail) OVER (PARTITION BY host, ws ORDER BY t) <> gpu_fail, TRUE) AS ch FROM marked))
  GROUP BY host, ws, run),
gpu_win AS (
  SELECT host, 'gpu' AS device, CASE WHEN fail > 0 THEN 'down' ELSE 'up' END AS state, run AS start,
         coalesce(lead(run) OVER (PARTITION BY host, ws ORDER BY run), last) AS "end" FROM runs),
known AS (SELECT DISTINCT host FROM reports WHERE t BETWEEN {FROM} AND {TO} UNION SELECT 'ghost'),
always AS (
  SELECT host, 'host' AS device, 'down' AS state, {FROM} AS start, {TO} AS "end" FROM known
  WHERE host NOT IN (SELECT host FROM samples)),
lines AS (SELECT * FROM host_win UNION ALL SELECT * FROM gpu_win UNION ALL SELECT * FROM always)"""


def _marked(spark, d):
    return up.mark_windows(up.host_instants(samples(spark, d), FROM, TO), INTERVAL)


def known_hosts(spark, d):
    """Hosts that reported, and one more report by a host that never ran anything."""
    n = inputs.nodes(spark, d).select("host", "t")
    return n.unionByName(n.filter("host = 'n0'").withColumn("host", F.lit("ghost")))


def uptime_lines(spark, d, **kw):
    return up.uptime(samples(spark, d), FROM, TO, INTERVAL, nodes=known_hosts(spark, d), **kw)


@query("host_up_windows", UPTIME + " SELECT * FROM host_win")
def host_up_windows(spark, d):
    return up.host_up_windows(_marked(spark, d), FROM, TO, INTERVAL)


@query("host_always_down", UPTIME + " SELECT * FROM always")
def host_always_down(spark, d):
    return up.host_always_down(known_hosts(spark, d).filter(F.col("t").between(FROM, TO)), samples(spark, d), FROM, TO)


@query("gpu_windows", UPTIME + " SELECT * FROM gpu_win")
def gpu_windows(spark, d):
    return up.gpu_windows(_marked(spark, d))


@query("uptime", UPTIME + " SELECT * FROM lines")
def uptime(spark, d):
    return uptime_lines(spark, d)


@query("uptime_only_down", UPTIME + " SELECT * FROM lines WHERE state = 'down' AND host IN ('n1', 'n2')")
def uptime_only_down(spark, d):
    return uptime_lines(spark, d, only_down=True, hosts=["n[1-2]"])


@query("last_seen", o.SAMPLES + " SELECT host, max(t) AS last_seen FROM samples GROUP BY host")
def last_seen(spark, d):
    return up.last_seen(samples(spark, d))


@query("metadata_bounds", o.SAMPLES + " SELECT host, min(t) AS earliest, max(t) AS latest FROM samples GROUP BY host")
def metadata_bounds(spark, d):
    return up.metadata_bounds(samples(spark, d))


@query(
    "metadata_bounds_by_job",
    o.SAMPLES + """, b AS (SELECT host, min(t) AS earliest, max(t) AS latest FROM samples GROUP BY host),
    sets AS (SELECT DISTINCT list_sort(list(DISTINCT host)) AS hosts FROM samples GROUP BY job)
    SELECT array_to_string(hosts, ',') AS host_set, min(earliest) AS earliest, max(latest) AS latest FROM (SELECT hosts, unnest(hosts) AS host FROM sets) JOIN b USING (host) GROUP BY hosts""",
)
def metadata_bounds_by_job(spark, d):
    sets = samples(spark, d).groupBy("job").agg(F.array_sort(F.collect_set("host")).alias("hosts"))
    return up.metadata_bounds(samples(spark, d), sets)


# --- profiles --------------------------------------------------------------------------------------


def _clamp(v: str, c: float) -> str:
    return f"CASE WHEN {v} > {2 * c} THEN 0 WHEN {v} > {c} THEN {c} ELSE {v} END"


_MAX = 100
_MAXKB = 100 * 1048576
_DENSE_CLEAN = o.SAMPLES + o._DENSE + o._clean("dense")
_PROFILE = _DENSE_CLEAN + f""",
prof AS (
  SELECT job, (t + 30) - (t + 30) % 60 AS minute, host, CAST(pid AS VARCHAR) AS process,
         arg_max(cmd, (t, stream_start, cmd)) AS cmd, arg_max(stream_start, (t, stream_start, cmd)) AS stream_start,
         arg_max({_clamp('cpu_util_pct', _MAX)}, (t, stream_start, cmd)) AS cpu_util_pct, arg_max({_clamp('gpu_pct', _MAX)}, (t, stream_start, cmd)) AS gpu_pct,
         arg_max({_clamp('cpu_kb', _MAXKB)}, (t, stream_start, cmd)) AS cpu_kb, arg_max({_clamp('rss_kb', _MAXKB)}, (t, stream_start, cmd)) AS rss_kb,
         arg_max(gpu_kb, (t, stream_start, cmd)) AS gpu_kb
  FROM clean GROUP BY 1, 2, 3, 4)"""
_BUCKETED = _PROFILE + """,
chunks AS (SELECT job, minute, (row_number() OVER (PARTITION BY job ORDER BY minute) - 1) // 4 AS chunk FROM (SELECT DISTINCT job, minute FROM prof)),
times AS (SELECT job, chunk, list_sort(list(minute)) AS m FROM chunks GROUP BY 1, 2),
buck AS (
  SELECT p.job, t.m[len(t.m) // 2 + 1] AS minute, p.host, p.process, avg(cpu_util_pct) AS cpu_util_pct, avg(gpu_pct) AS gpu_pct,
         CAST(sum(cpu_kb) AS BIGINT) // count(*) AS cpu_kb, CAST(sum(rss_kb) AS BIGINT) // count(*) AS rss_kb
  FROM prof p JOIN chunks c USING (job, minute) JOIN times t ON t.job = c.job AND t.chunk = c.chunk GROUP BY 1, 2, 3, 4)"""


def profiles(spark, d, job=None):
    return pr.profile(clean_dense(spark, d), job, _MAX)


@query("profile", _PROFILE + f" SELECT job, minute, host, process, cmd, stream_start, {R('cpu_util_pct')} AS cpu_util_pct, {R('gpu_pct')} AS gpu_pct, CAST(cpu_kb AS BIGINT) AS cpu_kb, CAST(rss_kb AS BIGINT) AS rss_kb FROM prof")
def profile(spark, d):
    return profiles(spark, d).select(
        "job", "minute", "host", "process", "cmd", "stream_start", rounded("cpu_util_pct").alias("cpu_util_pct"), rounded("gpu_pct").alias("gpu_pct"), "cpu_kb", "rss_kb"
    )


@query("profile_one_job", _PROFILE + f" SELECT minute, host, process, {R('cpu_util_pct')} AS cpu_util_pct FROM prof WHERE job = 7")
def profile_one_job(spark, d):
    return profiles(spark, d, 7).select("minute", "host", "process", rounded("cpu_util_pct").alias("cpu_util_pct"))


@query("profile_buckets", _BUCKETED + f" SELECT job, minute, host, process, {R('cpu_util_pct')} AS cpu_util_pct, {R('gpu_pct')} AS gpu_pct, cpu_kb, rss_kb FROM buck")
def profile_buckets(spark, d):
    out = pr.profile_buckets(profiles(spark, d), 4)
    return out.select("job", "minute", "host", "process", rounded("cpu_util_pct").alias("cpu_util_pct"), rounded("gpu_pct").alias("gpu_pct"), "cpu_kb", "rss_kb")


@query(
    "profile_matrix",
    _PROFILE + " SELECT minute, string_agg(process || '@' || host || '=' || CAST(cpu_kb AS BIGINT), ',' ORDER BY process || '@' || host) AS cells FROM prof WHERE job = 3 GROUP BY minute",
)
def profile_matrix(spark, d):
    """The matrix with its cells as text, since its columns are the processes of the data."""
    m = pr.profile_matrix(profiles(spark, d, 3), "cpu_kb")
    cells = [F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("bigint").cast("string"))) for c in sorted(m.columns) if c != "minute"]
    return m.select("minute", F.concat_ws(",", *cells).alias("cells"))


@query(
    "profile_idle",
    _PROFILE + f""", n AS (SELECT job, count(DISTINCT minute) AS n FROM prof GROUP BY job)
    SELECT job, host, process, max(cpu_util_pct) < 50 AS idle, {R('sum(cpu_util_pct) / max(n)')} AS average FROM prof JOIN n USING (job) GROUP BY job, host, process""",
)
def profile_idle(spark, d):
    return pr.profile_idle(profiles(spark, d), threshold=50).select("job", "host", "process", "idle", rounded("average").alias("average"))


_CORES = """WITH cpu AS (SELECT vec_id AS t, 'n' || CAST(label AS VARCHAR) AS host, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100000) AS BIGINT)) AS pc FROM embeddings),
prev AS (SELECT *, lag(pc) OVER (PARTITION BY host ORDER BY t) AS pp, t - lag(t) OVER (PARTITION BY host ORDER BY t) AS dt FROM cpu),
core AS (SELECT host, t, dt, generate_subscripts(pc, 1) AS i, unnest(pc) AS now, unnest(pp) AS before FROM prev WHERE pp IS NOT NULL),
busy AS (SELECT host, t, CAST(i - 1 AS BIGINT) AS core, CAST(now - before AS DOUBLE) / dt AS rate FROM core)"""
_MARKS = "CASE WHEN rate >= 0.25 THEN 'O' WHEN rate >= 0.10 THEN 'o' ELSE '.' END"


@query("core_busyness", _CORES + f" SELECT host, t, core, {R('rate')} AS rate, {_MARKS} AS mark FROM busy")
def core_busyness(spark, d):
    out = pr.core_busyness(streams.clean_cpu_samples(inputs.cpu_samples(spark, d)))
    return out.select("host", "t", F.col("core").cast("bigint").alias("core"), rounded("rate").alias("rate"), "mark")


@query("core_lines", _CORES + f" SELECT host, t, string_agg({_MARKS}, '' ORDER BY core) AS line FROM busy GROUP BY host, t")
def core_lines(spark, d):
    return pr.core_lines(pr.core_busyness(streams.clean_cpu_samples(inputs.cpu_samples(spark, d))))


@query("clean_cpu_samples", _CORES + " SELECT host, t, len(pc) AS cores, pc[1] AS first FROM cpu")
def clean_cpu_samples(spark, d):
    twice = inputs.cpu_samples(spark, d)
    out = streams.clean_cpu_samples(twice.unionByName(twice))
    return out.select("host", "t", F.size("per_core").cast("bigint").alias("cores"), F.col("per_core")[0].alias("first"))


_GPU = o.SAMPLES + """, inst AS (SELECT host, t, max(data_read_kb) // 1024 AS v, CAST(substr(host, 2) AS BIGINT) % 4 AS n FROM samples WHERE CAST(substr(host, 2) AS BIGINT) % 4 > 0 GROUP BY host, t),
gs AS (SELECT host, t, i AS index, host || '/' || CAST(i AS VARCHAR) AS uuid, (v + i * 7) % 101 AS ce_util, (v * 3 + i) % 101 AS memory_util FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM inst))"""


@query("gpu_samples_rows", _GPU + " SELECT host, t, index, uuid, ce_util, memory_util FROM gs WHERE index = 1")
def gpu_samples_rows(spark, d):
    return pr.gpu_samples_rows(inputs.gpu_samples(spark, d), 1)


@query("node_profile", o.SAMPLES + f" SELECT host, t, count(*) AS existing, CAST(sum(rss_kb) AS BIGINT) AS used_memory FROM samples WHERE t BETWEEN {FROM} AND {TO} GROUP BY host, t")
def node_profile(spark, d):
    nodes = samples(spark, d).groupBy("host", "t").agg(F.count(F.lit(1)).alias("existing"), F.sum("rss_kb").alias("used_memory"))
    return pr.node_profile(nodes, FROM, TO)


_DISK = o.SAMPLES + ", inst AS (SELECT host, t, CAST(sum(data_read_kb) AS BIGINT) AS v FROM samples GROUP BY host, t), ds AS (SELECT host, t, 'sd' || CAST(i AS VARCHAR) AS name, " + ", ".join(
    f"v * {k + 1} + i AS {c}" for k, c in enumerate(DISK_COUNTERS)
) + " FROM inst, (SELECT unnest([0, 1]) AS i))"


@query("disk_profile", _DISK + f" SELECT host, t, name, {', '.join(DISK_COUNTERS)} FROM ds WHERE t >= {FROM} AND host = 'n2'")
def disk_profile(spark, d):
    return pr.disk_profile(inputs.disk_samples(spark, d), FROM, None, ["n2"]).select("host", "t", "name", *DISK_COUNTERS)


# --- series ----------------------------------------------------------------------------------------


def _series(source: str, keys: str, width: int, aggs: list[tuple[str, str]]) -> str:
    """Buckets anchored at the first sample, with zero rows in between."""
    same = " AND ".join(f"g.{k} = b.{k}" for k in keys.split(", "))
    return f""",
anchor AS (SELECT {keys}, min(t) AS t0, max(t) AS t1 FROM {source} GROUP BY {keys}),
placed AS (SELECT {', '.join('b.' + k for k in keys.split(', '))}, t0 + (t - t0) // {width} * {width} AS bt, {', '.join(f'{e} AS {n}' for n, e in aggs)}
  FROM {source} b JOIN anchor g ON {same} GROUP BY ALL),
slots AS (SELECT {keys}, unnest(range(t0, t1 + 1, {width})) AS t FROM anchor),
series AS (SELECT {', '.join('g.' + k for k in keys.split(', '))}, g.t, {', '.join(f'coalesce(b.{n}, 0) AS {n}' for n, _ in aggs)} FROM slots g LEFT JOIN placed b ON {same} AND g.t = b.bt)"""


def _one(e: str) -> str:
    return f"floor(({e}) * 10 + 0.5) / 10"


_SYS = o.SAMPLES + o.REPORTS + o._clean() + o.steps({"host": "host"}) + ", info AS (SELECT host, max(cores) AS cores, max(mem_gb) * 1048576 AS memory_kb FROM config GROUP BY host)"
_W1 = _SYS + _series("steps", "host", 7200, [("cpu", "avg(cpu_util_pct)"), ("rss", "CAST(sum(rss_kb) AS BIGINT) // count(*)")])


def sysinfo(spark, d):
    return inputs.node_config(spark, d).groupBy("host").agg(F.max("cores").alias("cores"), (F.max("mem_gb") * (1 << 20)).alias("memory_kb"))


@query("node_cpu_mem_series", _W1 + f" SELECT host, t, {_one('cpu / cores')} AS cpu_util, {_one('rss / memory_kb * 100')} AS mem_util FROM series JOIN info USING (host)")
def node_cpu_mem_series(spark, d):
    return se.node_cpu_mem_series(clean(spark, d), sysinfo(spark, d), 7200)


@query(
    "node_cpu_mem_series_compat",
    _W1 + f""", tasks AS (SELECT host, count(*) AS n FROM clean WHERE is_first GROUP BY host)
    SELECT host, t, {_one('cpu / n * 100 / cores')} AS cpu_util, {_one('rss / memory_kb * 100')} AS mem_util FROM series JOIN info USING (host) JOIN tasks USING (host)""",
)
def node_cpu_mem_series_compat(spark, d):
    return se.node_cpu_mem_series(clean(spark, d), sysinfo(spark, d), 7200, compat=True)


@query("gpu_series", _GPU + _series("gs", "host, uuid, index", 3600, [("ce", "avg(ce_util)"), ("mu", "avg(memory_util)")]) + f" SELECT host, uuid, index, t, {_one('ce')} AS ce_util, {_one('mu')} AS memory_util FROM series")
def gpu_series(spark, d):
    return se.gpu_series(inputs.gpu_samples(spark, d), 3600)


@query("disk_series", _DISK + _series("ds", "host, name", 7200, [(c, f"CAST(sum({c}) AS BIGINT) // count(*)") for c in DISK_COUNTERS]) + f" SELECT host, name, t, {', '.join(DISK_COUNTERS)} FROM series")
def disk_series(spark, d):
    return se.disk_series(inputs.disk_samples(spark, d), 7200)


@query("process_series", o.CLEAN + _series("clean", "host, pid, cmd", 21600, [("c", "avg(cpu_pct)"), ("g", "avg(gpu_pct)"), ("kb", "CAST(sum(cpu_kb) AS BIGINT) // count(*)")]) + f" SELECT host, pid AS stream_id, cmd, t, {_one('c')} AS cpu_pct, {_one('g')} AS gpu_pct, kb AS cpu_kb FROM series")
def process_series(spark, d):
    return se.process_series(clean(spark, d), 21600).drop("gpumem_pct")


AT, HALF = EVENTS_START + 10 * DAY, 6 * 3600


def _window(spark, d):
    return streams.clean_streams(samples(spark, d).filter(F.col("t").between(AT - HALF, AT + HALF)), ["event_id"])


_AT = o.SAMPLES + o.REPORTS + o._clean("samples", f"t BETWEEN {AT - HALF} AND {AT + HALF}")
_KNOWN_CARDS = f""", ci AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY t DESC) AS rn FROM cards WHERE t BETWEEN {AT - DAY} AND {AT}) WHERE rn = 1)"""


@query(
    "node_gpu_at",
    _AT + o.steps({"host": "host"}) + f""", p AS (SELECT host, array_to_string(list_sort(list(pid)), ',') AS pids FROM clean WHERE is_first GROUP BY host)
    SELECT s.host, {AT} AS t, {_one('avg(gpu_pct)')} AS gpu_util, CAST(sum(gpu_kb) AS BIGINT) // count(*) AS gpu_kb, any_value(pids) AS pids FROM steps s JOIN p USING (host) WHERE gpu_pct > 0 OR gpu_kb > 0 GROUP BY s.host""",
)
def node_gpu_at(spark, d):
    return se.node_gpu_at(_window(spark, d), AT).select("host", "t", "gpu_util", "gpu_kb", F.array_join("pids", ",").alias("pids"))


@query(
    "processes_at",
    _AT + _KNOWN_CARDS + f""", used AS (SELECT event_id, string_agg(uuid, ',' ORDER BY index) AS uuids FROM clean JOIN ci ON ci.node = clean.host AND gpus <> 2147483648 AND (gpus >> index) & 1 = 1 WHERE is_last GROUP BY event_id)
    SELECT host, pid, cmd, t, "user", cpu_kb AS mem_kb, {_one('gpu_pct')} AS gpu_pct, coalesce(uuids, '') AS uuids FROM clean LEFT JOIN used USING (event_id) WHERE is_last""",
)
def processes_at(spark, d):
    out = se.processes_at(_window(spark, d), inputs.cards(spark, d), AT)
    return out.select("host", "pid", "cmd", "t", "user", "mem_kb", "gpu_pct", F.array_join("uuids", ",").alias("uuids"))


@query(
    "process_gpus_at",
    _AT + _KNOWN_CARDS + _GPU.replace(o.SAMPLES, "", 1) + f""", rd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY host, uuid ORDER BY t, index) AS rn FROM gs WHERE t BETWEEN {AT - HALF} AND {AT + HALF}) WHERE rn = 1)
    SELECT c.host, c.pid, c.cmd, ci.uuid, ci.model, rd.t, rd.index AS gpu_index, rd.ce_util AS gpu_pct, rd.memory_util AS gpumem_pct
    FROM clean c JOIN ci ON ci.node = c.host AND gpus <> 2147483648 AND (gpus >> ci.index) & 1 = 1 JOIN rd ON rd.host = c.host AND rd.uuid = ci.uuid WHERE is_last""",
)
def process_gpus_at(spark, d):
    readings = inputs.gpu_samples(spark, d).filter(F.col("t").between(AT - HALF, AT + HALF))
    out = se.process_gpus_at(_window(spark, d), readings, inputs.cards(spark, d), AT)
    return out.select("host", F.col("stream_id").alias("pid"), "cmd", "uuid", "model", "t", "gpu_index", "gpu_pct", "gpumem_pct")


@query(
    "node_info_at",
    _AT + _KNOWN_CARDS + f""", nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t DESC) AS rn FROM reports WHERE t BETWEEN {AT - DAY} AND {AT}) WHERE rn = 1)
    SELECT nn.host AS node, nn.t, 4 + h AS cores_per_socket, (SELECT string_agg(uuid || ' ' || model || ' ' || CAST(memory AS VARCHAR), ',' ORDER BY index) FROM ci WHERE ci.node = nn.host) AS card_info FROM nn""",
)
def node_info_at(spark, d):
    out = se.node_info_at(inputs.nodes(spark, d), inputs.cards(spark, d), AT)
    text = F.transform("card_info", lambda c: F.concat_ws(" ", c["uuid"], c["model"], c["memory"].cast("string")))
    return out.select("node", "t", "cores_per_socket", F.array_join(text, ",").alias("card_info"))


@query(
    "cluster_overview",
    o.SAMPLES + f""", d AS (SELECT *, 'c' || CAST(epoch AS VARCHAR) AS cluster, t - t % 86400 AS day FROM samples)
    SELECT cluster, {AT} AS t, 1 AS slurm, array_to_string(list_sort(list(DISTINCT cmd)), ',') AS partitions, array_to_string(list_sort(list(DISTINCT host)), ',') AS nodes FROM d WHERE day BETWEEN {AT - DAY} AND {AT} GROUP BY cluster""",
)
def cluster_overview(spark, d):
    from usagelens.plans.catalog_jobs import cluster_state, clusters

    day = samples(spark, d).select(F.concat(F.lit("c"), F.col("epoch").cast("string")).alias("cluster"), F.col("host").alias("node"), (F.col("t") - F.col("t") % DAY).alias("t"))
    out = se.cluster_overview(clusters(spark, d), cluster_state(spark, d)[0], day, AT)
    return out.select("cluster", "t", "slurm", F.array_join("partitions", ",").alias("partitions"), F.array_join("nodes", ",").alias("nodes"))


@query("time_extent", o.SAMPLES + o.REPORTS + " SELECT (SELECT min(t) FROM reports) AS min_t, (SELECT max(t) FROM samples) AS max_t")
def time_extent(spark, d):
    from usagelens.sources.tables import time_extent as extent

    return extent(inputs.nodes(spark, d), samples(spark, d))


@query(
    "clamp_window",
    o.SAMPLES + f""", e AS (SELECT min(t) AS lo, max(t) AS hi FROM samples)
    SELECT 0 AS case_no, hi - 3600 AS from_t, hi AS to_t FROM e UNION ALL SELECT 1, greatest(lo, {TO} - 1209600), {TO} FROM e
    UNION ALL SELECT 2, {AT}, {AT} + 3600 FROM e UNION ALL SELECT 3, greatest(lo, {EVENTS_START + 60} - 3600), {EVENTS_START + 60} FROM e UNION ALL SELECT 4, greatest(lo, {AT + 90 * DAY} - 1209600), hi FROM e WHERE hi < {AT + 90 * DAY}""",
)
def clamp_window(spark, d):
    extent = samples(spark, d).agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"))
    cases = [(None, None), (EVENTS_START - 5, TO), (AT, None), (None, EVENTS_START + 60), (AT, AT + 90 * DAY)]
    frames = [se.clamp_window(extent, a, b).select(F.lit(i).alias("case_no"), "from_t", "to_t") for i, (a, b) in enumerate(cases)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out

