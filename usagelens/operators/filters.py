"""Record filters and predicates on aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.gpus import gpu_set_compare, gpu_set_parse, gpu_set_text
from usagelens.functions.hosts import expand_host_list, host_list_matches, host_matches, host_set_compare
from usagelens.functions.scalars import format_duration, format_time, parse_duration, string_set_compare

# What the default filters leave out.
SYSTEM_USERS = ["root", "zabbix"]
SYSTEM_COMMANDS = ["bash", "zsh", "sshd", "tmux", "systemd"]
HEARTBEAT = "_heartbeat_"
SYSTEM_PID_LIMIT = 1000


@dataclass(frozen=True)
class Criteria:
    """What samples to keep.  Empty means no restriction."""

    users: list[str] = field(default_factory=list)
    exclude_users: list[str] = field(default_factory=list)
    jobs: list[int] = field(default_factory=list)
    exclude_jobs: list[int] = field(default_factory=list)
    commands: list[str] = field(default_factory=list)
    exclude_commands: list[str] = field(default_factory=list)
    hosts: list[str] = field(default_factory=list)
    min_pid: int = 0
    from_t: int | None = None
    to_t: int | None = None
    all_users: bool | None = None
    exclude_system_users: bool | None = None
    exclude_system_commands: bool | None = None
    exclude_system_jobs: bool | None = None
    exclude_heartbeat: bool | None = None


def _conjunction(terms: list[Column]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def filter_samples(df: DataFrame, criteria: Criteria | None = None, **kw) -> DataFrame:
    """Conjunction of include and exclude sets, host patterns, smallest pid and the closed time interval."""
    c = replace(criteria or Criteria(), **kw)
    terms: list[Column] = []
    for column, include, exclude in (
        ("user", c.users, c.exclude_users),
        ("job", c.jobs, c.exclude_jobs),
        ("cmd", c.commands, c.exclude_commands),
    ):
        if include:
            terms.append(F.col(column).isin(include))
        if exclude:
            terms.append(~F.col(column).isin(exclude))
    if c.hosts:
        terms.append(host_matches("host", c.hosts, prefix=True))
    if c.min_pid > 0:
        terms.append(F.col("pid") >= c.min_pid)
    if c.from_t is not None:
        terms.append(F.col("t") >= c.from_t)
    if c.to_t is not None:
        terms.append(F.col("t") <= c.to_t)
    return df.filter(_conjunction(terms)) if terms else df


def system_exclusions(
    df: DataFrame,
    users: bool = True,
    commands: bool = True,
    heartbeat: bool = True,
    system_jobs: bool = False,
    clusters: DataFrame | None = None,
) -> DataFrame:
    """Leave out system users, system commands, heartbeats and low pids.

    ``clusters`` (``cluster``, ``exclude_users array<string>``) adds each cluster's own excluded users.
    """
    terms: list[Column] = []
    if users:
        terms.append(~F.col("user").isin(SYSTEM_USERS))
    if commands:
        terms.append(~F.col("cmd").isin(SYSTEM_COMMANDS))
    if heartbeat:
        terms.append(F.col("cmd") != HEARTBEAT)
    if system_jobs:
        terms.append(F.col("pid") >= SYSTEM_PID_LIMIT)
    out = df.filter(_conjunction(terms)) if terms else df
    if clusters is not None:
        excluded = clusters.select("cluster", F.explode("exclude_users").alias("user")).distinct()
        out = out.join(excluded, ["cluster", "user"], "left_anti")
    return out


# Fixed values: (all users, system commands excluded, heartbeats excluded) per operator.
OPERATOR_DEFAULTS = {
    "jobs": (False, True, True),
    "load": (True, True, False),
    "profile": (False, False, True),
    "uptime": (True, False, False),
    "export_samples": (True, False, False),
    "metadata_bounds": (True, False, False),
}


def default_filters(op: str, criteria: Criteria) -> Criteria:
    """Fill in what each operator excludes unless told otherwise.

    Naming jobs implies all users but the system's; naming excluded users implies all users.
    """
    all_users, commands, heartbeat = OPERATOR_DEFAULTS[op]
    system_users = False
    if op not in ("uptime", "export_samples", "load"):
        if criteria.jobs:
            all_users, system_users = True, True
        elif criteria.exclude_users:
            all_users = True

    def default(value: bool | None, fallback: bool) -> bool:
        return fallback if value is None else value

    return replace(
        criteria,
        all_users=default(criteria.all_users, all_users),
        exclude_system_users=default(criteria.exclude_system_users, system_users),
        exclude_system_commands=default(criteria.exclude_system_commands, commands),
        exclude_system_jobs=default(criteria.exclude_system_jobs, False),
        exclude_heartbeat=default(criteria.exclude_heartbeat, heartbeat),
    )


def apply_criteria(df: DataFrame, criteria: Criteria, current_user: str | None = None) -> DataFrame:
    """The record filter of an operator: the criteria and the exclusions their flags ask for.

    Without ``all_users`` only the current user's samples are kept, where a current user is given.
    """
    out = filter_samples(df, criteria)
    if criteria.all_users is False and not criteria.users and current_user:
        out = out.filter(F.col("user") == current_user)
    return system_exclusions(
        out,
        users=bool(criteria.exclude_system_users),
        commands=bool(criteria.exclude_system_commands),
        heartbeat=bool(criteria.exclude_heartbeat),
        system_jobs=bool(criteria.exclude_system_jobs),
    )


def filter_time_host(
    df: DataFrame, from_t: int | None = None, to_t: int | None = None, hosts: list[str] | None = None,
    time: str = "t", host: str = "host",
) -> DataFrame:
    """Closed interval and host match.  A text time is parsed and rows where that fails are dropped."""
    out = df
    if dict(df.dtypes)[time] == "string":
        out = out.withColumn(time, F.unix_seconds(F.try_to_timestamp(F.col(time))))
        out = out.filter(F.col(time).isNotNull())
    terms = []
    if from_t is not None:
        terms.append(F.col(time) >= from_t)
    if to_t is not None:
        terms.append(F.col(time) <= to_t)
    if hosts:
        terms.append(host_matches(host, hosts, prefix=True))
    return out.filter(_conjunction(terms)) if terms else out


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Row predicate on output columns: a Column or SQL text (``rlike`` for patterns)."""
    return df.filter(condition)


def _ordered(a: Column, b: Column, op: str) -> Column:
    return {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


# Kind of a column: how it is shown, how the text of a value is read, and how two values compare.
FIELD_KINDS = {
    "text": (lambda c: c, F.lit, _ordered),
    "number": (lambda c: c.cast("string"), lambda v: F.lit(float(v)), _ordered),
    "duration": (format_duration, lambda v: parse_duration(F.lit(v)), _ordered),
    "time": (lambda c: format_time(c, "minute"), lambda v: F.unix_seconds(F.try_to_timestamp(F.lit(v))), _ordered),
    "hosts": (lambda c: F.array_join(F.array_sort(c), ","), lambda v: expand_host_list(F.lit(v)), host_set_compare),
    "gpus": (gpu_set_text, lambda v: gpu_set_parse(F.lit(v)), gpu_set_compare),
    "set": (lambda c: F.array_join(F.array_sort(c), ","), lambda v: F.split(F.lit(v), ","), string_set_compare),
}


def field_condition(field: str, op: str, value: str, kind: str = "text") -> Column:
    """Condition on a column whose value is given as text, for use in :func:`where`.

    ``op`` is ``=``, ``<``, ``<=``, ``>``, ``>=`` in the order of the kind (for the sets inclusion, ``<`` proper), or
    ``match``: a regular expression found in the value as reports show it.  A value that cannot be read makes the
    condition NULL, so no row passes; an unknown kind or operator is an error.
    """
    if kind not in FIELD_KINDS:
        raise ValueError(f"unknown kind of field: {kind}")
    shown, read, compare = FIELD_KINDS[kind]
    if op == "match":
        return shown(F.col(field)).rlike(value)
    if op not in ("=", "<", "<=", ">", ">="):
        raise ValueError(f"unknown operator: {op}")
    return compare(F.col(field), read(value), op)


# Thresholds on job aggregates and the columns they test.
JOB_LIMITS = {
    "cpu_avg": "cpu_avg", "cpu_peak": "cpu_peak", "rcpu_avg": "rcpu_avg", "rcpu_peak": "rcpu_peak",
    "mem_avg": "mem_avg", "mem_peak": "mem_peak", "rmem_avg": "rmem_avg", "rmem_peak": "rmem_peak",
    "res_avg": "res_avg", "res_peak": "res_peak", "rres_avg": "rres_avg", "rres_peak": "rres_peak",
    "gpu_avg": "gpu_avg", "gpu_peak": "gpu_peak", "rgpu_avg": "rgpu_avg", "rgpu_peak": "rgpu_peak",
    "gpumem_avg": "gpumem_avg", "gpumem_peak": "gpumem_peak",
    "rgpumem_avg": "rgpumem_avg", "rgpumem_peak": "rgpumem_peak",
    "samples": "n_samples", "runtime": "duration",
}


def filter_job_aggregates(jobs: DataFrame, **limits: float) -> DataFrame:
    """``min_<name>`` and ``max_<name>`` thresholds, both inclusive; names are in ``JOB_LIMITS``."""
    terms = []
    for name, value in limits.items():
        side, _, what = name.partition("_")
        column = F.col(JOB_LIMITS[what])
        terms.append(column >= value if side == "min" else column <= value)
    return jobs.filter(_conjunction(terms)) if terms else jobs


def filter_job_flags(
    jobs: DataFrame, no_gpu: bool = False, some_gpu: bool = False, completed: bool = False,
    running: bool = False, zombie: bool = False,
) -> DataFrame:
    terms = []
    if no_gpu:
        terms.append(F.col("gpus") == 0)
    if some_gpu:
        terms.append(F.col("gpus") != 0)
    if completed:
        terms.append(~F.col("live_at_end"))
    if running:
        terms.append(F.col("live_at_end"))
    if zombie:
        terms.append(F.col("zombie"))
    return jobs.filter(_conjunction(terms)) if terms else jobs


def sacct_condition(
    states: list[str] | None = None, users: list[str] | None = None,
    accounts: list[str] | None = None, partitions: list[str] | None = None,
    reservations: list[str] | None = None, gpu_types: list[str] | None = None,
    job_ids: list[int] | None = None, some_gpu: bool = False, no_gpu: bool = False,
    min_runtime: int = 0, max_runtime: int = 0,
) -> Column:
    """Sets on the main record, GPU type by prefix, job also by array or het ID, runtime range."""
    terms: list[Column] = []
    for column, values in (
        ("state", states), ("user", users), ("account", accounts), ("partition", partitions),
        ("reservation", reservations),
    ):
        if values:
            terms.append(F.col(column).isin(values))
    if gpu_types:
        any_prefix = F.lit(False)
        for g in gpu_types:
            any_prefix = any_prefix | F.col("req_gpus").startswith(g)
        terms.append(any_prefix)
    if job_ids:
        terms.append(
            F.col("job_id").isin(job_ids) | F.col("array_job_id").isin(job_ids) | F.col("het_job_id").isin(job_ids)
        )
    if some_gpu:
        terms.append(F.col("req_gpus") != "")
    elif no_gpu:
        terms.append(F.col("req_gpus") == "")
    terms.append(F.col("elapsed") >= min_runtime)
    if max_runtime > 0:
        terms.append(F.col("elapsed") <= max_runtime)
    return _conjunction(terms)


def filter_sacct(jobs: DataFrame, **criteria) -> DataFrame:
    """Jobs whose main record meets the criteria of :func:`sacct_condition`."""
    return jobs.filter(sacct_condition(**criteria))


def filter_sacct_hosts(jobs: DataFrame, hosts: list[str], node_list: str = "node_list") -> DataFrame:
    """Jobs with a node that matches one of the host patterns.

    The list's ranges are tested inside the row, without being expanded, so neither a shuffle nor memory for the hosts is needed.
    """
    if not hosts:
        return jobs
    return jobs.filter(host_list_matches(node_list, hosts, prefix=True))


def filter_reserved(
    jobs: DataFrame, min_mem_gb: float = 0, max_mem_gb: float | None = None, min_cores: int = 0,
    max_cores: int | None = None,
) -> DataFrame:
    """Reserved memory (KB in the record, GB in the argument) and reserved cores over all nodes."""
    cores = F.col("req_cpus") * F.col("req_nodes")
    terms = [F.col("req_mem") >= min_mem_gb * (1 << 20), cores >= min_cores]
    if max_mem_gb is not None:
        terms.append(F.col("req_mem") <= max_mem_gb * (1 << 20))
    if max_cores is not None:
        terms.append(cores <= max_cores)
    return jobs.filter(_conjunction(terms))
