from pyspark.sql import functions as F

from tests.test_merge import frame, sample
from usagelens.operators import accounting, config, filters, jobs, load, uptime, usage_reports, violations
from usagelens.operators.profile import profile, profile_buckets
from usagelens.operators.series import node_cpu_mem_series
from usagelens.operators.streams import clean_streams
from usagelens.schemas import conform_sacct

ALL = filters.Criteria(all_users=True)
DAY = 86400


def test_liveness_is_judged_per_host(spark):
    rows = [sample(host="a", job=1, t=t) for t in (0, 300)] + [sample(host="a", job=2, pid=7000, t=t) for t in (300, 600)]
    rows += [sample(host="b", job=3, pid=7001, t=t) for t in (0, 300)]
    got = {r.job: r.jobm for r in jobs.jobs(frame(spark, rows), criteria=ALL).collect()}
    assert got == {1: "1<", 2: "2>", 3: "3!"}


def test_job_over_three_nodes(spark):
    rows = [sample(host=f"k-{n}.example", job=9, epoch=0, t=t, cputime_sec=t, cpu_kb=1 << 20) for n in (30, 33, 34) for t in (0, 300)]
    got = jobs.jobs(frame(spark, rows), criteria=ALL).collect()
    assert [(r.job, r.hosts, r.mem_peak, r.cpu_peak) for r in got] == [(9, ["k-30.example", "k-33.example", "k-34.example"], 3.0, 300.0)]


def test_bounds_come_from_unfiltered_samples(spark):
    rows = [sample(job=1, t=100), sample(job=2, pid=9, t=0, user="x"), sample(job=2, pid=9, t=500, user="x")]
    got = jobs.jobs(frame(spark, rows), criteria=filters.Criteria(all_users=True, users=["u"])).collect()
    assert [(r.job, r.live_at_start, r.live_at_end) for r in got] == [(1, False, False)]


def test_default_filters():
    c = filters.default_filters("jobs", filters.Criteria())
    assert (c.all_users, c.exclude_system_commands, c.exclude_heartbeat) == (False, True, True)
    assert filters.default_filters("jobs", filters.Criteria(jobs=[1])).exclude_system_users
    assert filters.default_filters("jobs", filters.Criteria(exclude_users=["a"])).all_users
    u = filters.default_filters("uptime", filters.Criteria())
    assert (u.all_users, u.exclude_system_commands, u.exclude_heartbeat) == (True, False, False)


def test_uptime_known_answer(spark):
    t0 = 22 * 3600
    rows = [sample(host="ml8", t=t0 + 300 * i, gpu_fail=0) for i in range(4)]
    hosts = spark.createDataFrame([("ml8",), ("ml9",)], "host string")
    got = [tuple(r) for r in uptime.uptime(frame(spark, rows), 0, DAY - 60, 5, static=hosts).collect()]
    assert got == [
        ("ml8", "host", "down", 0, t0),
        ("ml8", "host", "up", t0, t0 + 900),
        ("ml8", "gpu", "up", t0, t0 + 900),
        ("ml8", "host", "down", t0 + 900, DAY - 60),
        ("ml9", "host", "down", 0, DAY - 60),
    ]


def test_gpu_run_ends_where_the_next_begins(spark):
    rows = [sample(host="a", t=300 * i, gpu_fail=int(i in (2, 3))) for i in range(6)]
    lines = uptime.uptime(frame(spark, rows), 0, 1500, 5).filter("device = 'gpu'").collect()
    assert [(r.state, r.start, r.end) for r in lines] == [("up", 0, 600), ("down", 600, 1200), ("up", 1200, 1500)]


def _configs(spark):
    rows = [("a", 0, 4), ("a", 5 * DAY, 8), ("b", 0, 16)]
    cfg = spark.createDataFrame(rows, "host string, valid_from bigint, cores bigint")
    more = {"description": F.lit("d"), "mem_gb": F.lit(10), "gpu_cards": F.lit(0), "gpumem_gb": F.lit(0)}
    return cfg.withColumns(more), cfg.filter("host = 'b'").withColumns({**more, "cores": F.lit(1)}).drop("valid_from")


def test_asof_limit_and_fallback(spark):
    cfg, static = _configs(spark)
    asked = [("a", 10), ("a", 5 * DAY - 1), ("a", 5 * DAY), ("a", 19 * DAY), ("a", 19 * DAY + 1), ("b", 14 * DAY), ("b", 15 * DAY), ("c", 5)]
    left = spark.createDataFrame(asked, "host string, t bigint")
    got = {(r.host, r.t): r.cores for r in config.config_asof(left, cfg, static).collect()}
    assert [got[k] for k in asked] == [4, 4, 8, 8, None, 16, 1, None]


def test_node_config_description(spark):
    nodes = spark.createDataFrame([("2024-01-01T00:00:00Z", "a", 2, 14, 2, "Xeon", 128 << 20)], "time string, node string, sockets bigint, cores_per_socket bigint, threads_per_core bigint, cpu_model string, memory bigint")
    cards = spark.createDataFrame([("2024-01-01T00:00:00Z", "a", i, "RTX", 11 << 20) for i in range(4)], "time string, node string, index bigint, model string, memory bigint")
    r = config.node_config(nodes, cards).first()
    assert (r.description, r.cores, r.gpu_cards, r.gpumem_gb) == ("2x14 (hyperthreaded) Xeon, 128 GiB, 4x RTX @ 11GiB", 56, 4, 44)


def test_load_unbucketed_known_answer(spark):
    rows = [sample(host="ml8", t=0, cpu_pct=18.0, cputime_sec=100), sample(host="ml8", t=300, cpu_pct=9.0, cputime_sec=793)]
    assert [r.cpu for r in load.load(frame(spark, rows), unit=None).orderBy("t").collect()] == [18, 231]


def test_load_gap_filling(spark):
    rows = [sample(host="a", t=t, cpu_kb=3 << 20) for t in (3600, 4 * 3600)]
    out = load.load(frame(spark, rows), unit="hour", fill=True, from_t=0, to_t=5 * 3600).orderBy("t").collect()
    assert [(r.t // 3600, r.mem) for r in out] == [(0, 0), (1, 3), (2, 0), (3, 0), (4, 3), (5, 0)]


def test_profile_buckets_take_the_middle_time(spark):
    rows = [sample(t=60 * i, cpu_kb=10 * (i + 1)) for i in range(5)]
    out = profile_buckets(profile(clean_streams(frame(spark, rows)), 1), 3).orderBy("minute").collect()
    assert [(r.minute, r.cpu_kb) for r in out] == [(60, 20), (240, 45)]


def test_series_is_anchored_and_has_empty_buckets(spark):
    rows = [sample(host="a", t=t, rss_kb=100, cpu_pct=50.0) for t in (17, 217, 1000)]
    info = spark.createDataFrame([("a", 2, 1000)], "host string, cores bigint, memory_kb bigint")
    out = node_cpu_mem_series(clean_streams(frame(spark, rows)), info, 300).orderBy("t").collect()
    assert [(r.t, r.mem_util) for r in out] == [(17, 10.0), (317, 0.0), (617, 0.0), (917, 10.0)]


def _log(spark, rows):
    return spark.createDataFrame([(n, i, "h", "u", "c", n - 5, n) for n, i in rows], "now bigint, id bigint, host string, user string, cmd string, start bigint, end bigint")


def test_runs_and_state(spark):
    log = _log(spark, [(10, 1), (20, 1), (20, 2), (30, 2), (40, 1), (40, 3)])
    runs = violations.consolidate_runs(log)
    got = {(r.id, r.first_seen, r.last_seen, r.expired) for r in runs.collect()}
    assert got == {(1, 10, 20, True), (1, 40, 40, False), (2, 20, 30, False), (3, 40, 40, False)}
    state = violations.merge_state(violations.read_state(spark, ""), runs, 100)
    assert violations.new_violations(state, runs).count() == 4
    state = violations.mark_reported(state, violations.new_violations(state, runs))
    later = violations.consolidate_runs(_log(spark, [(40, 1), (50, 1), (50, 4)]))
    state = violations.merge_state(state, later, 200)
    new = violations.new_violations(state, later).collect()
    assert [(r.id, r.first_violation) for r in new] == [(4, 200)]
    one = state.filter("id = 1 AND NOT is_expired").first()
    assert (one.last_seen, one.first_violation, one.is_reported) == (50, 100, True)
    assert violations.purge_state(state, 35).count() == 3


def test_state_is_versioned(spark, tmp_path):
    state = violations.merge_state(violations.read_state(spark, ""), violations.consolidate_runs(_log(spark, [(10, 1)])), 5)
    violations.write_state(state, str(tmp_path), 1)
    assert violations.read_state(spark, str(tmp_path), 1).count() == 1


def test_main_record_survives_its_steps(spark):
    rows = [(1, "0", "", 9, 5, ""), (1, "", "u", 1, 5, "COMPLETED"), (1, "", "u", 1, 5, "RUNNING"), (2, "0", "", 3, 5, "")]
    df = conform_sacct(spark.createDataFrame(rows, "job_id bigint, job_step string, user string, max_rss bigint, t bigint, state string"))
    got = accounting.sacct_jobs(accounting.sacct_dedup(df)).collect()
    assert [(r.job_id, r.user, r.state, r.n_steps, r.job_max_rss) for r in got] == [(1, "u", "COMPLETED", 1, 9)]


def test_wait_classes_have_no_holes(spark):
    hours = [0, 1, 2, 3, 4, 11, 12, 23, 24, 167, 168, 1000]
    df = spark.createDataFrame([(3600 * x + 1,) for x in hours], "wait bigint")
    r = usage_reports.wait_histogram(df).first()
    assert tuple(r) == (12, 1, 1, 1, 1, 2, 2, 2, 2)


def test_heatmap_clamps(spark):
    df = spark.createDataFrame([(0, 250), (1, 100), (10, 11), (11, 91)], "a bigint, b bigint")
    got = {(r.x, r.y): r.n for r in usage_reports.heatmap(df, "a", "b", 10).collect()}
    assert got == {(0, 9): 2, (0, 1): 1, (1, 9): 1}




def test_streams_are_dealt_out_once_and_before_any_sort(spark, sf_dir):
    """A scan may be one task over a whole table: it must not sort it."""
    from usagelens.operators.streams import clean_streams
    from usagelens.plans.driver_tables import samples

    plan = clean_streams(samples(spark, sf_dir), ["event_id"])._jdf.queryExecution().sparkPlan().toString()
    whole = clean_streams(samples(spark, sf_dir), ["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and whole.count("Exchange") == 1
    below = whole[whole.index("Exchange") :]
    assert "Sort" not in below and "WindowGroupLimit" not in below


def test_accounting_records_are_dealt_out_once_and_before_any_sort(spark, sf_dir):
    from usagelens.operators.accounting import sacct_dedup, sacct_jobs
    from usagelens.plans.inputs import sacct

    plan = sacct_jobs(sacct_dedup(sacct(spark, sf_dir)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    below = plan[plan.index("Exchange") :]
    assert "Sort" not in below and "WindowGroupLimit" not in below


def test_names_meet_a_job_and_not_its_steps(spark, sf_dir):
    """A job's names grow with its users, so summing up its steps must not sort a copy of them for every step."""
    from __spark_entry__ import queries

    shared = ["filter_job_aggregates", "filter_job_flags", "top_commands", "top_jobs_per_user", "user_load_by_command", "user_total_load", "users_jobs_by_host"]
    for name in [*shared, "job_zombie", "job_aggregate", "job_times", "job_liveness"]:
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert not any(f"first({c}#" in plan for c in ("user", "cmd", "hosts")), name


def test_names_of_a_job_are_those_of_its_steps(spark):
    rows = [sample(host=f"h{h}", job=j, epoch=e, pid=1000 + 10 * j + h, user=f"u{h}{j}", cmd=f"c{h}", t=t) for h in (1, 2) for j in (0, 7, 8) for e in [j % 2] for t in (0, 300)]
    s = clean_streams(frame(spark, rows))
    for how in ("epoch", "all", "none"):
        apart = jobs.job_aggregate(jobs.merge_jobs(s, how, names=False), jobs.job_names(s, how))
        along = jobs.job_aggregate(jobs.merge_jobs(s, how))
        assert apart.columns == along.columns
        order = ["job", "host", "solo"]
        assert apart.orderBy(*order).collect() == along.orderBy(*order).collect()


def test_a_scan_deals_rows_out_without_collecting_them(spark, sf_dir):
    """Beyond 200 partitions Spark holds all rows of a writing task in memory, and a scan may be one task."""
    import re

    from usagelens.operators.accounting import sacct_dedup
    from usagelens.operators.streams import clean_streams as cleaned
    from usagelens.plans import inputs
    from usagelens.plans.driver_tables import samples

    def partitions():
        frames = cleaned(samples(spark, sf_dir), ["event_id"]), sacct_dedup(inputs.sacct(spark, sf_dir))
        return [int(n) for f in frames for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\)", f._jdf.queryExecution().executedPlan().toString())]

    for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"):
        before = spark.conf.get(name, None)
        spark.conf.set(name, "600")
        try:
            assert partitions() == [200, 200], name
            rows = [sample(host="h1", pid=1000 + p, t=t) for p in range(40) for t in (0, 0, 300)]
            assert cleaned(frame(spark, rows)).count() == 80
        finally:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    assert partitions() == [int(spark.conf.get("spark.sql.shuffle.partitions"))] * 2
