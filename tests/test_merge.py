"""The merge rule against a direct evaluation on random groups, and known small cases."""

import random

import pytest
from pyspark.sql import functions as F

from usagelens.operators import merge
from usagelens.operators.merge import fold_time, merge_by_epoch, merge_by_host, merge_by_job, merge_streams
from usagelens.operators.streams import clean_streams
from usagelens.schemas import conform_samples


def direct_steps(streams):
    """The rule, stream by stream: list of (time, chosen samples)."""
    heads = [0] * len(streams)
    out = []
    while True:
        waiting = [s[h][0] for s, h in zip(streams, heads) if h < len(s)]
        if not waiting:
            return out
        m = min(waiting)
        chosen = []
        for i, s in enumerate(streams):
            if heads[i] < len(s):
                if s[heads[i]][0] < m + 10:
                    chosen.append(s[heads[i]])
                    heads[i] += 1
            elif s[-1][0] < m <= s[-1][0] + 60:
                chosen.append(s[-1])
        out.append((m, chosen))


def random_group(rng, n_streams, span, step):
    streams = []
    for _ in range(n_streams):
        t = rng.randrange(span)
        times = []
        for _ in range(rng.randrange(1, 9)):
            times.append(t)
            t += rng.choice(step)
        streams.append([(x, rng.randrange(1, 100)) for x in times])
    return streams


@pytest.mark.parametrize("step", [[1, 3, 9, 10, 11, 40], [10, 12, 30, 70], [1, 2]])
def test_steps_equal_direct_evaluation(spark, step):
    rng = random.Random(7)
    rows, want = [], {}
    for g in range(120):
        host = f"h{g}"
        streams = random_group(rng, rng.randrange(1, 7), rng.choice([15, 60, 400]), step)
        for i, s in enumerate(streams):
            for t, v in s:
                rows.append((host, 1000 + i, t + 1, v, 1 << (i % 3)))
        want.update({(host, m + 1): (len(c), sum(v for _, v in c)) for m, c in direct_steps(streams)})
    df = spark.createDataFrame(rows, "host string, pid bigint, t bigint, cpu_kb bigint, gpus bigint")
    df = conform_samples(df.withColumn("cmd", F.lit("c")).withColumn("version", F.lit("0.6.0")))
    got = {(r.host, r.t): (r.n_selected, r.cpu_kb) for r in merge_by_host(clean_streams(df)).collect()}
    assert got == want
    split = merge_streams(clean_streams(df), ["host"], blocks=True)
    assert {(r.host, r.t): (r.n_selected, r.cpu_kb) for r in split.collect()} == want


@pytest.mark.parametrize("gap", [1, 7, 25])
def test_hours_are_merged_apart(spark, monkeypatch, gap):
    """Long bursts over many blocks, shorter ones than an hour so that steps and tails reach across their edges."""
    rng = random.Random(gap)
    rows, want = [], {}
    for g in range(40):
        host = None if g == 0 else f"h{g}"
        streams = []
        for _ in range(30):
            t, times = rng.randrange(300), []
            for _ in range(rng.randrange(1, 20)):
                times.append(t)
                t += 10 + rng.randrange(gap) * rng.choice((0, 1, 3))
            streams.append([(x, rng.randrange(1, 100)) for x in times])
        rows += [(host, f"x{g}", 1000 + i, t - 150, v, 1 << (i % 3)) for i, s in enumerate(streams) for t, v in s]
        want.update({(host, m - 150): (len(c), sum(v for _, v in c)) for m, c in direct_steps(streams)})
    df = spark.createDataFrame(rows, "of string, host string, pid bigint, t bigint, cpu_kb bigint, gpus bigint")
    df = conform_samples(df.withColumn("cmd", F.lit("c")).withColumn("version", F.lit("0.6.0")), ("of",))
    for block in (3600, 61):
        monkeypatch.setattr(merge, "BLOCK", block)
        got = merge.merge_streams(clean_streams(df), ["of"], blocks=True)
        assert {(r.of, r.t): (r.n_selected, r.cpu_kb) for r in got.collect()} == want


def sample(**kw):
    base = dict(version="0.12.0", host="a", user="u", cmd="c", job=1, pid=1001, epoch=1, t=0, cputime_sec=0, cpu_pct=0.0)
    base.update(kw)
    return base


def frame(spark, rows):
    names = sorted({k for r in rows for k in r})
    kinds = {"version": "string", "host": "string", "user": "string", "cmd": "string", "cpu_pct": "double"}
    schema = ", ".join(f"{n} {kinds.get(n, 'bigint')}" for n in names)
    return conform_samples(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema))


def test_streams_without_job_pass_through(spark):
    rows = [sample(job=0, pid=p, t=t, host="a") for p in (1001, 1002) for t in (0, 4, 300)]
    merged = merge_by_job(clean_streams(frame(spark, rows)))
    assert merged.count() == 6
    assert {r.t for r in merged.collect()} == {0, 4, 300}


def test_epoch_zero_merges_over_hosts(spark):
    rows = [sample(host=h, t=100 + i, epoch=e, job=j, cmd=f"c{i}") for i, h in enumerate("ab") for e, j in ((0, 7), (1, 8))]
    for i, r in enumerate(rows):
        r["pid"] = 1000 + i
    got = {(r.job, r.host): (r.cmd, r.hosts) for r in merge_by_epoch(clean_streams(frame(spark, rows))).collect()}
    assert got == {
        (7, None): ("c0,c1", ["a", "b"]),
        (8, "a"): ("c0", ["a"]),
        (8, "b"): ("c1", ["b"]),
    }


def test_fold_takes_means_and_sums(spark):
    rows = [sample(t=3600 + 300 * i, cpu_kb=v, threads=2) for i, v in enumerate((10, 11, 14))]
    folded = fold_time(merge_by_host(clean_streams(frame(spark, rows))), "hour", ["host"]).collect()
    assert [(r.t, r.cpu_kb, r.threads) for r in folded] == [(3600, 11, 6)]
