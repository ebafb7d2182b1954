from pyspark.sql import functions as F

from tests.test_merge import frame, sample
from usagelens.operators.streams import clean_streams, last_n, stream_key


def test_cpu_util_is_the_growth_of_cpu_time(spark):
    """The first sample has no growth yet and shows its own percentage; order of arrival does not matter."""
    rows = [
        sample(pid=81, t=2240, cputime_sec=70, cpu_pct=3.0),
        sample(pid=81, t=2000, cputime_sec=10, cpu_pct=88.5),
        sample(pid=81, t=2440, cputime_sec=220, cpu_pct=4.0),
    ]
    got = [r.cpu_util_pct for r in clean_streams(frame(spark, rows)).orderBy("t").collect()]
    assert got == [88.5, 25.0, 75.0]


def test_rolled_up_stream_id(spark):
    """Without a process number a rolled-up record is told from others by its job."""
    rows = [sample(pid=0, job=655, rolledup=2), sample(pid=0, job=655, rolledup=0)]
    assert sorted(r.stream_id for r in stream_key(frame(spark, rows)).collect()) == [0, 10000655]


def test_backward_cpu_time_is_dropped_against_raw_previous(spark):
    rows = [sample(t=100 * i, cputime_sec=c, cpu_pct=5.0) for i, c in enumerate((100, 50, 60))]
    got = {r.t: r.cpu_util_pct for r in clean_streams(frame(spark, rows)).collect()}
    assert got == {0: 5.0, 200: 10.0}


def test_old_version_uses_cpu_pct_and_duplicates_go(spark):
    rows = [sample(version="0.6.0", t=t, cpu_pct=float(p)) for t, p in ((0, 1), (0, 1), (60, 9))]
    got = {r.t: r.cpu_util_pct for r in clean_streams(frame(spark, rows)).collect()}
    assert got == {0: 1.0, 60: 9.0}


def test_stream_marks_and_last_n(spark):
    rows = [sample(t=t, cputime_sec=t) for t in (0, 300, 600)]
    clean = clean_streams(frame(spark, rows))
    marks = [(r.t, r.is_first, r.is_last, r.prev_t) for r in clean.orderBy("t").collect()]
    assert marks == [(0, True, False, None), (300, False, False, 0), (600, False, True, 300)]
    assert sorted(r.t for r in last_n(clean, 2).select(F.col("t")).collect()) == [300, 600]
