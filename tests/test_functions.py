import datetime as dt
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from usagelens.functions import gpus as g
from usagelens.functions import hosts as h
from usagelens.functions import scalars as s
from usagelens.sources.tagged import parse_bytes, parse_elapsed


def evaluate(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_expand_hosts(spark):
    texts = ["r[7-8,11].s[5]", "r[7-8]x[1]y[2-3]", "q[3-4]z", "one.two,k[8-9].z, last", "", None]
    got = evaluate(spark, texts, h.expand_host_list)
    assert got[0] == ["r7.s5", "r8.s5", "r11.s5"]
    assert sorted(got[1]) == ["r7x1y2", "r7x1y3", "r8x1y2", "r8x1y3"]
    assert got[2] == ["q3z", "q4z"]
    assert got[3] == ["one.two", "k8.z", "k9.z", "last"]
    assert got[4] == []
    assert got[5] is None


def test_expand_hosts_with_any_number_of_ranges(spark):
    got = evaluate(spark, ["a[1-2]b[1-2]c[1-2]d[1-2]", "a[1-2]b[1-2]c[1-2]d[1-2]e[1-2]f[1-2]"], h.expand_host_list)
    assert [len(set(x)) for x in got] == [16, 64]
    assert "a2b1c2d1e2f1" in got[1]


def test_unsound_host_lists_are_rejected(spark):
    assert evaluate(spark, ["a[5-1]", "a[1-2", "b,a]1", "a[x]", "a[1-2],b[3-"], h.expand_host_list) == [None] * 5


def test_long_host_lists(spark):
    (got,) = evaluate(spark, ["h" * 100_000 + "[1-2]," + ",".join(f"n{i}" for i in range(20_000))], h.expand_host_list)
    assert len(got) == 20_002


def test_compress_hosts(spark):
    sets = {
        1: ["b2-5", "b2-6", "b2-7", "b22-9", "granite", "b2-" + "7" * 30],
        2: ["b2-8.w", "b2-9.w", "b2-8.v", "b2-9.v", "b2-9.v"],
        3: ["acc-3-x.example", "acc-1-x.example", "acc-2-x.example"],
        4: ["n28.example", "n20.example", "n29.example"],
    }
    rows = [(k, v) for k, vs in sets.items() for v in vs]
    got = dict(h.compress_hosts(spark.createDataFrame(rows, "k int, host string"), ["k"]).collect())
    assert got == {
        1: "b2-" + "7" * 30 + ",b2-[5-7],b22-9,granite",
        2: "b2-[8-9].v,b2-[8-9].w",
        3: "acc-[1-3]-x.example",
        4: "n[20,28-29].example",
    }


def test_match_hosts(spark):
    names = ["w5.a.example", "w2.a.example", "w7.a.example", "w7.a.example.more", "w1", "w1x", "w14.a"]

    def match(patterns, prefix):
        return evaluate(spark, names, lambda c: h.host_matches(c, patterns, prefix))

    assert match(["w5", "w2.a"], True) == [True, True] + [False] * 5
    assert match(["w7.a.example"], False) == [False, False, True] + [False] * 4
    assert match(["w[1-2]*"], True) == [False, True, False, False, True, True, True]
    with pytest.raises(ValueError):
        h.host_pattern_regex("w[2-1]")
    with pytest.raises(ValueError):
        h.host_pattern_regex("w[1")


def test_gpu_sets(spark):
    texts = ["none", "unknown", "1,3", "0,30", "31", "x"]
    masks = evaluate(spark, texts, g.gpu_set_parse)
    assert masks == [0, 1 << 31, 10, (1 << 30) | 1, None, None]
    assert evaluate(spark, masks[:4], g.gpu_set_text, "bigint") == texts[:4]
    assert evaluate(spark, masks[:4], g.gpu_set_size, "bigint") == [0, None, 2, 2]
    df = spark.createDataFrame([(1, 2), (1, 8), (2, 2), (2, 1 << 31)], "k int, v bigint")
    assert dict(df.groupBy("k").agg(g.gpu_set_union("v")).collect()) == {1: 10, 2: 1 << 31}
    pairs = spark.createDataFrame([(2, 10), (10, 10), (1 << 31, 1 << 31), (2, 1 << 31)], "a bigint, b bigint")
    got = pairs.select(*[g.gpu_set_compare("a", "b", op) for op in ("=", "<", "<=")]).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (True, False, True), (True, False, False), (False, False, False)]


def test_durations_and_versions(spark):
    assert evaluate(spark, ["1w2d3h4m", "90", "2h", "", "3x", "4m2h"], s.parse_duration) == [788640, 90, 7200, None, None, None]
    assert evaluate(spark, [29, 30, 90061, 3600 * 24 * 10], s.format_duration, "bigint") == ["0d0h0m", "0d0h1m", "1d1h1m", "10d0h0m"]
    got = evaluate(spark, ["0.12.0", "1.2.3-devel", "0.7", "x", None], s.parse_version)
    assert [tuple(v) for v in got] == [(0, 12, 0), (1, 2, 103), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert evaluate(spark, ["cpu=4,gres/gpu:a100=2,mem=1G", "gres/gpu=3", "cpu=1", None], s.parse_gpu_request) == ["a100=2", "*=3", "", ""]


def test_times(spark):
    # 2024-01-10 was a Wednesday.
    t = int(dt.datetime(2024, 1, 10, 13, 45, 31, tzinfo=dt.timezone.utc).timestamp())
    units = {"half-hour": (10, 13, 30), "hour": (10, 13, 0), "half-day": (10, 12, 0), "day": (10, 0, 0), "week": (8, 0, 0)}
    for unit, (day, hour, minute) in units.items():
        want = int(dt.datetime(2024, 1, day, hour, minute, tzinfo=dt.timezone.utc).timestamp())
        assert evaluate(spark, [t], lambda c, u=unit: s.trunc_time(c, u), "bigint") == [want]
    assert evaluate(spark, [89, 90, 60], s.round_minute, "bigint") == [60, 120, 60]
    now = dt.datetime(2024, 1, 10, 13, tzinfo=dt.timezone.utc)
    assert s.relative_date("2d", now) == s.relative_date("2024-01-08", now)
    assert s.relative_date("1w", now, end=True) == s.relative_date("2024-01-04", now) - 1


def test_elapsed_and_bytes(spark):
    sound = {"0:09": 9, "45:30": 2730, "11:00:01": 39601, "4-00:30:00": 347400, "1-02:03.75": 86523, "0-00:00:00": 0}
    unsound = ["", "9", "5-", "5-9", ":09", "45:", "1:2:3:4", "45:30.", "45:30s", "a:30"]
    assert evaluate(spark, list(sound), parse_elapsed) == list(sound.values())
    assert evaluate(spark, unsound, parse_elapsed) == [None] * len(unsound)
    assert evaluate(spark, ["2048", "1K", "3M", "1.5G", "1", "x"], parse_bytes) == [2, 1, 3072, 1572864, 1, None]


def test_outliers_and_marks(spark):
    assert evaluate(spark, [5.0, 15.0, 25.0], lambda c: s.clamp_outlier(c, 10.0), "double") == [5.0, 10.0, 0.0]


def test_huge_ranges_are_decided_without_expanding(spark):
    texts = ["n[1-3000000000]", "n[0-999999999999999999]x[0-999999999999999999]", "n[1-2]x", "n[5-1]", "n[1-1234567890123456789]", None]
    assert evaluate(spark, texts, h.host_list_size) == [3e9, 1e36, 2.0, None, None, None]
    assert evaluate(spark, texts, h.host_list_fault) == ["too many hosts"] * 2 + [None, "unsound", "unsound", None]
    assert evaluate(spark, texts, h.expand_host_list) == [None, None, ["n1x", "n2x"], None, None, None]
    patterns = [(["n2999999999"], True), (["n3000000001"], False), (["n*77"], True), (["n[3000000000-4000000000]"], True), (["n0", "m*"], False), (["n1*.a"], False)]
    got = evaluate(spark, texts[:1], lambda c: F.array(*[h.host_list_matches(c, p, prefix=True) for p, _ in patterns]))
    assert got == [[want for _, want in patterns]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, nodes string")
    assert sorted(h.expand_hosts(df, "nodes").select("i", "host").collect()) == [(2, "n1x"), (2, "n2x")]


def test_a_name_of_many_hosts_comes_in_blocks(spark):
    df = spark.createDataFrame([("a[0-2,5]b[7-2006,9000]c,z",)], "nodes string")
    got = [r.host for r in h.expand_hosts(df, "nodes").select("host").collect()]
    assert sorted(got) == sorted(["z", *(f"a{x}b{y}c" for x in (0, 1, 2, 5) for y in (*range(7, 2007), 9000))])


def test_lists_match_as_their_hosts_do(spark):
    rnd = random.Random(4)
    bracket = lambda: "[" + ",".join(f"{a}-{a + rnd.choice([0, 3, 40, 900])}" for a in (rnd.choice([0, 1, 8, 95, 990]) for _ in range(rnd.randint(1, 2)))) + "]"
    lists = [f"n{bracket()}" for _ in range(25)] + [f"n{bracket()}.x{rnd.randint(0, 3)}" for _ in range(15)] + [f"n{rnd.randint(0, 3)}{bracket()},k7" for _ in range(10)]
    patterns = ["n7", "n1*0", "n[90-120]", "n*.x[1-2]", "n3[0-9]*", "n[1000-2000]", "k*", "n*99", "n[17,250-251]", "n[0-100000000]"]
    df = spark.createDataFrame([(x,) for x in lists], "v string")
    one = lambda p, prefix: lambda x: h.host_matches(x, [p], prefix)
    for prefix in (False, True):
        near = df.select("v", *[h.host_list_matches("v", [p], prefix).alias(p) for p in patterns]).collect()
        wide = df.select("v", *[F.exists(h.expand_host_list("v"), one(p, prefix)).alias(p) for p in patterns]).collect()
        assert near == wide


def test_number_patterns_match_their_numbers_only():
    for lo, hi in ((0, 0), (0, 9), (7, 13), (27, 1234), (100, 999), (95, 105), (999, 1001), (1, 20000)):
        regex = re.compile(h.host_pattern_regex(f"n[{lo}-{hi}]"))
        assert [n for n in range(hi + 300) if regex.match(f"n{n}")] == list(range(lo, hi + 1))


def test_digit_runs_cover_a_range_once(spark):
    rng = random.Random(3)
    pairs = [sorted((rng.randrange(10 ** rng.randint(1, 4)), rng.randrange(10 ** rng.randint(1, 4)))) for _ in range(60)]
    pairs += [[0, 0], [0, 9], [9, 10], [10, 99], [27, 1234], [199, 200], [999, 1000]]
    df = spark.createDataFrame(pairs, "lo bigint, hi bigint")
    for lo, hi, runs in df.select("lo", "hi", h._digit_runs(F.struct("lo", "hi")).alias("r")).collect():
        symbols = {c: [str(d) for d in range(i // 10, i % 10 + 1)] for i, c in enumerate(h._CLASSES)}
        numbers = [int("".join(x)) for run in runs for x in itertools.product(*[symbols.get(c, [c]) for c in run])]
        assert sorted(numbers) == list(range(lo, hi + 1))


def test_wide_host_lists_are_matched_quickly(spark):
    lists = spark.range(0, 60_000, 1, 1).select(F.concat(F.lit("n["), (F.col("id") % 500).cast("string"), F.lit("-3000000000].site")).alias("v"))
    start = time.monotonic()
    assert lists.filter(h.host_list_matches("v", ["n120"], prefix=True)).count() == 120 * 121
    # 22 s on one task when the places were decided by decimal division.
    assert time.monotonic() - start < 12


def test_compress_hosts_deals_out_by_family_once(spark, sf_dir):
    rows = [(1, "n3"), (1, "n3"), (1, "n4"), (1, "n4"), (1, "m.x"), (1, "m.x"), (None, "n7"), (None, "n7")]
    out = h.compress_hosts(spark.createDataFrame(rows, "k int, host string"), ["k"])
    assert dict(out.collect()) == {1: "m.x,n[3-4]", None: "n7"}
    # By family, and the names by key.
    plan = h.compress_hosts(spark.range(9).selectExpr("id AS k", "'n1' AS host"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2

    from usagelens.plans.catalog_functions import compress_hosts

    # No fixed number of partitions, so that a task does not grow with the tables.
    assert "REPARTITION_BY_NUM" not in compress_hosts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
