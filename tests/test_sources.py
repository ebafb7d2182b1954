import pytest
from pyspark.sql import functions as F

from usagelens.sources import envelopes, tables, tagged
from usagelens.streaming import ingest
from usagelens.streaming.log import AppendLog


def lines(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


RECORD = 'v=0.9.1,time=2022-02-03T01:00:30+03:00,host=node-a,cores=16,user=kim,job=12,pid=340,"cmd=sort,uniq",cpu%%=37.5,gpus=2,load=%s,other=1,job=13'


def test_tagged_samples(spark):
    """Quoted commas, an unknown field, a repeated one (the last counts), a heartbeat, and three kinds of rejects."""
    ok = RECORD % ")b"
    heart = "v=0.9.1,time=2022-02-03T01:00:30Z,host=node-a,cmd=_heartbeat_"
    bad = ["v=0.9.1,time=2022-02-03T01:00:30Z,host=node-a,cmd=x", ok.replace("pid=340", "pid=-7"), ok.replace("time=", "when=")]
    good, rejects = tagged.parse_samples_csv(lines(spark, [ok, heart, "", *bad]))
    rows = {r.cmd: r for r in good.collect()}
    assert set(rows) == {"sort,uniq", "_heartbeat_"}
    r = rows["sort,uniq"]
    assert (r.t, r.job, r.epoch, r.pid, r.cpu_pct, r.gpus, r.heartbeat) == (1643839230, 13, 1, 340, 37.5, 4, False)
    assert rows["_heartbeat_"].heartbeat
    assert sorted(x.reason for x in rejects.collect()) == ["bad value: pid", "missing: time", "missing: user"]


def base45(numbers):
    """Numbers in the load alphabets, by definition: least digit first, the first digit from the first alphabet."""
    text = ""
    for n in numbers:
        text += tagged.LOAD_INITIAL[n % 45]
        while n >= 45:
            n //= 45
            text += tagged.LOAD_SUBSEQUENT[n % 45]
    return text


def test_load_columns(spark):
    """The first number is the base of the others; what has other characters or starts amiss is counted."""
    texts = [base45([7, 0, 44, 45, 2024, 91_124]), "0" + base45([1]), "", "\n", base45([3])]
    raw = spark.createDataFrame([(i, "a", x) for i, x in enumerate(texts)], "t bigint, host string, load string")
    cores, errors = tagged.decode_load_column(raw)
    assert {r.t: r.per_core for r in cores.collect()} == {0: [7, 51, 52, 2031, 91_131], 4: []}
    assert errors.first()[0] == 3


def test_records_of_any_length(spark):
    """A field of 100,000 characters, with and without doubled quotes, and a load of 20,000 numbers do not stop a job."""
    long = RECORD.replace("sort,uniq", "c" * 100_000) % base45([1, *range(20_000)])
    quotes = RECORD.replace("sort,uniq", '""' * 50_000) % ")b"
    bare = RECORD.replace('"cmd=sort,uniq"', "cmd=" + "d" * 100_000) % ")b"
    good, rejects = tagged.parse_samples_csv(lines(spark, [long, quotes, bare, "," * 100_000, '"' + "x" * 100_000]))
    assert sorted(len(r.cmd) for r in good.collect()) == [50_000, 100_000, 100_000]
    assert rejects.count() == 2
    cores, errors = tagged.decode_load_column(good)
    assert max(len(r.per_core) for r in cores.collect()) == 20_000 and errors.first()[0] == 0


def test_sacct_dump(spark):
    text = '"JobIDRaw=912.step1",JobID=905_4.step1,User=,State=FAILED by kim,UserCPU=2-01:00:05.25,MaxRSS=5M,TimelimitRaw=3,"AllocTRES=cpu=2,gres/gpu:zx=4"'
    r = tagged.parse_sacct_csv(lines(spark, [text, text.replace("5M", "five")])).collect()
    assert len(r) == 1
    assert (r[0].job_id, r[0].job_step, r[0].array_job_id, r[0].array_task_id, r[0].array_step) == (912, "step1", 905, 4, "step1")
    assert (r[0].state, r[0].user_cpu, r[0].max_rss, r[0].timelimit, r[0].req_gpus) == ("FAILED", 176405, 5120, 180, "zx=4")


def test_violation_log(spark):
    """The mark after the job number goes, other tags are left out."""
    text = 'now=2022-05-06 10:20,jobm=4711<,user=kim,host=node-b,start=2022-05-06 08:00,end=2022-05-06 10:00,"cmd=awk,sed",tag=idle'
    r = tagged.parse_violation_log(lines(spark, [text, text.replace("idle", "busy")]), "idle", peaks=False).collect()
    assert [(x.id, x.cmd, x.user, x.now - x.end, x.end - x.start) for x in r] == [(4711, "awk,sed", "kim", 1200, 7200)]


def test_card_without_a_bit_makes_the_set_unknown(spark):
    proc = spark.createDataFrame([("c", "h", 1, p, 5, 0) for p in (1, 2)], "cluster string, host string, t bigint, pid bigint, job bigint, epoch bigint")
    rows = [("c", "h", 1, 1, 5, 0, 31, "u31", 10, 1.0, 1.0), ("c", "h", 1, 2, 5, 0, 3, "u3", 10, 1.0, 1.0)]
    kind = "cluster string, host string, t bigint, pid bigint, job bigint, epoch bigint, index int, uuid string, gpu_memory bigint, gpu_util double, gpu_memory_util double"
    got = {r.pid: r.gpus for r in tables.join_process_gpu(proc, spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: 1 << 31, 2: 8}


def test_flat_sysinfo_files(spark, tmp_path):
    one = '{\n  "timestamp": "2023-03-09T06:30:00+01:00",\n  "hostname": "m%d",\n  "description": "4x6 AMD Test 77 CPU, 96 GiB, 2x NVIDIA Card X9 @ 40GiB",\n  "mem_gb": 96,\n  "gpu_cards": 2\n}\n'
    (tmp_path / "s.json").write_text(one % 1 + one % 2)
    nodes, cards = envelopes.ingest_sysinfo_flat(spark, str(tmp_path / "s.json"))
    n = nodes.orderBy("node").collect()
    assert [x.node for x in n] == ["m1", "m2"]
    assert (n[0].sockets, n[0].cores_per_socket, n[0].threads_per_core, n[0].cpu_model) == (4, 6, 1, "AMD Test 77 CPU")
    c = cards.filter("node = 'm2'").orderBy("index").collect()
    assert [(x["index"], x.model, x.manufacturer, x.memory) for x in c] == [(i, "NVIDIA Card X9", "NVIDIA", 40 << 20) for i in range(2)]


def test_dated_table_prunes_days(spark, tmp_path):
    df = spark.range(10).select((F.col("id") * 43200).alias("t"), F.concat(F.lit("h"), (F.col("id") % 2).cast("string")).alias("host"))
    tables.write_table(df, str(tmp_path))
    out = tables.read_dated(spark, str(tmp_path), 86400, 3 * 86400, ["h0"])
    assert sorted(r.t for r in out.collect()) == [86400, 172800, 259200]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [" in plan and "GreaterThanOrEqual(t,86400)" in plan


def test_export_rejects_unknown_fields(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert tables.export(df, ["both", "a"], aliases={"both": ["b", "a"]}).columns == ["b", "a"]
    with pytest.raises(ValueError):
        tables.export(df, ["c"])


def test_stream_ingest_counts_errors(spark, tmp_path):
    good = '{"meta":{"version":"1"},"data":{"type":"sample","attributes":{"time":"2024-01-01T00:00:00Z","cluster":"c","node":"n","system":{"cpus":[1,2]},"jobs":[{"job":1,"user":"u","epoch":0,"processes":[{"pid":5,"cmd":"x"}]}]}}}'
    broken = '{"meta":{"version":"1"},"errors":[{"detail":"no"}]}'
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.json").write_text("\n".join([good, broken, "not json"]) + "\n")
    counts = []
    q = ingest.stream_ingest(
        ingest.file_source(spark, str(drop)), "sample", str(tmp_path / "t"), str(tmp_path / "c"), available_now=True,
        on_counts=lambda *c: counts.append(c),
    )
    q.awaitTermination()
    assert counts == [(0, 3, 2)]
    log = AppendLog(spark, str(tmp_path / "t"))
    assert [(x.pid, x.threads, x.num_cores) for x in log.read("samples").collect()] == [(5, 1, 2)]
    assert log.read("cpu_samples").first().per_core == [1, 2]
    assert log.read("gpu_samples") is None
