"""The append log: many streams in one root, repeated batches, compaction, late rows."""

import pytest
from pyspark.sql import functions as F

from tests.test_merge import sample
from usagelens.operators.streams import dedup_streams
from usagelens.streaming import ingest
from usagelens.streaming.log import AppendLog, Writer

LINE = '{"meta":{"version":"1"},"data":{"type":"sample","attributes":{"time":"2024-01-0%dT00:00:00Z","cluster":"%s","node":"n%d","system":{"cpus":[1,2]},"jobs":[]}}}'


def drop(folder, cluster, days):
    folder.mkdir(exist_ok=True)
    for day in days:
        (folder / f"{day}.json").write_text("".join(LINE % (day, cluster, i) + "\n" for i in range(2)))


def run(spark, tmp_path, cluster, checkpoint):
    ingest.stream_ingest(ingest.file_source(spark, str(tmp_path / cluster), 1), "sample", str(tmp_path / "t"), str(tmp_path / checkpoint), available_now=True, name=cluster).awaitTermination()


def stored(log, table="samples", **span):
    return sorted((r.cluster, r.host, r.t // 86400 - 19722) for r in log.read(table, **span).collect())


def same_in_other_table(log, want):
    """The table of core samples names no cluster."""
    return sorted((r.host, r.t // 86400 - 19722) for r in log.read("cpu_samples").collect()) == sorted(w[1:] for w in want)


def rows(cluster, days):
    return [(cluster, f"n{i}", d) for d in days for i in range(2)]


def test_streams_share_a_root_and_keep_all_rows(spark, tmp_path):
    log = AppendLog(spark, str(tmp_path / "t"))
    for cluster in ("alpha", "beta"):
        drop(tmp_path / cluster, cluster, (1, 2))
        run(spark, tmp_path, cluster, f"c-{cluster}")
    both = sorted(rows("alpha", (1, 2)) + rows("beta", (1, 2)))
    assert stored(log) == both and same_in_other_table(log, both)
    # More comes, on the same checkpoint.
    drop(tmp_path / "beta", "beta", (3,))
    run(spark, tmp_path, "beta", "c-beta")
    assert stored(log) == sorted(both + rows("beta", (3,)))
    # A lost checkpoint: all is read again, nothing is lost, copies go by their stream and time.
    run(spark, tmp_path, "alpha", "c-other")
    assert stored(log) == sorted(both + rows("beta", (3,)) + rows("alpha", (1, 2)))
    # Compaction keeps the rows; dated reads open the days of the interval only.
    assert log.compact("samples") == 7
    assert log.compact("samples") == 0
    assert stored(log) == sorted(both + rows("beta", (3,)) + rows("alpha", (1, 2)))
    assert stored(log, from_t=1704153600, to_t=1704153600 + 86399) == sorted(2 * rows("alpha", (2,)) + rows("beta", (2,)))
    files = log.read("samples", from_t=1704153600, to_t=1704153600 + 86399).inputFiles()
    assert files and all("date=2024-01-02" in f and "stream=compacted" in f for f in files)
    # What is hidden can go; other tables and later batches are not touched.
    drop(tmp_path / "alpha", "alpha", (4,))
    run(spark, tmp_path, "alpha", "c-alpha")
    assert log.vacuum() == 7
    want = sorted(2 * rows("alpha", (1, 2)) + rows("beta", (1, 2, 3)) + rows("alpha", (4,)))
    assert stored(log) == want and same_in_other_table(log, want)
    assert log.compact("samples") == 2 and log.compact("cpu_samples") == 8
    log.vacuum()
    log.vacuum()
    assert stored(log) == want and same_in_other_table(log, want)


def test_a_repeated_batch_counts_once(spark, tmp_path):
    log, writer = AppendLog(spark, str(tmp_path)), Writer("s", "q")
    lines = spark.createDataFrame([(LINE % (1, "c", i),) for i in range(3)], "value string")
    parsed = ingest.batch_tables(lines, "sample")
    log.append("samples", parsed["samples"], writer, 0)  # an attempt that broke off before its commit
    assert log.read("samples") is None
    assert ingest.ingest_batch(log, writer, lines, 0, "sample") == (3, 0)
    assert ingest.ingest_batch(log, writer, lines, 0, "sample") is None
    assert log.read("samples").count() == 3
    with pytest.raises(OSError):
        log.commit(writer, 0, {})
    assert ingest.ingest_batch(log, Writer("s", "other"), lines, 0, "sample") == (3, 0)
    assert log.read("samples").count() == 6


def samples(spark, times, **kw):
    names = ["host", "cmd", "pid", "t", "job", "rolledup", "cpu_pct", "cpu_kb", "rss_kb", "gpu_pct", "gpu_kb"]
    base = sample(rolledup=0, cpu_kb=10, rss_kb=5, gpu_pct=1.0, gpu_kb=2, cpu_pct=2.0) | kw
    return spark.createDataFrame([tuple({**base, "t": t}[n] for n in names) for t in times], "host string, cmd string, pid bigint, t bigint, job bigint, rolledup bigint, cpu_pct double, cpu_kb bigint, rss_kb bigint, gpu_pct double, gpu_kb bigint")


def test_late_rows_end_up_in_their_day(spark, tmp_path):
    log, writer = AppendLog(spark, str(tmp_path)), Writer("s", "q")
    day = 86400
    batches = [samples(spark, [5, 5, day + 10]), samples(spark, [day + 10, 2 * day, 7]), samples(spark, [2 * day, 5, 9, day + 11])]
    late = [ingest.dedup_batch(log, writer, b, i, 3600, None) for i, b in enumerate(batches)]
    assert late == [0, 1, 3]
    assert ingest.dedup_batch(log, writer, batches[1], 1, 3600, None) == 0
    assert [r["facts"]["late"] for r in log.commits().values()] == late
    assert sorted(r.t for r in log.read("samples").collect()) == [5, day + 10, 2 * day]
    assert sorted(r.t for r in log.read("late", 0, day - 1).collect()) == [5, 7, 9]
    want = sorted(r.t for r in dedup_streams(batches[0].union(batches[1]).union(batches[2])).collect())
    assert sorted(r.t for r in ingest.deduplicated(log).collect()) == want == [5, 7, 9, day + 10, day + 11, 2 * day]
    assert ingest.absorb_late(log) == 2
    assert ingest.absorb_late(log) == 0
    assert sorted(r.t for r in log.read("samples").collect()) == want and log.read("late") is None
    # The watermark outlives compaction of the rows.
    log.vacuum()
    assert ingest.dedup_batch(log, writer, samples(spark, [3]), 3, 3600, None) == 1
    assert ingest.dedup_batch(log, writer, samples(spark, []), 4, 3600, None) == 0


def test_late_rows_change_their_bucket(spark, tmp_path):
    log, writer = AppendLog(spark, str(tmp_path)), Writer("s", "q")
    day = 86400
    batches = [
        samples(spark, [0, 10, 3600, 5 * day]), samples(spark, [9 * day, 20]),
        samples(spark, [10, 3600], cpu_pct=7.0, pid=1002, cpu_kb=11).union(samples(spark, [5 * day], host="b")), samples(spark, []),
    ]
    for unit in ("hour", "week"):
        log = AppendLog(spark, str(tmp_path / unit))
        rows = None
        for i, b in enumerate(batches):
            ingest.load_batch(log, writer, b, i, unit)
            ingest.load_batch(log, writer, b, i, unit)
            rows = b if rows is None else rows.union(b)
            sums = rows.groupBy("host", "t").agg(*[F.sum(c).alias(c) for c in ingest.LOAD_SUMS])
            want = sorted(tuple(r) for r in ingest.load_buckets(sums, unit).select("host", "t", *ingest.LOAD_SUMS).collect())
            assert sorted(tuple(r) for r in log.read("load").select("host", "t", *ingest.LOAD_SUMS).collect()) == want


def test_dropped_rows_are_counted(spark, tmp_path):
    listener = ingest.DroppedRows()
    spark.streams.addListener(listener)
    try:
        for i, times in enumerate(([100000], [200000], [5, 6])):
            samples(spark, times).coalesce(1).write.parquet(str(tmp_path / "drop" / f"b{i}"))
            source = spark.readStream.schema(samples(spark, []).schema).parquet(str(tmp_path / "drop" / "*"))
            q = ingest.stream_dedup(source).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10000)
        assert sum(listener.dropped.values()) == 2
    finally:
        spark.streams.removeListener(listener)
