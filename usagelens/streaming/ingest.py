"""Ingestion as a stream, de-duplication on the way in, and load kept up to date."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from usagelens.functions.scalars import BUCKET_SECONDS, trunc_time
from usagelens.operators.merge import MERGED
from usagelens.operators.streams import STREAM, dedup_streams, stream_key
from usagelens.sources import envelopes
from usagelens.sources.tables import utc_date
from usagelens.streaming.log import COMPACTED, AppendLog, Part, Writer

DAY = 86400

# The topics of a cluster are named <cluster>.<kind>.
KINDS = ["sample", "sysinfo", "jobs", "cluster"]


def file_source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A file drop: one envelope per line."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def kafka_source(spark: SparkSession, servers: str, cluster: str, kind: str, **options: str) -> DataFrame:
    """One topic of a cluster.  Needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.option("subscribe", f"{cluster}.{kind}").load().selectExpr("CAST(value AS STRING) AS value")


def _dated(df: DataFrame, time: str = "time", host: str = "node") -> DataFrame:
    """Adds ``t`` and ``host``, by which tables are laid out."""
    out = df.withColumn("t", F.unix_seconds(F.try_to_timestamp(F.col(time)))).filter(F.col("t").isNotNull())
    return out if "host" in out.columns else out.withColumn("host", F.col(host))


def batch_tables(lines: DataFrame, kind: str) -> dict[str, DataFrame]:
    """The tables one kind of envelope feeds."""
    if kind == "sample":
        return {
            "samples": envelopes.parse_samples_json(lines),
            "node_samples": envelopes.parse_node_samples(lines),
            "disk_samples": envelopes.parse_disk_samples(lines),
            "cpu_samples": envelopes.parse_cpu_samples(lines),
            "gpu_samples": envelopes.parse_gpu_samples(lines),
        }
    if kind == "jobs":
        return {"sacct": envelopes.parse_sacct_json(lines).withColumn("host", F.col("node_list"))}
    if kind == "sysinfo":
        nodes, cards = envelopes.parse_sysinfo(lines)
        return {"nodes": _dated(nodes), "cards": _dated(cards)}
    if kind == "cluster":
        attributes, partitions, nodes = envelopes.parse_cluster_state(lines)
        names = {"cluster_attributes": attributes, "cluster_partitions": partitions, "cluster_nodes": nodes}
        return {n: _dated(df, host="cluster") for n, df in names.items()}
    raise ValueError(f"unknown kind: {kind}")


def _run(source: DataFrame, checkpoint: str, available_now: bool, process: Callable[[DataFrame, int], None]) -> StreamingQuery:
    writer = source.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _writer(batch: DataFrame, name: str) -> Writer:
    """The stream's name and the id of the query, which its checkpoint keeps."""
    return Writer(name, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))


def ingest_batch(log: AppendLog, writer: Writer, batch: DataFrame, batch_id: int, kind: str) -> tuple[int, int] | None:
    """Parses a batch of envelopes once and commits its rows to the log: envelopes read and dropped; None if it stood there."""
    if log.is_committed(writer, batch_id):
        return None
    parsed = envelopes.opened(batch, kind).persist()
    try:
        counts = envelopes.envelope_errors(parsed, kind).first()
        parts = {name: log.append(name, df, writer, batch_id) for name, df in batch_tables(parsed, kind).items()}
        log.commit(writer, batch_id, parts, envelopes=counts["envelopes"], dropped=counts["dropped"])
        return counts["envelopes"], counts["dropped"]
    finally:
        parsed.unpersist()


def stream_ingest(
    source: DataFrame, kind: str, root: str, checkpoint: str, available_now: bool = False,
    on_counts: Callable[[int, int, int], None] | None = None, name: str = "stream",
) -> StreamingQuery:
    """Parse and append every micro-batch to the tables of the append log under ``root``.

    Any number of streams, each with a ``name`` (a cluster's, say) and a checkpoint of its own, write to one root.  Erroneous envelopes
    are dropped and counted.  A repeated batch counts once; after a lost checkpoint the source is read again and its rows
    stand twice, until :func:`usagelens.operators.streams.dedup_streams` drops them: nothing is ever written over.
    Read with :meth:`usagelens.streaming.log.AppendLog.read`.
    """
    log = AppendLog(source.sparkSession, root)

    def process(batch: DataFrame, batch_id: int) -> None:
        counts = ingest_batch(log, _writer(batch, name), batch, batch_id, kind)
        if counts and on_counts:
            on_counts(batch_id, *counts)

    return _run(source, checkpoint, available_now, process)


def _watermark(log: AppendLog, writer: Writer, batch_id: int, delay_s: int) -> int | None:
    """What the batches before saw last, less the delay: from their commit records, so a repeated batch gets the same."""
    seen = [r["facts"]["max_t"] for r in log.commits().values() if (r["stream"], r["query"]) == (writer.stream, writer.query) and r["batch"] < batch_id]
    seen = [t for t in seen if t is not None]
    return max(seen) - delay_s if seen else None


def dedup_batch(log: AppendLog, writer: Writer, batch: DataFrame, batch_id: int, delay_s: int, tie: list[str] | None) -> int:
    """Commits a batch's rows: timely ones that the table does not have yet, and late ones to a table of their own.

    Only stored rows within the delay are compared; the log finds their days.  Returns the number of late rows.
    """
    if log.is_committed(writer, batch_id):
        return 0
    rows = (batch if "stream_id" in batch.columns else stream_key(batch)).persist()
    try:
        bounds = rows.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
        if bounds["hi"] is None:
            log.commit(writer, batch_id, {}, max_t=None, late=0)
            return 0
        mark = _watermark(log, writer, batch_id, delay_s)
        timely = rows if mark is None else rows.filter(F.col("t") >= mark)
        fresh = dedup_streams(timely, tie)
        stored = log.read("samples", bounds["lo"] if mark is None else max(mark, bounds["lo"]), bounds["hi"])
        if stored is not None:
            key = [*STREAM, "t"]
            same = [fresh[c].eqNullSafe(stored[c]) for c in key]
            fresh = fresh.join(stored.select(*key), same[0] & same[1] & same[2] & same[3], "left_anti")
        parts = {"samples": log.append("samples", fresh, writer, batch_id)}
        if mark is not None and bounds["lo"] < mark:
            parts["late"] = log.append("late", rows.filter(F.col("t") < mark), writer, batch_id)
        late = parts["late"].rows if "late" in parts else 0
        log.commit(writer, batch_id, parts, max_t=bounds["hi"], late=late)
        return late
    finally:
        rows.unpersist()


def stream_dedup_log(
    stream: DataFrame, root: str, checkpoint: str, delay_s: int = 7200, name: str = "dedup", tie: list[str] | None = None,
    available_now: bool = False, on_late: Callable[[int, int], None] | None = None,
) -> StreamingQuery:
    """De-duplicated samples in an append log, with a way for late rows.

    The watermark of a batch is the latest time of the batches before less ``delay_s``.  Timely rows go to the table ``samples`` unless it has
    their (stream, time); late ones, which a window of bounded size cannot judge, go to the table ``late`` and are counted
    in the commit record and by ``on_late``.  :func:`deduplicated` merges both by day.
    """
    log = AppendLog(stream.sparkSession, root)

    def process(batch: DataFrame, batch_id: int) -> None:
        late = dedup_batch(log, _writer(batch, name), batch, batch_id, delay_s, tie)
        if late and on_late:
            on_late(batch_id, late)

    return _run(stream, checkpoint, available_now, process)


def deduplicated(log: AppendLog, from_t: int | None = None, to_t: int | None = None, tie: list[str] | None = None) -> DataFrame | None:
    """The samples of an interval with late rows in their days, one per (stream, time): equals the batch operator on all rows."""
    tables = [df for df in (log.read(t, from_t, to_t) for t in ("samples", "late")) if df is not None]
    if not tables:
        return None
    rows = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    return dedup_streams(rows, tie)


def absorb_late(log: AppendLog, tie: list[str] | None = None) -> int:
    """Moves late rows into their days of ``samples``: these days are rewritten, others are not read.  Returns the number of days."""
    parts = log.visible("late")
    days = sorted({d for _, own in parts.values() for d in own})
    if not days:
        return 0
    late = log.read("late")
    stored = log.read("samples", *_span(days))
    rows = late if stored is None else late.unionByName(stored)
    rows = dedup_streams(rows.filter(utc_date(F.col("t")).cast("string").isin(days)), tie)
    writer = Writer(COMPACTED, uuid.uuid4().hex)
    merged = log.append("samples", rows, writer, 0, log.replacing("samples", days))
    # The same record hides the late rows: an empty part that stands for their days.
    log.commit(writer, 0, {"samples": merged, "late": Part("", 0, days, list(parts))})
    return len(days)


def _span(days: list[str]) -> tuple[int, int]:
    first, last = (int(dt.datetime.fromisoformat(f"{d}T00:00:00+00:00").timestamp()) for d in (days[0], days[-1]))
    return first, last + DAY - 1


class DroppedRows(StreamingQueryListener):
    """Counts, per query, the rows that stateful operators dropped as later than the watermark."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.dropped[str(progress.id)] = self.dropped.get(str(progress.id), 0) + sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stream_dedup(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Drop copies of a (stream, time) that arrive within the delay; state older than it is forgotten."""
    keyed = stream if "stream_id" in stream.columns else stream_key(stream)
    timed = keyed.withColumn("event_time", F.timestamp_seconds("t")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark([*STREAM, "t"])


def stream_load(stream: DataFrame, unit: str = "hour", delay: str = "1 hour") -> DataFrame:
    """Load per host in buckets: sums per sample instant, then their mean per bucket, in append mode.

    A bucket is emitted when the watermark passes its end.  State is one row per (host, instant) younger
    than the delay and one per (host, open bucket).
    """
    timed = stream.withColumn("event_time", F.timestamp_seconds("t")).withWatermark("event_time", delay)
    value = "cpu_util_pct" if "cpu_util_pct" in stream.columns else "cpu_pct"
    instants = timed.groupBy("host", F.window("event_time", "1 second")).agg(
        F.sum(value).alias("cpu_pct"), F.sum("cpu_kb").alias("cpu_kb"), F.sum("rss_kb").alias("rss_kb"),
        F.sum("gpu_pct").alias("gpu_pct"), F.sum("gpu_kb").alias("gpu_kb"),
    )
    # A week starts on Monday; the epoch was a Thursday.
    offset = "4 days" if unit == "week" else "0 seconds"
    width = f"{BUCKET_SECONDS[unit]} seconds"
    buckets = instants.groupBy("host", F.window(F.window_time("window"), width, width, offset)).agg(
        F.avg("cpu_pct").alias("cpu_pct"),
        *[F.expr(f"sum({c}) div count(1)").alias(c) for c in ("cpu_kb", "rss_kb", "gpu_kb")],
        F.avg("gpu_pct").alias("gpu_pct"),
    )
    return buckets.select(
        "host", F.unix_seconds("window.start").alias("t"), "cpu_pct", "cpu_kb", "rss_kb", "gpu_pct", "gpu_kb",
        F.lit(MERGED).alias("cmd"),
    )


LOAD_SUMS = ["cpu_pct", "cpu_kb", "rss_kb", "gpu_pct", "gpu_kb"]


def load_buckets(instants: DataFrame, unit: str) -> DataFrame:
    """Buckets from sums per (host, time): sums of one instant are added first, so parts of it may come in any number of rows."""
    whole = instants.groupBy("host", "t").agg(*[F.sum(c).alias(c) for c in LOAD_SUMS])
    buckets = whole.groupBy("host", trunc_time("t", unit).alias("_t")).agg(
        F.avg("cpu_pct").alias("cpu_pct"), *[F.expr(f"sum({c}) div count(1)").alias(c) for c in ("cpu_kb", "rss_kb", "gpu_kb")], F.avg("gpu_pct").alias("gpu_pct"),
    )
    return buckets.withColumnRenamed("_t", "t").withColumn("cmd", F.lit(MERGED))


def load_batch(log: AppendLog, writer: Writer, batch: DataFrame, batch_id: int, unit: str) -> int:
    """Adds a batch's sums per (host, time) to the log and rewrites the days of the buckets they fall into; the number of those days.

    A batch is deltas: a row of an instant that is there adds to its sums, whenever it comes.
    """
    if log.is_committed(writer, batch_id):
        return 0
    value = "cpu_util_pct" if "cpu_util_pct" in batch.columns else "cpu_pct"
    sums = batch.groupBy("host", "t").agg(F.sum(value).alias("cpu_pct"), *[F.sum(c).alias(c) for c in LOAD_SUMS[1:]])
    added = log.append("instants", sums, writer, batch_id)
    if not added.days:
        log.commit(writer, batch_id, {})
        return 0
    # What the buckets of these days are made of: the days, or the weeks around them.
    touched = batch.select(trunc_time("t", unit).alias("b")).distinct()
    ends = touched.agg(F.min("b").alias("lo"), F.max("b").alias("hi")).first()
    days = sorted(r[0] for r in touched.select(utc_date(F.col("b")).cast("string")).distinct().collect())
    before = log.read("instants", _span(days)[0], ends["hi"] + BUCKET_SECONDS[unit] - 1)
    fresh = log.spark.read.option("basePath", added.path).parquet(added.path).drop("date")
    whole = fresh if before is None else fresh.unionByName(before)
    buckets = load_buckets(whole, unit).filter(utc_date(F.col("t")).cast("string").isin(days))
    log.commit(writer, batch_id, {"instants": added, "load": log.append("load", buckets, writer, batch_id, log.replacing("load", days))})
    return len(days)


def stream_load_log(stream: DataFrame, root: str, checkpoint: str, unit: str = "hour", name: str = "load", available_now: bool = False) -> StreamingQuery:
    """Load per host in buckets as an upserted table: every batch, late rows too, changes the buckets it falls into.

    The table ``instants`` of the log holds sums per (host, time) and batch, ``load`` the buckets; a batch rewrites the days
    it touches, so both stay as the batch operator would give them.  Unlike :func:`stream_load`, which emits a bucket once, there is no watermark.
    """
    log = AppendLog(stream.sparkSession, root)
    return _run(stream, checkpoint, available_now, lambda batch, batch_id: load_batch(log, _writer(batch, name), batch, batch_id, unit) and None)
