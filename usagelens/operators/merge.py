"""Merging of sampled streams into one series per key.

Rule.  A step starts at ``m``, the earliest sample of the group not yet used, and takes from every
stream its next sample if that lies in ``[m, m + 10)``.  A stream that has ended counts once more, with
its last sample, in every step with ``last < m <= last + 60``.

Plan.  Samples are first summed per (key, time), with a map-side combine, so what follows sees one row
per instant and not one per process.  Instants fall into bursts, cut where 10 s or more pass without a
sample; no step crosses a cut.  A burst shorter than 10 s in which no stream occurs twice is one step,
which is decided by window functions alone.  Other bursts are read in time order by a small Arrow-batch
scan with constant memory.  Samples that follow the previous one of their stream by less than 10 s stay
separate rows up to there, since only for these the step depends on the stream.

The tail of ended streams is a range frame over the instants before a step: no join.

Keys that may span hosts (a job, everything) are split by the hour instead, see :func:`_by_blocks`: plain instants of any density
need no scan there, and no task holds a whole key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.functions.gpus import normalise
from usagelens.functions.scalars import trunc_time

STEP_WIDTH = 10
CHAIN_MARK = "\x01"
TAIL = 60
BLOCK = 3600

MERGED = "_merged_"
LONG_SUMS = [
    "cpu_kb", "rss_kb", "gpu_kb", "cputime_sec", "threads", "data_read_kb", "data_written_kb",
    "data_cancelled_kb", "rolledup",
]
DOUBLE_SUMS = ["cpu_pct", "cpu_util_pct", "cpu_sampled_pct", "gpu_pct", "gpumem_pct"]
SUMS = LONG_SUMS + DOUBLE_SUMS


def _scan_steps(keys: list[str]):
    """Adds ``step`` to rows sorted by (key, burst, t).

    State is the steps younger than 10 s and, for the same span, the step each instant and each chained
    stream went to.
    """
    group_cols = [*keys, "_burst"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group: tuple | None = None
        active: list[int] = []
        plain: dict[int, int] = {}
        chains: dict[str, tuple[int, int]] = {}
        for pdf in batches:
            out = []
            groups = pdf[group_cols].astype(object).where(pdf[group_cols].notna(), None)
            for g, t, chain in zip(groups.itertuples(index=False, name=None), pdf["t"], pdf["_chain"]):
                if g != group:
                    group, active, plain, chains = g, [], {}, {}
                t = int(t)
                active = [m for m in active if m > t - STEP_WIDTH]
                used = None
                chained = isinstance(chain, str)
                if chained:
                    prev, _, chain = chain.partition(CHAIN_MARK)
                    before = chains.get(chain)
                    used = before[1] if before and before[0] == int(prev) else plain.get(int(prev))
                step = next((m for m in active if used is None or m > used), None)
                if step is None:
                    step = t
                    active.append(t)
                if chained:
                    chains[chain] = (t, step)
                    if len(chains) > 4096:
                        chains = {k: v for k, v in chains.items() if v[0] > t - STEP_WIDTH}
                else:
                    plain[t] = step
                    if len(plain) > 4096:
                        plain = {k: v for k, v in plain.items() if k > t - STEP_WIDTH}
                out.append(step)
            yield pdf.assign(step=pd.Series(out, index=pdf.index, dtype="int64"))

    return scan


def _by_blocks(instants: DataFrame, keys: list[str], windowed: Callable[[WindowSpec], list[Column]]) -> DataFrame:
    """The instants with ``windowed`` columns, ``_burst`` and ``_start`` (the step of a plain instant), hour by hour.

    No task holds more than an hour of a key:

    1. A block is an hour of a key; its windows also see the last minute of the hour before, which is as far as a tail reaches.
    2. What a block does to the steps is a map: an open step covers the first 0 to 9 seconds of it, and for each of these
       ten cases the block's distinct seconds give the second up to which its own last step covers.
    3. The maps of a key, one small row an hour, are composed in the order of time: each block learns where it is entered.
    4. All blocks assign their steps at once, and only the seconds at which steps start travel to the instants.
    """
    own = F.floor(F.col("t") / BLOCK)
    near = F.floor((F.col("t") + TAIL) / BLOCK)
    spread = instants.withColumn("_block", F.explode(F.when(near > own, F.array(own, near)).otherwise(F.array(own))))
    block = [*keys, "_block"]
    by_time = Window.partitionBy(*block).orderBy("t")
    seen = spread.select("*", F.lag("t").over(by_time).alias("_lag"), *windowed(by_time)).filter(F.floor(F.col("t") / BLOCK) == F.col("_block"))
    opens = F.col("_lag").isNull() | (F.col("t") - F.col("_lag") >= STEP_WIDTH)
    seen = seen.withColumn("_opens", F.when(opens, F.col("t"))).drop("_lag")

    begin = F.col("_block") * BLOCK
    times = seen.groupBy(*block).agg(F.array_sort(F.collect_set("t")).alias("times"), F.max("_opens").alias("opened"))
    cases = F.array(*[begin + i for i in range(STEP_WIDTH)])
    exits = F.aggregate("times", cases, lambda ends, t: F.transform(ends, lambda e: F.when(t >= e, t + STEP_WIDTH).otherwise(e)))
    times = times.withColumn("exits", exits)
    # A row of ten numbers for each hour of a key.
    hours = times.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "exits", "opened"))).alias("hours"))
    entry = F.struct(F.lit(None).cast("long").alias("_block"), F.lit(None).cast("long").alias("covered"), F.lit(None).cast("long").alias("burst"))
    none = F.array().cast("array<struct<_block:bigint,covered:bigint,burst:bigint>>")

    def enter(state: Column, hour: Column) -> Column:
        start = hour["_block"] * BLOCK
        covered = F.greatest(F.coalesce(state["covered"], start), start)
        leaves = F.get(hour["exits"], (covered - start).cast("int"))
        here = F.struct(hour["_block"].alias("_block"), covered.alias("covered"), state["burst"].alias("burst"))
        return F.struct(F.array_append(state["all"], here).alias("all"), leaves.alias("covered"), F.coalesce(hour["opened"], state["burst"]).alias("burst"))

    first = F.struct(none.alias("all"), entry["covered"].alias("covered"), entry["burst"].alias("burst"))
    entered = hours.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.inline(F.aggregate("hours", first, enter, lambda s: s["all"]))).withColumnRenamed("_block", "_of__block")
    of = {c: f"_of_{c}" for c in block}
    met = times.join(entered, _same(times, entered, block, of)).select(*block, "times", "covered", "burst")
    one = F.element_at("times", 1)
    began = F.aggregate(
        "times", F.struct(F.col("covered").alias("end"), F.array().cast("array<bigint>").alias("starts")),
        lambda s, t: F.when(t >= s["end"], F.struct((t + STEP_WIDTH).alias("end"), F.array_append(s["starts"], t).alias("starts"))).otherwise(s),
        lambda s: s["starts"],
    )
    # Where a step of the hour before covers the first second, that second names it.
    led = F.when(one < F.col("covered"), F.array(F.struct(one.alias("at"), (F.col("covered") - STEP_WIDTH).alias("start")))).otherwise(F.array().cast("array<struct<at:bigint,start:bigint>>"))
    marks = F.concat(led, F.transform(began, lambda t: F.struct(t.alias("at"), t.alias("start"))))
    marks = met.select(*[F.col(c).alias(of[c]) for c in block], F.inline(marks), F.when(F.lit(True), F.col("burst")).alias("_entered"))
    joined = seen.join(marks, _same(seen, marks, block, of) & (seen["t"] == marks["at"]), "left").drop(*of.values(), "at")
    upto = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    burst = F.coalesce(F.last("_opens", ignorenulls=True).over(upto), F.first("_entered", ignorenulls=True).over(upto))
    return joined.select("*", F.last("start", ignorenulls=True).over(upto).alias("_start"), burst.alias("_burst")).drop("_opens", "_entered", "start", "_block")


def merge_streams(streams: DataFrame, keys: list[str], describe: bool = False, single: str | None = None, blocks: bool = False) -> DataFrame:
    """Merge clean streams per key: one row per (key, step), with the step's time in ``t``.

    ``describe`` adds the group's ``cmd`` and ``user`` (distinct names, sorted, joined by commas) and
    ``hosts`` (sorted array).  ``single`` names a key column that is set for groups of one stream; these
    pass through as they are.  ``blocks`` splits keys by the hour, for keys that may hold a large part of all rows: a step is then
    found by composing what each hour does to an open step.  Only bursts in which a stream has samples less than 10 s apart
    are scanned in order.
    """
    close = F.coalesce(F.col("t") - F.col("prev_t") < STEP_WIDTH, F.lit(False))
    alone = F.col(single).isNotNull() if single else F.lit(False)
    chained = close & ~alone
    # The time before and the stream.  Both branches below use the same columns of what they share, so that
    # Spark runs it once.
    chain = F.concat_ws(CHAIN_MARK, *[F.col(c).cast("string") for c in ("prev_t", "host", "stream_id", "cmd")])
    rows = streams.select(
        *keys,
        "t",
        F.when(chained, chain).alias("_chain"),
        "is_last",
        *SUMS,
        "gpus",
        (F.col("gpu_fail") > 0).alias("gpu_fail"),
        "in_container",
    )
    instants = rows.groupBy(*keys, "t", "_chain", "is_last").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.count(F.lit(1)).alias("n_selected"),
        F.bit_or("gpus").alias("gpus"),
        F.max("gpu_fail").alias("gpu_fail"),
        F.max("in_container").alias("in_container"),
    )

    def tails(by_time: WindowSpec) -> list[Column]:
        """What ended streams add to a step that starts at this instant."""
        before = by_time.rangeBetween(-TAIL, -1)

        def tail(agg, c: str) -> Column:
            return agg(F.when(F.col("is_last"), F.col(c))).over(before).alias(f"_tail_{c}")

        return [*[tail(F.sum, c) for c in [*SUMS, "n_selected"]], tail(F.bit_or, "gpus"), tail(F.max, "gpu_fail"), tail(F.max, "in_container")]

    if blocks:
        placed = _by_blocks(instants, keys, tails)
        tied = placed.filter(F.col("_chain").isNotNull()).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_burst").alias("_of__burst")).distinct()
        on = _same(placed, tied, [*keys, "_burst"], {k: f"_of_{k}" for k in [*keys, "_burst"]})
        bursts = placed.join(tied.withColumn("_tied", F.lit(True)), on, "left").drop(*tied.columns)
        bursts = bursts.withColumn("_hard", F.coalesce("_tied", F.lit(False)) & ~alone).drop("_tied")
        easy = bursts.filter(~F.col("_hard")).withColumn("step", F.when(alone, F.col("t")).otherwise(F.col("_start")))
    else:
        by_time = Window.partitionBy(*keys).orderBy("t")
        lagged = instants.select("*", F.lag("t").over(by_time).alias("_lag"), *tails(by_time))
        opens = F.col("_lag").isNull() | (F.col("t") - F.col("_lag") >= STEP_WIDTH)
        upto = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bursts = lagged.withColumn("_burst", F.last(F.when(opens, F.col("t")), ignorenulls=True).over(upto)).drop("_lag")
        in_burst = Window.partitionBy(*keys, "_burst")
        hard = (F.max("t").over(in_burst) - F.col("_burst") >= STEP_WIDTH) | (F.max(F.col("_chain").isNotNull()).over(in_burst))
        bursts = bursts.select("*", (hard & ~alone).alias("_hard"))
        easy = bursts.filter(~F.col("_hard")).withColumn("step", F.when(alone, F.col("t")).otherwise(F.col("_burst")))
    schema = T.StructType([*bursts.schema.fields, T.StructField("step", T.LongType())])
    scanned = (
        bursts.filter("_hard")
        .repartition(*[F.col(k) for k in keys], F.col("_burst"))
        .sortWithinPartitions(*keys, "_burst", "t")
        .mapInPandas(_scan_steps(keys), schema)
    )
    steps = easy.unionByName(scanned)

    at_start = F.col("t") == F.col("step")

    def with_tail(c: str) -> Column:
        extra = F.max(F.when(at_start, F.col(f"_tail_{c}")))
        return F.sum(c) + F.coalesce(extra, F.lit(0))

    gpus = F.bit_or("gpus").bitwiseOR(F.coalesce(F.max(F.when(at_start, F.col("_tail_gpus"))), F.lit(0)))
    n = with_tail("n_selected")
    summed = {c: with_tail(c) for c in SUMS if c != "rolledup"}
    # Rolled up counts the *other* processes behind a row.
    summed["rolledup"] = with_tail("rolledup") + n - 1
    merged = steps.groupBy(*keys, "step").agg(
        *[summed[c].alias(c) for c in SUMS],
        n.alias("n_selected"),
        normalise(gpus).alias("gpus"),
        F.greatest(F.max("gpu_fail"), F.max(F.when(at_start, F.col("_tail_gpu_fail")))).cast("bigint").alias("gpu_fail"),
        F.greatest(F.max("in_container"), F.max(F.when(at_start, F.col("_tail_in_container")))).alias("in_container"),
    ).withColumnRenamed("step", "t")
    return _described(merged, streams, keys) if describe else merged


def _same(a: DataFrame, b: DataFrame, columns: list[str], names: dict[str, str]) -> Column:
    """Equality of the columns, null with null; ``names`` has those of the second frame that are called otherwise."""
    out = F.lit(True)
    for c in columns:
        out = out & a[c].eqNullSafe(b[names.get(c, c)])
    return out


def _names(streams: DataFrame, keys: list[str]) -> DataFrame:
    """Names and hosts of each group: an aggregate of their own over the streams' first rows, with a map-side combine."""
    return streams.filter("is_first").groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(
        F.array_join(F.array_sort(F.collect_set("cmd")), ",").alias("cmd"),
        F.array_join(F.array_sort(F.collect_set("stream_user")), ",").alias("user"),
        F.array_sort(F.collect_set("host")).alias("hosts"),
    )


def _described(merged: DataFrame, streams: DataFrame, keys: list[str]) -> DataFrame:
    """Adds names and hosts of each group.

    They meet the steps after the last sum, one row a group, so no row before carries names and no window spans a group.
    """
    return _with_names(merged, _names(streams, keys), keys)


def _with_names(rows: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    on = _same(rows, names, keys, {k: f"_of_{k}" for k in keys})
    return rows.join(names, on, "left").select(*rows.columns, "cmd", "user", "hosts")


def _solo() -> Column:
    """Streams without a job are never merged: their own identity is part of the key."""
    own = F.concat_ws("\x01", "host", F.col("stream_id").cast("string"), "cmd")
    return F.when(F.col("stream_job") == 0, own)


JOB_KEY = ["host", "job", "solo"]


def _job_keyed(streams: DataFrame, across: Column) -> DataFrame:
    """Adds the merge key; the host in it is NULL where a job is merged across hosts."""
    return (
        streams.withColumn("job", F.col("stream_job"))
        .withColumn("solo", _solo())
        .withColumn("merge_host", F.when(across & (F.col("stream_job") != 0), None).otherwise(F.col("host")))
    )


def across_hosts(merge: str) -> Column:
    """Which streams are merged across hosts: jobs of ``epoch`` 0 (IDs of the batch system), ``all`` or ``none``."""
    return {"epoch": F.col("stream_epoch") == 0, "all": F.lit(True), "none": F.lit(False)}[merge]


def _merge_jobs(streams: DataFrame, merge: str, names: bool) -> DataFrame:
    keyed = _job_keyed(streams, across_hosts(merge))
    merged = merge_streams(keyed, ["merge_host", "job", "solo"], describe=names, single="solo", blocks=merge != "none")
    return merged.withColumnRenamed("merge_host", "host")


def job_names(streams: DataFrame, merge: str = "epoch") -> DataFrame:
    """``cmd``, ``user`` and ``hosts`` of each merged job, one row a job; :func:`with_job_names` attaches them."""
    keyed = _job_keyed(streams, across_hosts(merge))
    return _names(keyed, ["merge_host", "job", "solo"]).withColumnRenamed("_of_merge_host", "_of_host")


def with_job_names(jobs: DataFrame, names: DataFrame) -> DataFrame:
    """Rows by job (``JOB_KEY``) with the names of :func:`job_names`."""
    return _with_names(jobs, names, JOB_KEY)


def merge_by_host_job(streams: DataFrame, names: bool = True) -> DataFrame:
    """One series per (host, job); streams without a job pass through.

    Without ``names`` steps have no ``cmd``, ``user`` and ``hosts``: a job's list of users may be long, and what sums the
    steps up should not sort it once a step (see :func:`job_names`).
    """
    return _merge_jobs(streams, "none", names)


def merge_by_job(streams: DataFrame, names: bool = True) -> DataFrame:
    """One series per job over all its hosts; ``host`` is NULL and ``hosts`` has the set."""
    return _merge_jobs(streams, "all", names)


def merge_by_epoch(streams: DataFrame, names: bool = True) -> DataFrame:
    """Jobs whose ID the batch system gave (epoch 0) over all hosts, others per host."""
    return _merge_jobs(streams, "epoch", names)


def merge_by_host(streams: DataFrame) -> DataFrame:
    """One series per host over everything on it."""
    merged = merge_streams(streams, ["host"])
    return merged.select("*", F.lit(MERGED).alias("cmd"), F.lit(MERGED).alias("user"), F.lit(0).cast("bigint").alias("job"))


def merge_across_hosts(series: DataFrame, folded: bool) -> DataFrame:
    """One series over all hosts, each host a stream.

    Folded series share their bucket times, so merging them is one aggregation by bucket.
    """
    if folded:
        return _across_folded(series)
    w = Window.partitionBy("host").orderBy("t")
    streams = (
        series.withColumn("stream_id", F.lit(0).cast("bigint"))
        .withColumn("cmd", F.lit(MERGED))
        .withColumn("prev_t", F.lag("t").over(w))
        .withColumn("is_first", F.col("prev_t").isNull())
        .withColumn("is_last", F.lead("t").over(w).isNull())
        .withColumn("_all", F.lit(0))
    )
    return merge_streams(streams, ["_all"], blocks=True).drop("_all")


def _across_folded(series: DataFrame) -> DataFrame:
    """Buckets are at least half an hour apart, so steps are the buckets and no tail reaches the next."""
    return series.groupBy("t").agg(
        *[F.sum(c).alias(c) for c in SUMS if c != "rolledup"],
        (F.sum("rolledup") + F.count(F.lit(1)) - 1).alias("rolledup"),
        normalise(F.bit_or("gpus")).alias("gpus"),
        F.max("gpu_fail").alias("gpu_fail"),
        F.max("in_container").alias("in_container"),
        F.count(F.lit(1)).alias("n_selected"),
    )


FOLD_MEAN_DOUBLE = ["cpu_pct", "cpu_util_pct", "gpu_pct", "gpumem_pct"]
FOLD_MEAN_LONG = ["cpu_kb", "rss_kb", "gpu_kb", "cputime_sec"]
FOLD_SUM = ["threads", "data_read_kb", "data_written_kb", "data_cancelled_kb", "cpu_sampled_pct"]


def fold_sums(steps: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """Tumbling buckets that can be merged further: sums and the number of steps instead of means."""
    sums = [F.sum(c).alias(c) for c in (*FOLD_MEAN_DOUBLE, *FOLD_MEAN_LONG, *FOLD_SUM, "rolledup")]
    rest = [F.bit_or("gpus").alias("gpus"), F.max("gpu_fail").alias("gpu_fail"), F.max("in_container").alias("in_container")]
    buckets = steps.withColumn("_bucket", trunc_time("t", unit)).groupBy(*keys, "_bucket")
    return buckets.agg(*sums, *rest, F.count(F.lit(1)).alias("n_selected")).withColumnRenamed("_bucket", "t")


def roll_up(sums: DataFrame, units: list[str], keys: list[str]) -> DataFrame:
    """Buckets of :func:`fold_sums` merged to those of each of the units, told apart by ``unit``.

    Each unit must be a multiple of the unit that was folded to; every bucket is read once for all of them.
    """
    spread = sums.withColumn("_u", F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), trunc_time("t", u).alias("t")) for u in units])))
    added = [c for c in (*FOLD_MEAN_DOUBLE, *FOLD_MEAN_LONG, *FOLD_SUM, "rolledup", "n_selected")]
    merged = spread.select(*keys, "_u.unit", F.col("_u.t").alias("t"), *[c for c in sums.columns if c not in (*keys, "t")]).groupBy(*keys, "unit", "t")
    return merged.agg(
        *[F.sum(c).alias(c) for c in added], F.bit_or("gpus").alias("gpus"), F.max("gpu_fail").alias("gpu_fail"), F.max("in_container").alias("in_container")
    )


def fold_means(sums: DataFrame) -> DataFrame:
    """The buckets that reports show: means of percentages, sizes and CPU time (whole numbers), sums of threads and I/O."""
    n = F.col("n_selected")
    shown = {c: F.col(c) / n for c in FOLD_MEAN_DOUBLE} | {c: F.expr(f"{c} div n_selected") for c in FOLD_MEAN_LONG}
    shown |= {"rolledup": F.col("rolledup") + n - 1, "gpus": normalise(F.col("gpus"))}
    return sums.select(*[shown.get(c, F.col(c)).alias(c) for c in sums.columns])


def fold_time(steps: DataFrame, unit: str, keys: list[str]) -> DataFrame:
    """Tumbling buckets of one unit as :func:`fold_means` shows them."""
    return fold_means(fold_sums(steps, unit, keys))


def fill_gaps(folded: DataFrame, unit: str, interval: DataFrame, keys: list[str]) -> DataFrame:
    """Zero rows for empty buckets from trunc(from) to trunc(to); ``interval`` has one row (from_t, to_t).

    Buckets outside the interval are kept as they are.
    """
    from usagelens.functions.scalars import BUCKET_SECONDS

    width = F.lit(BUCKET_SECONDS[unit]).cast("bigint")
    ends = interval.select(trunc_time("from_t", unit).alias("_lo"), trunc_time("to_t", unit).alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("t")
    # Every bucket also yields the empty ones after it, the first also those before it.
    # One row of two numbers: the size of the broadcast is fixed.
    spans = folded.join(F.broadcast(ends)).select(
        *folded.columns,
        F.when(F.lag("t").over(w).isNull(), F.least("_lo", "t")).otherwise(F.col("t")).alias("_from"),
        F.coalesce(F.lead("t").over(w) - width, F.greatest("_hi", "t")).alias("_to"),
    )
    spread = spans.withColumn("_at", F.explode(F.sequence("_from", "_to", width)))
    own = F.col("_at") == F.col("t")
    types = dict(folded.dtypes)
    values = [
        F.when(own, F.col(c)).otherwise(F.lit(False) if types[c] == "boolean" else F.lit(0).cast(types[c])).alias(c)
        for c in folded.columns
        if c not in (*keys, "t")
    ]
    return spread.select(*keys, F.col("_at").alias("t"), *values)
