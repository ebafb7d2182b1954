"""Tagged text records ``name=value,...``: process samples, accounting dumps and violation logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.functions.gpus import gpu_set_parse
from usagelens.functions.scalars import parse_gpu_request
from usagelens.schemas import conform_sacct, conform_samples

HEARTBEAT = "_heartbeat_"

# Field name in the record, column, kind.
SAMPLE_TAGS = [
    ("v", "version", "text"),
    ("time", "t", "time"),
    ("host", "host", "text"),
    ("cmd", "cmd", "text"),
    ("user", "user", "text"),
    ("cores", "num_cores", "whole"),
    ("memtotalkib", "memtotal_kb", "whole"),
    ("job", "job", "whole"),
    ("epoch", "epoch", "whole"),
    ("pid", "pid", "whole"),
    ("ppid", "ppid", "whole"),
    ("cpu%", "cpu_pct", "real"),
    ("cpukib", "cpu_kb", "whole"),
    ("rssanonkib", "rss_kb", "whole"),
    ("gpus", "gpus", "gpus"),
    ("gpu%", "gpu_pct", "real"),
    ("gpumem%", "gpumem_pct", "real"),
    ("gpukib", "gpu_kb", "whole"),
    ("gpufail", "gpu_fail", "whole"),
    ("cputime_sec", "cputime_sec", "whole"),
    ("rolledup", "rolledup", "whole"),
    ("load", "load", "text"),
    ("gpuinfo", "gpuinfo", "text"),
]

# The positional form, always of version 0.6.0.
UNTAGGED_FIELDS = [
    ("t", "time"), ("host", "text"), ("num_cores", "whole"), ("user", "text"), ("job", "whole"), ("cmd", "text"),
    ("cpu_pct", "real"), ("cpu_kb", "whole"),
]
UNTAGGED_VERSION = "0.6.0"

# The two digit alphabets of per-core load, 45 digits each.
LOAD_INITIAL = "(){}[]<>+-abcdefghijklmnopqrstuvwxyz!@#$%^&*_"
LOAD_SUBSEQUENT = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ~|';:.?/`"
LOAD_BASE = 45

# Accounting dump field, column, kind.
SACCT_TAGS = [
    ("v", "version", "text"), ("User", "user", "text"), ("JobName", "job_name", "text"),
    ("Account", "account", "text"), ("Layout", "layout", "text"), ("Reservation", "reservation", "text"),
    ("NodeList", "node_list", "text"), ("Partition", "partition", "text"),
    ("Start", "start", "time"), ("End", "end", "time"), ("Submit", "submit", "time"),
    ("SystemCPU", "system_cpu", "elapsed"), ("UserCPU", "user_cpu", "elapsed"), ("AveCPU", "ave_cpu", "elapsed"),
    ("MinCPU", "min_cpu", "elapsed"), ("Suspended", "suspended", "elapsed"),
    ("AveDiskRead", "ave_disk_read", "bytes"), ("AveDiskWrite", "ave_disk_write", "bytes"),
    ("AveRSS", "ave_rss", "bytes"), ("AveVMSize", "ave_vmsize", "bytes"), ("MaxRSS", "max_rss", "bytes"),
    ("MaxVMSize", "max_vmsize", "bytes"), ("ReqMem", "req_mem", "bytes"),
    ("ElapsedRaw", "elapsed", "whole"), ("ReqCPUS", "req_cpus", "whole"), ("ReqNodes", "req_nodes", "whole"),
]


def parse_time(text: Column) -> Column:
    """ISO time with offset to Unix seconds; NULL if it does not parse."""
    return F.unix_seconds(F.try_to_timestamp(text))


def parse_elapsed(text: Column) -> Column:
    """``[d-][hh:]mm:ss[.fraction]`` to seconds; NULL otherwise."""
    pattern = r"^(?:(\d+)-)?(?:(\d+):)?(\d+):(\d+)(?:\.\d+)?$"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, i).try_cast("bigint"), F.lit(0))

    total = part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)
    return F.when(text.rlike(pattern), total)


def parse_bytes(text: Column) -> Column:
    """A size in bytes, or with a suffix K, M or G, to KB, rounded up; NULL otherwise."""
    unit = F.regexp_extract(text, r"([KMG])$", 1)
    factor = F.when(unit == "G", 1 << 30).when(unit == "M", 1 << 20).when(unit == "K", 1 << 10).otherwise(1)
    number = F.regexp_replace(text, r"[KMG]$", "").try_cast("double")
    return F.ceil(number * factor / 1024).cast("bigint")


def _whole(text: Column) -> Column:
    n = text.try_cast("bigint")
    return F.when(n >= 0, n)


def _real(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (x.between(-1e300, 1e300)), x)


PARSERS = {
    "text": lambda c: c,
    "time": parse_time,
    "whole": _whole,
    "real": _real,
    "gpus": gpu_set_parse,
    "elapsed": parse_elapsed,
    "bytes": parse_bytes,
}


def split_fields(line: Column) -> Column:
    """Comma-separated fields; a quoted field may hold commas, doubled quotes stand for one.

    Repetitions are possessive: Java matches those in a loop, not by recursion, so fields may have any length.
    """
    raw = F.regexp_extract_all(line, F.lit(r'("(?:[^"]++|"")*+"|[^,]++)'), F.lit(1))
    unquoted = lambda x: F.when(
        x.startswith('"'), F.replace(F.regexp_replace(x, r'^"|"$', ""), F.lit('""'), F.lit('"'))
    ).otherwise(x)
    return F.transform(raw, unquoted)


def computed_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """The kept columns and new ones, evaluated once per row.

    A filter on a projected column is otherwise pushed below the projection with the whole expression
    copied into it, and again into the next one.  Spark does not push through the output of a generator, so
    the values are made as a one-element array that is inlined.
    """
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(values)))


def tagged_fields(lines: DataFrame) -> DataFrame:
    """``_line`` and its fields with a name, in reverse order: ``_k`` has their names, ``_v`` their values."""
    df = lines.select(F.col("value").alias("_line")).filter(F.trim("_line") != "")
    named = F.filter(split_fields(F.col("_line")), lambda x: F.instr(x, "=") > 1)
    df = computed_once(df, ["_line"], {"_f": F.reverse(named)})
    value = lambda x: F.substring(x, F.instr(x, "=") + 1, F.length(x))
    return computed_once(df, ["_line"], {"_k": F.transform("_f", lambda x: F.substring_index(x, "=", 1)), "_v": F.transform("_f", value)})


def tags_of(names: list[str]) -> Column:
    """Texts of the named fields in this order, NULL where absent; of a repeated name the last counts.

    One look-up over a list of names, not one expression for each: those make a method that is too long for the JVM to compile.
    """
    return F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.get("_v", F.array_position(F.col("_k"), n) - 1))


def _parsed(lines: DataFrame, tags: list[tuple[str, str, str]], more: tuple[str, ...] = ()) -> DataFrame:
    """Columns of the tags, the texts of ``more`` fields as they are, and ``_bad``: names of unparseable fields."""
    texts = {f"_t_{c}": n for n, c, _ in tags} | {n: n for n in more}
    found = computed_once(tagged_fields(lines), ["_line"], {"_texts": tags_of(list(texts.values()))})
    df = found.select("_line", *[F.col("_texts")[i].alias(c) for i, c in enumerate(texts)])
    values = {c: PARSERS[kind](F.col(f"_t_{c}")) for _, c, kind in tags}
    df = computed_once(df, df.columns, values)
    bad = [F.when(F.col(f"_t_{c}").isNotNull() & F.col(c).isNull(), F.lit(n)) for n, c, kind in tags if kind != "text"]
    return df.select("_line", *[c for _, c, _ in tags], *more, F.array_compact(F.array(*bad)).alias("_bad"))


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def parse_samples_csv(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tagged sample records (``value``) to samples and rejects (``line, reason``).

    A bad value or a missing mandatory field drops the record, an unknown field drops that field only.
    """
    df = _parsed(lines, SAMPLE_TAGS)
    missing = F.array_compact(
        F.array(
            *[F.when(_empty(c), F.lit(name)) for name, c in (("v", "version"), ("host", "host"), ("cmd", "cmd"))],
            F.when(F.col("t").isNull(), F.lit("time")),
            F.when(_empty("user") & (F.coalesce("cmd", F.lit("")) != HEARTBEAT), F.lit("user")),
        )
    )
    reason = (
        F.when(F.size("_bad") > 0, F.concat(F.lit("bad value: "), F.array_join("_bad", " ")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, " ")))
    )
    judged = df.withColumn("_reason", reason)
    good = judged.filter(F.col("_reason").isNull()).withColumn("heartbeat", F.col("cmd") == HEARTBEAT)
    rejects = judged.filter(F.col("_reason").isNotNull())
    return (
        conform_samples(good, ("load", "gpuinfo")),
        rejects.select(F.col("_line").alias("line"), F.col("_reason").alias("reason")),
    )


def ingest_samples_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_samples_csv(spark.read.text(path))


def parse_samples_untagged(lines: DataFrame) -> DataFrame:
    """Positional records of at least eight fields; the job number serves as pid.  Bad records are dropped."""
    df = lines.filter(F.trim("value") != "").select(split_fields(F.col("value")).alias("_f"))
    df = df.filter(F.size("_f") >= len(UNTAGGED_FIELDS))
    cols = [PARSERS[kind](F.col("_f")[i]).alias(name) for i, (name, kind) in enumerate(UNTAGGED_FIELDS)]
    df = df.select(*cols).dropna()
    df = df.withColumn("pid", F.col("job")).withColumn("version", F.lit(UNTAGGED_VERSION))
    return conform_samples(df.filter((F.col("host") != "") & (F.col("cmd") != "")))


def ingest_samples_untagged(spark: SparkSession, path: str) -> DataFrame:
    return parse_samples_untagged(spark.read.text(path))


def load_numbers(text: Column) -> Column:
    """Base-45 text to its numbers; NULL if it has other characters or none.

    A number starts with a character of the first alphabet and goes on, least digit first, in the second.
    """
    initial = "[" + re.escape(LOAD_INITIAL) + "]"
    subsequent = "[" + re.escape(LOAD_SUBSEQUENT) + "]"
    number = f"{initial}{subsequent}*+"

    def value(token: Column) -> Column:
        def digit(c: Column, i: Column) -> Column:
            alphabet = F.when(i == 0, F.lit(LOAD_INITIAL)).otherwise(F.lit(LOAD_SUBSEQUENT))
            place = F.power(F.lit(float(LOAD_BASE)), i).cast("bigint")
            return (F.call_function("instr", alphabet, c) - 1) * place

        return F.aggregate(F.transform(F.split(token, ""), digit), F.lit(0).cast("bigint"), lambda a, b: a + b)

    tokens = F.regexp_extract_all(text, F.lit(f"({number})"), F.lit(1))
    either = "[" + re.escape(LOAD_INITIAL) + re.escape(LOAD_SUBSEQUENT) + "]"
    return F.when(text.rlike(f"^{initial}{either}*+$"), F.transform(tokens, value))


def decode_load_column(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``load`` text to per-core rows, and one row with the number of undecodable ones.

    The first number is the base that is added to all others.
    """
    numbers = raw.filter(F.col("load").isNotNull()).select("t", "host", "load")
    numbers = computed_once(numbers, ["t", "host"], {"_n": load_numbers(F.col("load"))})
    errors = numbers.agg(F.count_if(F.col("_n").isNull()).alias("undecodable"))
    base = F.col("_n")[0]
    cores = F.transform(F.slice("_n", F.lit(2), F.size("_n")), lambda v: v + base)
    return numbers.filter(F.col("_n").isNotNull()).select("t", "host", cores.alias("per_core")), errors


def parse_sacct_csv(lines: DataFrame) -> DataFrame:
    """Accounting dump records to rows; records with a bad value are dropped."""
    untyped = ("JobIDRaw", "JobID", "ExitCode", "State", "TimelimitRaw", "AllocTRES")
    df = _parsed(lines, SACCT_TAGS, untyped).filter(F.size("_bad") == 0)
    raw_id = F.col("JobIDRaw")
    shown_id = F.coalesce("JobID", F.lit(""))
    step = F.coalesce(F.regexp_extract(raw_id, r"^\d+\.(.*)$", 1), F.lit(""))
    special = r"^(\d+)([_+])(\d+)(?:\.(.*))?$"
    kind = F.regexp_extract(shown_id, special, 2)

    def shown(i: int, of: str) -> Column:
        return F.when(kind == of, F.regexp_extract(shown_id, special, i).try_cast("bigint")).otherwise(0)

    def shown_step(of: str) -> Column:
        return F.when(kind == of, F.regexp_extract(shown_id, special, 4)).otherwise("")

    exit_code = F.substring_index(F.coalesce("ExitCode", F.lit("0")), ":", 1)
    rows = df.withColumns(
        {
            "job_id": F.regexp_extract(raw_id, r"^(\d+)", 1).try_cast("bigint"),
            "job_step": step,
            "array_job_id": shown(1, "_"),
            "array_task_id": shown(3, "_"),
            "array_step": shown_step("_"),
            "het_job_id": shown(1, "+"),
            "het_job_offset": shown(3, "+"),
            "het_step": shown_step("+"),
            "state": F.substring_index(F.coalesce("State", F.lit("")), " ", 1),
            "exit_code": exit_code.try_cast("bigint"),
            "timelimit": _whole(F.col("TimelimitRaw")) * 60,
            "req_gpus": parse_gpu_request(F.col("AllocTRES")),
            "t": F.coalesce("end", F.lit(0)),
        }
    )
    return conform_sacct(rows.filter(F.col("job_id").isNotNull()))


def ingest_sacct_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_sacct_csv(spark.read.text(path))


# Violation log field, column, kind.
VIOLATION_TAGS = [
    ("tag", "tag", "text"), ("user", "user", "text"), ("host", "host", "text"), ("cmd", "cmd", "text"),
    ("cpu-peak", "cpu_peak", "real"), ("gpu-peak", "gpu_peak", "real"), ("rcpu-avg", "rcpu_avg", "real"),
    ("rcpu-peak", "rcpu_peak", "real"), ("rmem-avg", "rmem_avg", "real"), ("rmem-peak", "rmem_peak", "real"),
]


def _minute_time(text: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")))


def parse_violation_log(lines: DataFrame, wanted: str, peaks: bool = True) -> DataFrame:
    """Report records with the tag to rows; the mark after the job number is dropped.

    Records without a needed field go; with ``peaks`` the numbers are needed too.
    """
    tags = VIOLATION_TAGS if peaks else VIOLATION_TAGS[:4]
    df = _parsed(lines, tags, ("now", "jobm", "start", "end")).filter((F.col("tag") == wanted) & (F.size("_bad") == 0))
    out = df.select(
        _minute_time(F.col("now")).alias("now"),
        F.regexp_extract(F.col("jobm"), r"^(\d+)", 1).try_cast("bigint").alias("id"),
        "host", "user", "cmd",
        _minute_time(F.col("start")).alias("start"),
        _minute_time(F.col("end")).alias("end"),
        *[c for _, c, kind in tags if kind == "real"],
    )
    return out.dropna()


def ingest_violation_log(spark: SparkSession, path: str, wanted: str, peaks: bool = True) -> DataFrame:
    return parse_violation_log(spark.read.text(path), wanted, peaks)
