"""Queries on host sets, GPU sets and scalar functions, over columns of the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from usagelens.functions import gpus as g
from usagelens.functions import hosts as h
from usagelens.functions import scalars as s
from usagelens.plans import inputs
from usagelens.plans import oracle as o
from usagelens.plans.catalog_jobs import sacct_mains
from usagelens.plans.driver_tables import samples, table
from usagelens.plans.registry import query

# Host lists made from orders: racks with one or two ranges, and a single name.
_LIST_SQL = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS a, o_orderkey % 5 AS b FROM orders)"""


def host_lists(spark, d):
    k = F.col("o_orderkey")
    a, b = k % 7, k % 5
    text = F.concat(
        F.lit("c"), b.cast("string"), F.lit("-["), a.cast("string"), F.lit(","), (a + 2).cast("string"), F.lit("-"), (a + 2 + b).cast("string"),
        F.lit("].site,gpu[1-2]-x.r["), b.cast("string"), F.lit("-"), (b + 1).cast("string"), F.lit("].site, solo"), a.cast("string"),
    )
    return table(spark, d, "orders").select(k.alias("k"), text.alias("nodes"))


@query(
    "expand_hosts",
    _LIST_SQL + """ SELECT k, 'c' || b || '-' || unnest(list_concat([a], range(a + 2, a + 3 + b))) || '.site' AS host FROM o
    UNION ALL SELECT k, 'gpu' || n || '-x.r' || (b + m) || '.site' FROM o, (SELECT unnest([1, 2]) AS n), (SELECT unnest([0, 1]) AS m) UNION ALL SELECT k, 'solo' || a FROM o
    UNION ALL SELECT k, 'm' || p || 'x' || q || 'y' || r || 'z' || s || 'u' || a || 'v' || t FROM o, (SELECT unnest([1, 2]) AS p), (SELECT unnest([3, 5]) AS q), (SELECT unnest([6]) AS r),
      (SELECT unnest([8, 9]) AS s), (SELECT unnest([1, 2, 3]) AS t)""",
)
def expand_hosts(spark, d):
    """Lists of names with none, one, two and six ranges."""
    six = F.concat(F.col("nodes"), F.lit(",m[1-2]x[3,5]y[6]z[8-9]u["), (F.col("k") % 7).cast("string"), F.lit("]v[1-3]"))
    return h.expand_hosts(host_lists(spark, d).withColumn("nodes", six), "nodes").select("k", "host")


# A third of the lists is as long as 3,000,000,000 hosts, another third unsound.
@query(
    "expand_hosts_faults",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS a, o_orderkey % 3 AS kind FROM orders)
    SELECT k, CASE kind WHEN 0 THEN 3000000000.0 WHEN 1 THEN NULL ELSE 4.0 + a END AS size, CASE kind WHEN 0 THEN 'too many hosts' WHEN 1 THEN 'unsound' END AS fault,
      CASE kind WHEN 2 THEN 4 + a ELSE 0 END AS hosts FROM o""",
)
def expand_hosts_faults(spark, d):
    """Lists that cannot be expanded give no rows, are told with the reason, and leave the others alone."""
    k = F.col("o_orderkey")
    a = (k % 7).cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("n[1-2999999999],m"), a)).when(k % 3 == 1, F.concat(F.lit("n[9-"), a, F.lit("]"))).otherwise(F.concat(F.lit("x[0-"), a, F.lit("],y[7,9-10]")))
    lists = table(spark, d, "orders").select(k.alias("k"), text.alias("nodes"))
    found = h.expand_hosts(lists, "nodes").groupBy("k").agg(F.count("host").alias("hosts"))
    told = lists.select("k", h.host_list_size("nodes").alias("size"), h.host_list_fault("nodes").alias("fault"))
    return told.join(found, "k", "left").select("k", "size", "fault", F.coalesce("hosts", F.lit(0)).cast("bigint").alias("hosts"))


@query(
    "match_host_lists",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 500 AS a FROM orders) SELECT k, a <= 120 AS one, true AS wild, a <= 77 OR a >= 390 AS ranges FROM o""",
)
def match_host_lists(spark, d):
    """Patterns against lists of up to 3,000,000,000 hosts, decided on the ranges."""
    a = (F.col("o_orderkey") % 500).cast("string")
    lists = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), F.concat(F.lit("n["), a, F.lit("-3000000000].site")).alias("wide"), F.concat(F.lit("m["), a, F.lit("-"), a, F.lit(",600-610]")).alias("narrow")
    )
    low = h.host_list_matches("narrow", ["m[0-77]", "m[390-499]"])
    return lists.select("k", h.host_list_matches("wide", ["n120"], prefix=True).alias("one"), h.host_list_matches("wide", ["n29*7.site"]).alias("wild"), low.alias("ranges"))


# Compression undoes the expansion; the ranges are chosen so that they cannot join.
@query(
    "compress_hosts",
    _LIST_SQL + """, c AS (SELECT k, 'c' || b || '-[' || a || ',' || CASE WHEN b = 0 THEN CAST(a + 2 AS VARCHAR) ELSE (a + 2) || '-' || (a + 2 + b) END || '].site' AS x,
    'gpu[1-2]-x.r' || b || '.site' AS y1, 'gpu[1-2]-x.r' || (b + 1) || '.site' AS y2, 'solo' || a AS z FROM o)
    SELECT k, array_to_string(list_sort([x, y1, y2, z]), ',') AS hosts FROM c""",
)
def compress_hosts(spark, d):
    expanded = h.expand_hosts(host_lists(spark, d), "nodes")
    # Hosts of a list come from several partitions, whose number follows the rows.
    shuffled = expanded.repartition("k", "host")
    return h.compress_hosts(shuffled, ["k"])


@query(
    "match_hosts",
    _LIST_SQL + """, e AS (SELECT k, 'c' || b || '-' || unnest(range(a, a + 3 + b)) || '.site' AS host FROM o) SELECT k, host FROM e
    WHERE regexp_matches(host, '^c(1|2)-[^.]*(\\..*)?$') OR regexp_matches(host, '^c4-(3|4|5)\\.site(\\..*)?$')""",
)
def match_hosts(spark, d):
    k = F.col("o_orderkey")
    a, b = k % 7, k % 5
    each = table(spark, d, "orders").select(k.alias("k"), b.alias("b"), F.explode(F.sequence(a, a + 2 + b)).alias("n"))
    named = each.select("k", F.concat(F.lit("c"), F.col("b").cast("string"), F.lit("-"), F.col("n").cast("string"), F.lit(".site")).alias("host"))
    return h.match_hosts(named, ["c[1-2]-*", "c4-[3-5].site"], prefix=True)


def _set_ops(compare, a, b):
    return [compare(a, b, op).alias(n) for op, n in (("=", "eq"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge"))]


_SETS_SQL = """WITH x AS (SELECT o_orderkey AS k, list_transform(range(o_orderkey % 4), lambda i: 'h' || i) AS a, list_transform(range(o_orderkey % 3, o_orderkey % 3 + o_orderkey % 5), lambda i: 'h' || i) AS b FROM orders)
SELECT k, list_has_all(a, b) AND list_has_all(b, a) AS eq, list_has_all(b, a) AND NOT list_has_all(a, b) AS lt, list_has_all(b, a) AS le, list_has_all(a, b) AND NOT list_has_all(b, a) AS gt, list_has_all(a, b) AS ge FROM x"""


def _two_sets(spark, d):
    k = F.col("o_orderkey")

    def names(first, n):
        numbers = F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda i: F.concat(F.lit("h"), i.cast("string")))

    return table(spark, d, "orders").select(k.alias("k"), names(F.lit(0).cast("bigint"), k % 4).alias("a"), names(k % 3, k % 5).alias("b"))


@query("host_set_compare", _SETS_SQL)
def host_set_compare(spark, d):
    return _two_sets(spark, d).select("k", *_set_ops(h.host_set_compare, F.col("a"), F.col("b")))


@query("string_set_compare", _SETS_SQL)
def string_set_compare(spark, d):
    return _two_sets(spark, d).select("k", *_set_ops(s.string_set_compare, F.reverse("a"), F.col("b")))


# --- GPU sets --------------------------------------------------------------------------------------


@query("gpu_set_union", o.SAMPLES + f" SELECT host, job, event_id % 7 AS part, {o.unknown_absorbs('gpus')} AS gpus FROM samples GROUP BY host, job, part")
def gpu_set_union(spark, d):
    return samples(spark, d).groupBy("host", "job", (F.col("event_id") % 7).alias("part")).agg(g.gpu_set_union("gpus").alias("gpus"))


@query("gpu_set_size", o.SAMPLES + " SELECT event_id, CASE WHEN gpus <> 2147483648 THEN CAST(bit_count(gpus * 5) AS BIGINT) END AS n FROM samples")
def gpu_set_size(spark, d):
    wide = F.when(F.col("gpus") < (1 << 31), F.col("gpus") * 5).otherwise(F.col("gpus"))
    return samples(spark, d).select("event_id", g.gpu_set_size(wide).alias("n"))


_MASKS = "WITH x AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 2147483648 ELSE event_id % 8 END AS a, CASE WHEN event_id % 6 = 0 THEN 2147483648 ELSE user_id % 8 END AS b FROM events), y AS (SELECT *, a < 2147483648 AND b < 2147483648 AS ok FROM x)"


@query(
    "gpu_set_compare",
    _MASKS + " SELECT event_id, a = b AS eq, ok AND a & b = a AND a <> b AS lt, ok AND a & b = a AS le, ok AND a & b = b AND a <> b AS gt, ok AND a & b = b AS ge FROM y",
)
def gpu_set_compare(spark, d):
    e = F.col("event_id")
    a = F.when(e % 9 == 0, F.lit(1 << 31)).otherwise(e % 8)
    b = F.when(e % 6 == 0, F.lit(1 << 31)).otherwise(F.col("user_id") % 8)
    return table(spark, d, "events").select("event_id", *_set_ops(g.gpu_set_compare, a, b))


def _gpu_texts(spark, d):
    e = F.col("event_id")
    two = F.concat((e % 3).cast("string"), F.lit(","), (e % 31).cast("string"))
    text = F.when(e % 5 == 0, "none").when(e % 5 == 1, "unknown").when(e % 35 == 2, "1,31").when(e % 35 == 7, "x").otherwise(two)
    return table(spark, d, "events").select("event_id", text.alias("text"))


_GPU_MASK = """WITH x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 = 1 THEN 2147483648 WHEN event_id % 35 IN (2, 7) THEN NULL
  ELSE (CAST(1 AS BIGINT) << CAST(event_id % 3 AS INTEGER)) | (CAST(1 AS BIGINT) << CAST(event_id % 31 AS INTEGER)) END AS gpus FROM events)"""


@query("gpu_set_parse", _GPU_MASK + " SELECT event_id, gpus FROM x")
def gpu_set_parse(spark, d):
    return _gpu_texts(spark, d).select("event_id", g.gpu_set_parse("text").alias("gpus"))


@query(
    "gpu_set_text",
    _GPU_MASK + """ SELECT event_id, CASE WHEN gpus = 0 THEN 'none' WHEN gpus = 2147483648 THEN 'unknown' ELSE array_to_string(list_filter(range(31), lambda i: (gpus >> CAST(i AS INTEGER)) & 1 = 1), ',') END AS text FROM x WHERE gpus IS NOT NULL""",
)
def gpu_set_text(spark, d):
    parsed = _gpu_texts(spark, d).select("event_id", g.gpu_set_parse("text").alias("gpus")).filter("gpus IS NOT NULL")
    return parsed.select("event_id", g.gpu_set_text("gpus").alias("text"))


@query(
    "gpu_set_cards",
    o.SAMPLES + o.REPORTS + """, k AS (SELECT DISTINCT node, index, uuid, model FROM cards), s AS (SELECT event_id, host, gpus, unnest(range(31)) AS i FROM samples WHERE gpus <> 2147483648)
    SELECT event_id, i AS card_index, uuid, model FROM s LEFT JOIN k ON k.node = s.host AND k.index = i WHERE (gpus >> CAST(i AS INTEGER)) & 1 = 1""",
)
def gpu_set_cards(spark, d):
    cards = inputs.cards(spark, d).select("node", "index", "uuid", "model").distinct()
    return g.gpu_set_cards(samples(spark, d), cards).select("event_id", "card_index", "uuid", "model")


# --- scalars ---------------------------------------------------------------------------------------


@query(
    "trunc_time",
    """WITH x AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, ts FROM events) SELECT event_id, t - t % 1800 AS half_hour, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour,
    t - t % 43200 AS half_day, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, CAST(epoch(date_trunc('week', ts)) AS BIGINT) AS week FROM x""",
)
def trunc_time(spark, d):
    from usagelens.plans.driver_tables import seconds

    df = table(spark, d, "events").select("event_id", seconds("ts").alias("t"))
    return df.select("event_id", *[s.trunc_time("t", u).alias(u.replace("-", "_")) for u in s.BUCKET_SECONDS])


_NOW = dt.datetime(2024, 1, 20, 15, 0, tzinfo=dt.timezone.utc)


@query("relative_date", "SELECT event_id FROM events WHERE epoch(ts) >= epoch(TIMESTAMP '2024-01-13') AND floor(epoch(ts)) <= epoch(TIMESTAMP '2024-01-17 23:59:59') AND epoch(ts) >= epoch(TIMESTAMP '2024-01-02')")
def relative_date(spark, d):
    from usagelens.plans.driver_tables import seconds

    lo, hi, ymd = s.relative_date("1w", _NOW), s.relative_date("3d", _NOW, end=True), s.relative_date("2024-01-02", _NOW)
    df = table(spark, d, "events").withColumn("t", seconds("ts"))
    return df.filter(F.col("t").between(lo, hi) & (F.col("t") >= ymd)).select("event_id")


@query(
    "parse_duration",
    """WITH x AS (SELECT o_orderkey AS k, o_orderkey % 3 AS w, o_orderkey % 7 AS d, o_orderkey % 24 AS h, o_orderkey % 60 AS m FROM orders)
    SELECT k, CASE WHEN k % 4 = 0 THEN w * 604800 + d * 86400 + h * 3600 + m * 60 WHEN k % 4 = 1 THEN d * 86400 + m * 60 WHEN k % 4 = 2 THEN k END AS sec FROM x""",
)
def parse_duration(spark, d):
    k = F.col("o_orderkey")
    w, dd, hh, m = ((k % n).cast("string") for n in (3, 7, 24, 60))
    text = (
        F.when(k % 4 == 0, F.concat(w, F.lit("w"), dd, F.lit("D"), hh, F.lit("h"), m, F.lit("m"))).when(k % 4 == 1, F.concat(dd, F.lit("d"), m, F.lit("M")))
        .when(k % 4 == 2, k.cast("string")).otherwise(F.concat(hh, F.lit("h"), dd, F.lit("d")))
    )
    return table(spark, d, "orders").select(k.alias("k"), s.parse_duration(text).alias("sec"))


@query(
    "format_duration",
    """WITH x AS (SELECT o_orderkey AS k, (o_orderkey * 37 % 900000 + 30) // 60 AS m FROM orders) SELECT k, (m // 1440) || 'd' || (m // 60 % 24) || 'h' || (m % 60) || 'm' AS text FROM x""",
)
def format_duration(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("k"), s.format_duration(k * 37 % 900000).alias("text"))


@query("format_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d') AS date FROM events")
def format_time(spark, d):
    from usagelens.plans.driver_tables import seconds

    df = table(spark, d, "events").select("event_id", seconds("ts").alias("t"))
    return df.select("event_id", *[s.format_time("t", n).alias(n) for n in ("minute", "iso", "date")])


@query("round_up_output", o.SAMPLES + " SELECT event_id, CAST(ceil(cpu_pct) AS BIGINT) AS pct, cpu_kb // 1048576 AS gb FROM samples")
def round_up_output(spark, d):
    return samples(spark, d).select("event_id", s.round_up("cpu_pct").alias("pct"), s.kb_to_gb("cpu_kb").alias("gb"))


@query("parse_gpu_request", o.ACCOUNTING + " SELECT job_id, req_gpus AS gpus FROM sjobs")
def parse_gpu_request(spark, d):
    return sacct_mains(spark, d).select("job_id", s.parse_gpu_request("alloc_res").alias("gpus"))


@query(
    "parse_version",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE o_orderkey % 3 END AS major, CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE o_orderkey % 20 END AS minor,
    CASE WHEN o_orderkey % 5 = 4 THEN 0 WHEN o_orderkey % 5 = 3 THEN o_orderkey % 9 + 100 ELSE o_orderkey % 9 END AS bugfix FROM orders""",
)
def parse_version(spark, d):
    k = F.col("o_orderkey")
    base = F.concat_ws(".", (k % 3).cast("string"), (k % 20).cast("string"), (k % 9).cast("string"))
    text = F.when(k % 5 == 4, F.concat(F.lit("v"), base)).when(k % 5 == 3, F.concat(base, F.lit("-devel"))).otherwise(base)
    return table(spark, d, "orders").select(k.alias("k"), s.parse_version(text).alias("v")).select("k", "v.*")


@query("clamp_outlier", o.SAMPLES + " SELECT event_id, CASE WHEN cpu_pct > 40 THEN 0 WHEN cpu_pct > 20 THEN 20 ELSE cpu_pct END AS v FROM samples")
def clamp_outlier(spark, d):
    return samples(spark, d).select("event_id", s.clamp_outlier("cpu_pct", 20.0).alias("v"))


@query("round_minute", "WITH x AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) SELECT event_id, (t + 30) - (t + 30) % 60 AS minute FROM x")
def round_minute(spark, d):
    from usagelens.plans.driver_tables import seconds

    return table(spark, d, "events").select("event_id", s.round_minute(seconds("ts")).alias("minute"))


@query("job_mark", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND user_id % 2 = 0 THEN '!' WHEN event_id % 2 = 0 THEN '<' WHEN user_id % 2 = 0 THEN '>' ELSE '' END AS mark FROM events")
def job_mark(spark, d):
    return table(spark, d, "events").select("event_id", s.job_mark(F.col("event_id") % 2 == 0, F.col("user_id") % 2 == 0).alias("mark"))
