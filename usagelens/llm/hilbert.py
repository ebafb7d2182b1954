"""Shards along a Hilbert curve through the metadata of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.store import written

DIMS = 3


def _tables(n: int) -> dict[str, list[int]]:
    """The steps of an n-dimensional Hilbert curve: rotations, Gray code, entry points and directions of the sub-cubes."""
    full = (1 << n) - 1

    def turn(x: int, by: int) -> int:
        by %= n
        return ((x >> by) | (x << (n - by))) & full

    gray = [i ^ (i >> 1) for i in range(full + 1)]
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    return {
        "right": [turn(x, d + 1) for d in range(n) for x in range(full + 1)],
        "left": [turn(x, n - (d + 1) % n) for d in range(n) for x in range(full + 1)],
        "rank": [gray.index(x) for x in range(full + 1)],
        "entry": [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(full + 1)],
        "axis": [0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n for w in range(full + 1)],
    }


def hilbert_index(codes: list[Column], bits: int) -> Column:
    """Position on the curve of a cell given by one code of ``bits`` bits for each dimension."""
    n = len(codes)
    tables = {k: F.array(*[F.lit(x) for x in v]) for k, v in _tables(n).items()}

    def at(table: str, i: Column) -> Column:
        return F.get(tables[table], i)

    def step(s: Column, level: Column) -> Column:
        digit = sum((F.call_function("shiftright", c, level).bitwiseAND(1) * (1 << j) for j, c in enumerate(codes)), F.lit(0))
        rank = at("rank", at("right", s["axis"] * (1 << n) + digit.bitwiseXOR(s["entry"])))
        return F.struct(
            (s["index"] * (1 << n) + rank).cast("long").alias("index"),
            s["entry"].bitwiseXOR(at("left", s["axis"] * (1 << n) + at("entry", rank))).cast("int").alias("entry"),
            ((s["axis"] + at("axis", rank) + 1) % n).cast("int").alias("axis"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("axis"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["index"])


def _is_string(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def _string_edges(df: DataFrame, names: list[str], classes: int) -> dict[str, list[str]]:
    """For each string column the least values at or below which 1, 2, ... of ``classes`` equal shares of its rows lie.

    Whole strings are ranked in the order of their bytes.  Rows are counted for each distinct value with a map-side
    combine, the values sorted by range, and only the parts of the sort that hold an edge are summed up value by value.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("_dim"), F.col(c).alias("_value")) for i, c in enumerate(names)]))
    values = df.select(pairs.alias("_pair")).select("_pair.*").filter("_value IS NOT NULL").groupBy("_dim", "_value").agg(F.count(F.lit(1)).alias("_n"))
    # Written, as a second sort could cut its ranges elsewhere.
    values = written(values.repartitionByRange("_dim", "_value").withColumn("_part", F.spark_partition_id()), "values")
    # A row for each part of the sort and column: a few thousand at most.
    parts = values.groupBy("_dim", "_part").agg(F.sum("_n").alias("_in")).selectExpr(
        "_dim", "_part", "_in", "sum(_in) OVER (PARTITION BY _dim ORDER BY _part) - _in AS _before", "sum(_in) OVER (PARTITION BY _dim) AS _all"
    )
    parts = parts.filter(f"(_before + _in) * {classes} div _all > _before * {classes} div _all")
    summed = values.join(parts, ["_dim", "_part"]).withColumn("_upto", F.expr("_before + sum(_n) OVER (PARTITION BY _dim, _part ORDER BY _value)"))
    edges = summed.selectExpr("_dim", "_value", f"(_upto - _n) * {classes} div _all AS _low", f"_upto * {classes} div _all AS _high").filter("_high > _low")
    out: dict[str, list[str]] = {c: [] for c in names}
    for r in sorted(edges.collect(), key=lambda r: (r["_dim"], r["_low"])):
        out[names[r["_dim"]]] += [r["_value"]] * (min(r["_high"], classes - 1) - r["_low"])
    return out


def curve_position(df: DataFrame, dims: list[str], bits: int = 5, accuracy: int = 10000, out: str = "curve") -> DataFrame:
    """Add the position on the Hilbert curve of each row's cell.

    Every dimension is cut at the quantiles of all rows into 2^bits classes.  The quantiles of numbers are
    sketches of fixed size, those of strings are exact and of whole strings; the driver gets 2^bits - 1 values
    for each dimension.  Null and NaN go to the lowest class, and so does everything where a dimension has no values.
    """
    classes = 1 << bits
    strings = [c for c in dims if _is_string(df, c)]
    numbers = [c for c in dims if c not in strings]
    value = {c: F.col(c) for c in strings}
    value |= {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numbers}
    edges = _string_edges(df, strings, classes) if strings else {}
    if numbers:
        steps = [(i + 1) / classes for i in range(classes - 1)]
        cuts = df.agg(*[F.percentile_approx(value[c], steps, accuracy).alias(f"cut{i}") for i, c in enumerate(numbers)]).first()
        edges |= {c: [float(x) for x in cuts[i] or []] for i, c in enumerate(numbers)}
    codes = []
    for c in dims:
        known = F.array(*[F.lit(x) for x in edges[c]]).cast("array<string>" if c in strings else "array<double>")
        below = F.filter(known, lambda e: e < value[c])  # noqa: B023  used at once
        codes.append(F.coalesce(F.size(below), F.lit(0)))
    return df.withColumn(out, hilbert_index(codes, bits))


def shards_by_curve(
    docs: DataFrame, dims: list[str], n_shards: int = 40, text: str = "text", key: str = "doc_id", bits: int = 5
) -> DataFrame:
    """Cut all rows, ordered along the curve, into ``n_shards`` runs whose counts differ by one at most.

    Columns: the key, size (UTF-8 bytes and 16), text_crc32, curve, shard, slot (place in the shard, gapless from 0).
    Rows of one cell are ordered by checksum and key, so equal texts with equal metadata stay together
    where the cut allows it; the law of equal counts goes before.

    Spark sorts by range over (curve, checksum, key), so a hot cell is spread over tasks, and numbers
    the rows of each part; the numbers become global by the parts' counts, one row for each part.
    The sorted numbers are written once, as a second sort could cut its ranges elsewhere.

    Null texts count as empty; a null key is a value like others; repeated rows each get a place of their
    own; an empty table gives an empty result; other columns take no part.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_dim{i}") for i, c in enumerate(dims)],
        (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = curve_position(rows, [f"_dim{i}" for i in range(len(dims))], bits)
    order = ["curve", "text_crc32", "_key"]
    placed = rows.select("_key", "size", "text_crc32", "curve").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), "curve")
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # A row for each part of the sort: a few thousand at most.
    totals = counts.selectExpr("_part", "sum(_n) OVER (ORDER BY _part) - _n AS _before", "sum(_n) OVER () AS _all")
    ranked = placed.withColumn("_part", part).join(totals, "_part").withColumn("_rank", F.col("_before") + local)
    shard = F.expr(f"_rank * {n_shards} div _all")
    first = F.expr(f"(_shard * _all + {n_shards - 1}) div {n_shards}")
    return (
        ranked.withColumn("_shard", shard)
        .withColumn("slot", (F.col("_rank") - first).cast("long"))
        .select(F.col("_key").alias(key), "size", "text_crc32", "curve", F.col("_shard").cast("int").alias("shard"), "slot")
    )
