"""Documents that hold passages of a benchmark, found by winnowed fingerprints."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.store import written

WINDOW = 13
K = 8
BROADCAST_WINDOWS = 200_000
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def words(text: Column) -> Column:
    """Words in lower case, where only A-Z have a lower case."""
    plain = F.octet_length(text) == F.length(text)
    small = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(F.coalesce(small, F.lit("")), F.lit(WORD), F.lit(1))


def _range(last: Column) -> Column:
    """0 to ``last``, nothing if that is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _grams(df: DataFrame, k: int) -> DataFrame:
    """Add ``h``, the hashes of all runs of ``k`` words."""
    df = df.withColumn("w", F.transform("words", lambda x: F.xxhash64(x)))
    return df.withColumn("h", F.transform(_range(F.size("w") - k), lambda i: F.xxhash64(F.slice("w", i + 1, k))))


def _least(p: Column, n: int) -> Column:
    return F.least(*[F.get("h", p + i) for i in range(n)])


def benchmark_windows(items: DataFrame, item: str, text: str, window: int = WINDOW, k: int = K) -> DataFrame:
    """(window words, length, hash, fingerprint, its place in the window): distinct windows of all items.

    The fingerprint is the least hash of a run of ``k`` words in the window, at its last place.  Items
    shorter than a window are one window; those have the hash of all their words as fingerprint.
    """
    n = window - k + 1
    split = _grams(items.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("words")), k)
    split = split.withColumn("at", F.explode(F.when(F.size("words") >= window, _range(F.size("words") - window)).when(F.size("words") > 0, F.array(F.lit(0)))))
    long = F.size("words") >= window
    mark = F.when(long, _least(F.col("at"), n)).otherwise(F.xxhash64(F.col("w")))
    place = F.coalesce(*[F.when(F.get("h", F.col("at") + i) == F.col("mark"), F.lit(i)) for i in reversed(range(n))], F.lit(0))
    return (
        split.withColumn("mark", mark).withColumn("place", F.when(long, place).otherwise(0))
        .select("item", F.slice("words", F.col("at") + 1, window).alias("window"), "mark", "place")
        .withColumn("size", F.size("window")).withColumn("wid", F.xxhash64("window", F.lit(1)))
    )


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, k: int = K, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Per document: its words, the words inside an occurrence of a benchmark window, the items, and the verdict.

    Winnowing: of every ``window - k + 1`` consecutive runs of ``k`` words the least hash is kept, at its last
    place.  A span of ``window`` shared words holds the same runs on both sides, so both keep the same run
    of it, and joining kept runs misses no shared span.  A hit is extended: the document's
    ``window`` words around it must equal the window's words.  Items of fewer words are
    looked up by the hash of all their words, one pass for each length that occurs.

    The fingerprints of documents are made, joined and compared within the scan; only hits are shuffled.
    That takes a broadcast of the windows, done up to ``broadcast_windows`` of them (about 40 MB); with more
    windows the fingerprints are shuffled for the join, and hits are compared after joining the documents back.

    contaminated: at least one word is hit, and ``share`` times the hit words reach the number of words.
    A null or empty text has no words and no hits; null or empty items are no items; rows of one key
    (also null) are taken together; without items nothing is hit; other columns take no part.
    """
    n = window - k + 1
    found = benchmark_windows(items, item, item_text, window, k)
    shapes = found.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length, 13 at most
    short = sorted(r["size"] for r in shapes if r["size"] < window)
    small = sum(r["n"] for r in shapes) <= broadcast_windows
    tests = found.select("mark", "place", "size", "window", "wid").distinct()

    split = _grams(docs.select(F.col(key).alias("key"), words(F.col(text)).alias("words")), k).withColumn("n_words", F.size("words").cast("long"))
    # Starts of windows whose kept run is not the one kept before: it entered last, or the one kept before has left.
    starts = _range(F.size("words") - window)
    now = split.withColumn("p", F.explode(F.concat(F.array(F.lit(-1)), starts)))
    least = _least(F.col("p"), n)
    fresh = (F.col("p") == 0) | (F.get("h", F.col("p") + n - 1) == F.col("mark")) | (F.get("h", F.col("p") - 1) <= F.col("mark"))
    place = F.coalesce(*[F.when(F.get("h", F.col("p") + i) == F.col("mark"), F.lit(i)) for i in reversed(range(n))])
    kept = (
        now.withColumn("mark", F.when(F.col("p") >= 0, least)).filter((F.col("p") < 0) | fresh)
        .select("key", "n_words", "words", (F.col("p") + place).alias("at"), "mark", F.lit(window).alias("size"))
    )
    parts = [kept]
    for length in short:
        runs = F.transform(_range(F.size("w") - length), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("w", i + 1, length)).alias("mark")))  # noqa: B023  used at once
        parts.append(split.select("key", "n_words", "words", F.inline(runs), F.lit(length).alias("size")).select("key", "n_words", "words", "at", "mark", "size"))
    marks = parts[0]
    for p in parts[1:]:
        marks = marks.unionByName(p)

    def equal(m: DataFrame) -> DataFrame:
        start = F.col("at") - F.col("place")
        same = (start >= 0) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("window"))
        return m.withColumn("x", F.when(same, start)).filter(F.col("x").isNotNull() | F.col("at").isNull())

    if small:
        hits = equal(marks.join(F.broadcast(tests), ["mark", "size"], "left")).select("key", "n_words", "x", "size", "wid")
    else:
        pairs = marks.filter("at IS NOT NULL").select(F.col("key").alias("of"), "at", "mark", "size").join(tests, ["mark", "size"])
        some = equal(split.select("key", "words", "n_words").join(pairs, F.col("key").eqNullSafe(F.col("of")))).select("key", "n_words", "x", "size", "wid")
        every = split.select("key", "n_words", F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("wid"))
        hits = every.unionByName(some)

    spans = F.array_sort(F.collect_set(F.when(F.col("x").isNotNull(), F.struct("x", "size"))))
    each = hits.groupBy("key").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.collect_set("wid").alias("wids"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, v: F.struct(
            F.greatest(s["end"], v["x"] + v["size"]).alias("end"),
            (s["n"] + F.greatest(v["x"] + v["size"] - F.greatest(s["end"], v["x"]), F.lit(0))).cast("long").alias("n"),
        ),
        lambda s: s["n"],
    )
    # Two uses follow; a row for each document is written so that the scan is made once.
    each = written(each.select("key", "n_words", covered.alias("n_hit"), "wids"), "hits")
    of = found.select("wid", "item").distinct()
    if small:
        of = F.broadcast(of)
    named = (
        each.filter("n_hit > 0").select("key", F.explode("wids").alias("wid")).join(of, "wid")
        .groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    out = each.drop("wids").join(named.withColumnRenamed("key", "named"), F.col("key").eqNullSafe(F.col("named")), "left").drop("named")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("key").alias(key), "n_words", "n_hit", F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), items_of.alias("items"),
    )
