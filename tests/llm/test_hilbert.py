import random

from pyspark.sql import functions as F

from usagelens.llm.hilbert import curve_position, hilbert_index, shards_by_curve

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size string, shard int, _key int"
DIMS = ["source", "lang", "n_chars"]


def test_curve_visits_each_cell_once_by_single_steps(spark):
    for n, bits in ((2, 4), (3, 3)):
        cells = spark.range(1 << (n * bits))
        codes = [F.shiftright("id", bits * j).bitwiseAND((1 << bits) - 1).cast("int") for j in range(n)]
        rows = cells.select(hilbert_index(codes, bits).alias("h"), *[c.alias(f"c{j}") for j, c in enumerate(codes)]).orderBy("h").collect()
        assert [r[0] for r in rows] == list(range(1 << (n * bits)))
        assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:], strict=True)) == 1 for x, y in zip(rows, rows[1:]))


def check_law(rows, n_shards):
    counts = [sum(r.shard == s for r in rows) for s in range(n_shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(n_shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_law_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = shards_by_curve(docs, DIMS, 40).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    check_law(rows, 40)
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)


def test_hot_values_nulls_and_repeats(spark):
    data = [(i % 7 if i < 20 else None, None if i % 5 == 0 else "x" * (i % 3), "hot", None if i % 4 else "en", None, "s", 1, 2) for i in range(53)]
    rows = shards_by_curve(spark.createDataFrame(data, SCHEMA), DIMS, 8).collect()
    assert len(rows) == 53
    check_law(rows, 8)
    assert {r.size for r in rows} <= {16, 17, 18}


def test_fewer_rows_than_shards_and_empty(spark):
    rows = shards_by_curve(spark.createDataFrame([(1, "é", "a", "b", 1, "s", 0, 0)], SCHEMA), DIMS, 40).collect()
    assert [(r.shard, r.slot, r.size) for r in rows] == [(0, 0, 18)]
    assert shards_by_curve(spark.createDataFrame([], SCHEMA), DIMS, 40).collect() == []


def test_codes_follow_the_quantiles(spark):
    """One dimension alone: the curve is the number line, cut into classes of equal counts."""
    rows = spark.range(3200).select((F.col("id") * 7 % 3200).alias("v"))
    got = sorted((r.v, r.curve) for r in curve_position(rows, ["v"], bits=4).collect())
    assert [c for _, c in got] == sorted(c for _, c in got)
    counts = [sum(c == k for _, c in got) for k in range(16)]
    assert min(counts) > 150 and max(counts) < 250


def test_curve_keeps_neighbours_together(spark, sf_dir):
    """A filter on one dimension has to open clearly fewer shards than all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shards_by_curve(docs, DIMS, 16).join(docs.select("doc_id", "source"), "doc_id").collect()
    touched = [len({r.shard for r in placed if r.source == s}) for s in {r.source for r in placed}]
    by_chance = [min(16, sum(r.source == s for r in placed)) for s in {r.source for r in placed}]
    assert sum(touched) < 0.8 * sum(by_chance)


def test_whole_strings_are_ranked(spark):
    """Sources that differ after byte 7 only: as good as short names for a filter on source."""
    rng = random.Random(3)
    data = [(i, "t", rng.randrange(20), rng.choice("ab"), rng.randrange(1000)) for i in range(2000)]
    touched = {}
    for name in ("https://site.org/{:02d}", "{:02d}"):
        docs = spark.createDataFrame([(i, t, name.format(s), lang, n) for i, t, s, lang, n in data], "doc_id long, text string, source string, lang string, n_chars long")
        rows = shards_by_curve(docs, DIMS, 40).collect()
        touched[name] = [len({r.shard for r in rows if data[r.doc_id][2] == s}) for s in range(20)]
        check_law(rows, 40)
    assert len(set(map(tuple, touched.values()))) == 1
    assert sum(touched["{:02d}"]) < 0.4 * 20 * 40


def test_classes_of_strings_equal_a_plain_count(spark):
    rng = random.Random(5)
    words = ["common_crawl_" + "".join(rng.choices("abé", k=rng.randrange(5))) for _ in range(300)] + ["common_crawl_hot"] * 200 + [None] * 9
    got = {(r.v, r.curve) for r in curve_position(spark.createDataFrame([(w,) for w in words], "v string").repartition(5), ["v"], bits=4).collect()}
    ordered = sorted((w for w in words if w is not None), key=str.encode)
    edges = [ordered[-(-k * len(ordered) // 16) - 1] for k in range(1, 16)]
    assert got == {(w, 0 if w is None else sum(e.encode() < w.encode() for e in edges)) for w in words}
