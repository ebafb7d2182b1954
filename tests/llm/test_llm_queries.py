"""Registered queries of this subpackage against their SQL, and the pipeline's stages against plain versions."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import test_bwt, test_token_groups, test_winnow
from tests.test_queries import TABLES, ordered
from usagelens.llm.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(df.collect(), df.columns, sorted(columns)) == ordered(cur.fetchall(), columns, sorted(columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_judges_every_row(spark, sf_dir, name):
    table, key = {"op2": ("pages", "page_id"), "op13": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    times = 32 if name.startswith("op13_") else 1
    got = sorted(r[0] for r in QUERIES[name](spark, sf_dir).select(key).collect())
    assert got == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect() for _ in range(times))


def test_stages(spark, sf_dir, tmp_path):
    """Each stage is judged on the rows the one before has kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    scores = {r.doc_id: r.score for r in QUERIES["op5_subword_quality"](spark, sf_dir).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        texts = {r.doc_id: r.text for r in before.collect()}
        left = {r.doc_id: r for r in after.collect()}
        if name != "encode":
            assert after.columns == columns
        if name == "quality":
            assert set(left) == {d for d, s in scores.items() if s >= 0.3}
        elif name == "near_duplicates":
            assert set(left) == {d for d, (_, c) in test_token_groups.brute(texts.items()).items() if c == d}
        elif name == "repeated_passages":
            gone = test_bwt.brute(texts.items(), 50)
            assert all(left[d].text == texts[d] for d, (_, n, _, _) in gone.items() if not n)
            assert all(abs(len(r.text.encode()) - (gone[d][0] - gone[d][1])) <= 6 * gone[d][2] for d, r in left.items())
            assert set(texts) - set(left) == {d for d, g in gone.items() if g[0] and g[0] - g[1] <= 6 * g[2] and d not in left}
            assert all(r.n_chars == len(r.text) for d, r in left.items() if gone[d][1])
        elif name == "decontaminate":
            assert set(left) == {d for d, v in test_winnow.brute(texts.items(), items).items() if not v[4]}
        else:
            assert set(left) == set(texts) and all(r.round_trip for r in left.values())
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == before.count()
