"""Registered queries against their SQL on the smallest tables.

By default a selection that touches every operator family; USAGELENS_ALL=1 runs all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
SELECTED = [
    "filter_samples", "system_exclusions", "dedup_streams", "cpu_util", "merge_streams", "merge_by_epoch", "fill_gaps", "jobs", "job_relative",
    "config_asof", "attach_accounting", "sacct_report", "load", "uptime", "profile_buckets", "core_busyness", "process_series", "process_gpus_at",
    "merge_state", "load_with_downtime", "top_consumers", "right_size_maps", "ingest_samples_csv", "ingest_samples_json", "ingest_sacct_json",
    "read_dated", "expand_hosts", "compress_hosts", "gpu_set_cards", "load_rollups", "load_averages", "filter_sacct_hosts", "expand_hosts_faults", "match_host_lists", "stream_load", "stream_dedup",
]
NAMES = list(entry.queries()) if os.environ.get("USAGELENS_ALL") else SELECTED


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def ordered(rows, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple(str(x) for x in r))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(rows, df.columns, sorted(columns)) == ordered(cur.fetchall(), columns, sorted(columns))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
