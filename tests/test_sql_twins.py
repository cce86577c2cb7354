"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from veridoc.plans import corpus_plans, derived_plans, retrieval_plans, stream_plans, text_plans

SF = "/root/testdata/sf0.001"
CASES = [(m, n) for m in (text_plans, corpus_plans, derived_plans, retrieval_plans, stream_plans) for n in m.QUERIES if n in m.SQL]
#: Queries that SQL cannot state, by the test file that holds them against brute force or a batch twin.
OTHERS = {
    "test_whole_jobs.py": ("chunk_rows_all", "manifest_chunks", "redact_stream", "metric_windows_stream"),
    "test_brute_force.py": ("mask_identifiers", "extractive_answer", "chunk_documents", "chunk_text_udtf", "incremental_prep", "rate_limit_audit"),
}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{v:.5f}" if isinstance(v, float) else str(v)


def test_queries_without_sql_are_tested_elsewhere():
    without = {n for m in (text_plans, corpus_plans, derived_plans, retrieval_plans, stream_plans) for n in m.QUERIES if n not in m.SQL}
    assert without == {n for names in OTHERS.values() for n in names}
    for file, names in OTHERS.items():
        text = open(os.path.join(os.path.dirname(__file__), file)).read()
        assert all(f'"{n}"' in text for n in names)


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query(spark, duck, module, name):
    out = module.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in out.collect()]
    found = duck.sql(module.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted(rows) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
