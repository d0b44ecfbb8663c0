"""Every registered query against its DuckDB counterpart."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry.own_queries()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_scalable(plan):
    """No all-pairs join, no row-at-a-time Python, and no contents in a shuffle."""
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "text#" not in line and "content#" not in line and "html#" not in line


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(repr(tuple(r[i] for i in order)) for r in rows)


# These read the files of the tables, which SQL over the tables cannot see.
FILE_QUERIES = {"inventory", "file_fingerprints"}


def test_every_query_has_its_sql():
    assert set(entry.ORACLE_SQL) == set(QUERIES) - FILE_QUERIES


def test_file_queries(spark):
    want = []
    for name in sorted(os.listdir(SF_DIR)):
        with open(f"{SF_DIR}/{name}", "rb") as f:
            content = f.read()
        want.append((name, len(content), hashlib.sha256(content).hexdigest(), None))
    assert sorted(tuple(r) for r in QUERIES["file_fingerprints"](spark, SF_DIR).collect()) == want
    got = sorted(tuple(r) for r in QUERIES["inventory"](spark, "file://" + SF_DIR).collect())
    assert got == [(name, size, None) for name, size, _, _ in want]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FILE_QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    types = {c[0]: c[1] for c in duck.execute("DESCRIBE " + entry.oracle_sql()[name]).fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    result = duck.execute(entry.oracle_sql()[name])
    want = sorted_rows([d[0] for d in result.description], result.fetchall())
    assert got == want
    assert_scalable(plan_of(df))


def test_entry(spark):
    assert entry.entry(spark).count() == 21


@pytest.mark.parametrize(
    "name, columns",
    [
        ("top_level_dir", "doc_id:bigint,lang:string,source:string"),
        ("last_modified_utc", "doc_id:bigint,lang:string,source:string"),
        ("scan_summary", "doc_id:bigint,text:string,lang:string,source:string"),
        ("size_histogram", "doc_id:bigint,text:string,lang:string,source:string"),
    ],
)
def test_scans_read_only_what_they_need(spark, name, columns):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert plan.count(f"ReadSchema: struct<{columns}>") == plan.count("FileScan") == 1


def test_groups_are_folded_before_the_shuffle(spark):
    plan = plan_of(entry.unnumbered(spark, SF_DIR))
    above, below = plan.split("Exchange hashpartitioning(sha256", 1)
    assert "partial_count" in below and "partial_min" in below and "Exchange" not in below


def test_short_list_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["high_priority"](spark, SF_DIR))
