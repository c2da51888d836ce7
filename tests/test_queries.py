"""Every registered query against its SQL check, and a look at its plan."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from readalike.plans.oracle import ORACLE as CHECKS
from readalike.plans.queries import registered

SF_DIR = "/root/testdata/sf0.001"
QUERIES = registered()
WITHOUT_CHECK: set[str] = set()
# a size-checked broadcast of at most SCAN_QUERIES texts
NESTED_LOOP = {"search_books_by_word"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    clean = [tuple(v + 0.0 if isinstance(v, float) and not math.isnan(v) else v for v in row)
             for row in picked]
    return sorted(clean, key=lambda row: tuple((v is not None, str(v)) for v in row))


def test_every_query_has_a_check():
    assert set(QUERIES) - set(CHECKS) == WITHOUT_CHECK
    assert set(CHECKS) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(CHECKS) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    if name not in NESTED_LOOP:
        assert "BroadcastNestedLoopJoin" not in plan
    if name not in CHECKS:
        assert got
        return
    cursor = duck.execute(CHECKS[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert table(got, df.columns) == table(cursor.fetchall(), names)


def test_entry(spark):
    assert entry_points.entry(spark).columns[:4] == ["seed_isbn", "strategy", "rank", "isbn"]


def test_lists_are_cut_before_the_shuffle(spark):
    plan = QUERIES["co_rated_top"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_lists_of_stored_edges_are_made_without_a_shuffle(spark):
    plan = QUERIES["readers_also"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange") == plan.count("BroadcastExchange")


def test_scans_are_pruned(spark):
    plan = QUERIES["item_similarity"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<isbn:string,user_id:int,rating:int>" in plan
    assert "PushedFilters: [IsNotNull(user_id), IsNotNull(isbn)]" in plan
