"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from orderkeep.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([str(r[i]) for i in order] for r in found)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in queries.SQL:
        assert got
        return
    want = duck.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_contract(spark):
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1500


def test_plans(spark):
    """Scans read the key columns only, and validation shuffles once for rows."""
    from orderkeep.functions.keys import key_value
    from orderkeep.operators import validator

    lines = queries._placed(spark, SF, "lineitem", "l_orderkey", "l_linenumber")
    plan = validator.file_stats(lines, key_value(["l_orderkey", "l_linenumber"]))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,_tmp_metadata_row_index:bigint>" in plan
    assert plan.count("Exchange") == 2 and "Python" not in plan  # the second is of a row for each chunk
