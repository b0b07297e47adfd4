"""Queries with SQL give the rows that DuckDB gives, over the small tables and over a few odd ones."""

import glob
import os

import duckdb
import pytest

from orderkeep.llm import queries

SF = "/root/testdata/sf0.001"


def same(spark, folder, name):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    df = queries.queries()[name](spark, str(folder))
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    rows = lambda own, found: sorted([str(r[own.index(n)]) for n in sorted(names)] for r in found)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_small_tables(spark, name):
    same(spark, SF, name)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_odd_tables(spark, tmp_path, name):
    docs = [(i, " ".join(f"w{(i * j) % 9}" for j in range(i % 40)), "en", [None, "a", "b"][i % 3], 0) for i in range(120)] + [(200, None, None, None, None), (201, "", "en", "a", 0), (202, "A B\tc", "en", "zz", 5), (203, "a b C", "en", "zz", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(i, "u", "x" * (i % 7)) for i in range(60)] + [(100, None, None), (101, "u", "é漢" * 40_000), (102, "u", "é漢" * 40_000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same(spark, tmp_path, name)


def test_all_registered():
    names = [n for n in queries.queries() if n not in queries.parts.QUERIES]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries()) and set(queries.parts.SQL) == set(queries.parts.QUERIES)
