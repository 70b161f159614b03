"""Every registered query with SQL equals DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from readloom.plans import oracle
from readloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_sql(spark, sf_dir, db, name):
    out = QUERIES[name](spark, sf_dir)
    columns = sorted(out.columns)
    cursor = db.execute(oracle.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    want = sorted(repr([r[i] for i in place]) for r in cursor.fetchall())
    got = sorted(repr([r[c] for c in columns]) for r in out.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle.SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_consensus_votes_on_all_reads(spark, sf_dir, db):
    """The registered SQL votes on one template in ten; without its filter it must give the query's lines."""
    sql = oracle.SQL["consensus"]
    assert sql.count("ord % 40 < 4") <= 1
    cursor = db.execute(f"SELECT name, line, text FROM ({sql.replace('ord % 40 < 4', 'true')})")
    assert sorted(map(tuple, QUERIES["consensus"](spark, sf_dir).select("name", "line", "text").collect())) == sorted(cursor.fetchall())
