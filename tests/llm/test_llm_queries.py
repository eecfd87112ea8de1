"""The SQL twins of this subpackage against DuckDB on the middle tables (on the smallest, tokenizers disagree about the
sources that fall short), and every query once on the smallest."""

import glob
import os

import pytest

from textloom.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/sf0.01/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(ORACLES[name])
    names = sorted(c[0] for c in cur.description)
    df = QUERIES[name](spark, f"{DATA}/sf0.01")
    assert sorted(df.columns) == names
    at = [[c[0] for c in cur.description].index(n) for n in names]
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_and_is_distinct(name, spark):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert df.count() >= 0
    if name.endswith("_found"):
        assert df.count() == df.distinct().count()
