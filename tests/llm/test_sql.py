import glob
import os

import duckdb
import pytest

from tracelode.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for p in glob.glob(os.path.join(sf_dir, "*.parquet")):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = Q.queries()[name](spark, sf_dir)
    got = sorted(tuple(r[x] for x in sorted(df.columns)) for r in df.collect())
    cursor = c.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert got == sorted(tuple(r[names.index(x)] for x in sorted(names)) for r in cursor.fetchall()) and got


@pytest.mark.parametrize("name", [k for k in sorted(Q.queries()) if k not in Q.oracle_sql()])
def test_runs_with_a_stable_schema(spark, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    assert df.count() >= 0 and df.columns
