"""Every query with SQL gives what DuckDB gives; the others run with a stable schema."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = [k for k in QUERIES if not k.startswith("p") or k.startswith("p2_")]


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | float):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return str(v) if isinstance(v, datetime.date | datetime.datetime) else v if isinstance(v, str) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(os.path.join(sf_dir, "*.parquet")):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", [k for k in CORE if k in SQL])
def test_same_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cursor.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", [k for k in CORE if k not in SQL])
def test_runs_without_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == QUERIES[name](spark, sf_dir).columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fenced_code_is_stripped_and_kept(spark, tmp_path):
    code = ["```py\nx = 1\n```", "x = '`'", " y = 2 ", "z = 3", "", None]
    spark.createDataFrame([(i, i, c) for i, c in enumerate(code)], "request_id long, item_id long, code string").write.parquet(str(tmp_path / "code_messages.parquet"))
    got = {r.request_id: r.stripped for r in QUERIES["q_strip_fence"](spark, str(tmp_path)).collect()}
    assert got == {0: "x = 1", 1: "x = '`'", 2: "y = 2", 3: "z = 3"}
