from pyspark.sql import functions as F

from tracelode.llm import copies as C

SCHEMA = "session_row long, source string, type string, data string, h1 string, row string, _salt string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


ROWS = [
    (5, "My-Portal", "main_session", '{"a": 1, "B": ["x", "y"]}'),
    (3, "my portal", "MAIN SESSION", '{"b":["X.","y"],"A":1.0}'),
    (9, "myportal", "mainsession", '"{\\"a\\":1,\\"b\\":[\\"x\\",\\"y\\"]}"'),
    (4, "my portal", "main session", '{"b":["y","x"],"a":1}'),
    (6, "my portal", "main session", '{"b":["x","y"],"a":"1"}'),
    (7, "my portal", "main session", '{"b":["x","y"],"a":1,"c":null}'),
    (8, "my portal", "main session", '{"b":"[\\"x\\", \\"y\\"]","a":1e0}'),
    (10, None, "main session", '{"a":1}'),
    (11, "my portal", None, '{"a":1}'),
    (12, "my portal", "main session", None),
    (13, "my portal", "main session", '{"a":1'),
    (14, "my portal", "main session", ""),
    (20, "s", "t", "{}"),
    (21, "s", "t", " { } "),
    (22, "s", "t", "[]"),
    (23, "s", "t", "true"),
    (24, "s", "t", "1"),
    (25, "s", "t", '{"k":"' + "v" * 300_000 + '"}'),
    (26, "s", "t", '{"K":"' + "V " * 300_000 + '"}'),
]


def test_equal_records(spark, rows):
    assert rows(C.copies(make(spark, ROWS))) == sorted([(3, 5), (3, 8), (3, 9), (20, 21), (25, 26)], key=str)


def test_empty_table(spark, rows):
    assert rows(C.copies(make(spark, []))) == [] and rows(C.records(make(spark, []))) == []


def test_hot_key_holds_a_third(spark):
    data = [(i, "s", "t", '{"n": %d}' % (0 if i % 3 == 0 else i)) for i in range(3000)]
    got = C.copies(make(spark, data)).collect()
    assert sorted((r.kept_row, r.copy_row) for r in got) == [(0, i) for i in range(3, 3000, 3)]


def test_filters_in_slices_lose_no_repeat(spark, monkeypatch):
    monkeypatch.setattr(C, "SHARD_BITS", 10)
    monkeypatch.setattr(C, "MAX_SHARDS", 2)
    data = [(i, "s", "t", '{"n": %d}' % (i // 2 if i < 200 else i)) for i in range(600)] + [(900, None, "t", "{}")]
    assert {tuple(r) for r in C.copies(make(spark, data)).collect()} == {(i, i + 1) for i in range(0, 200, 2)}
    got = {r.kept_row: r.copies for r in C.records(make(spark, data)).collect()}
    assert got == {i: 2 for i in range(0, 200, 2)} | {i: 1 for i in range(200, 600)} | {900: 1}


def test_filter_holds_singletons_back(spark):
    n = 200_000
    rows = spark.range(n).select(F.col("id").alias("row"), F.xxhash64(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.col("id") % 999)).alias("h1")).withColumn("h2", F.xxhash64("h1"))
    got = C.with_filter(rows, n)
    once = got.where("row % 3 > 0")
    assert got.where("row % 3 = 0 and not maybe").isEmpty() and once.where("maybe").count() < 0.02 * once.count()


def test_numbers_by_value():
    assert C.canonical(C.opened('{"a": 100}')) == C.canonical(C.opened('{"a": 1e2}')) != C.canonical(C.opened('{"a": "100"}'))
    assert C.canonical(True) != C.canonical("true") and C.canonical(None) != C.canonical("null")


def test_null_and_unreadable_rows_are_records_too(spark):
    got = {r.kept_row: r.copies for r in C.records(make(spark, ROWS)).collect()}
    assert got == {3: 4, 4: 1, 6: 1, 7: 1, 10: 1, 11: 1, 12: 1, 13: 1, 14: 1, 20: 2, 22: 1, 23: 1, 24: 1, 25: 2} and sum(got.values()) == len(ROWS)
    assert C.records(make(spark, [])).count() == 0


def test_collapsed_query_counts_every_row(spark, sf_dir):
    from tracelode.llm import queries as Q
    from tracelode.runtime import table

    assert Q.p6_collapsed(spark, sf_dir).selectExpr("sum(copies)").first()[0] == table(spark, sf_dir, "session_docs").count()
