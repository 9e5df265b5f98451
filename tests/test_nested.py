import json

from tracelode.operators import nested as N

SCHEMA = "row_id long, doc string, path string, record_id string, _json string"


def nodes(spark, values, levels=12):
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in enumerate(values)], SCHEMA)
    return sorted((r.record_id, r.node_path, r.parent_path) for r in N.json_nodes(df, "row_id", "doc", "t", levels).collect())


def brute(values):
    out = []

    def walk(i, v, path, parent):
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                return
            if not isinstance(v, dict | list):
                return
        if isinstance(v, dict):
            out.append((i, path, parent))
            for k, x in v.items():
                walk(i, x, f"{path}.{k}", path)
        elif isinstance(v, list):
            for k, x in enumerate(v):
                walk(i, x, f"{path}[{k}]", parent)

    for i, s in enumerate(values):
        try:
            v = json.loads(s)
        except (TypeError, ValueError):
            continue
        walk(i, v, "$", "")
    return sorted(out)


def deep(n):
    v = {"end": 1}
    for k in range(n):
        v = {"x": v, "y": [[{}, [v]]]} if k % 5 == 0 else [v] if k % 3 else {"t": json.dumps(v)}
    return json.dumps(v)


VALUES = [
    None, "", " ", "{}", " {} ", "[]", "[{}]", '[[{"a":{}}]]', "1", '"text"', "null", "true", '{"a":', '{"a":1} x', "{'a':1}", '{"a":{"b":null,"c":[1,"{}",{"d":"[{}]"}]}}', json.dumps('{"a":{}}'), json.dumps(json.dumps('{"a":{}}')),
    '{"a.b":{"C":{}},"":{"é":{}}}', '{"a":"{broken","b":"{}","c":" [ {} ] "}', '{"k":"' + "v" * 300_000 + '","o":{}}', '{"same":{"x":{}},"Same":{}}', '[{"n":NaN}]'[:-1], deep(6), deep(9), '{"a":1,"a":{"b":{}}}',
]


def test_against_brute_force(spark):
    assert nodes(spark, VALUES) == brute(VALUES)


def test_any_depth(spark):
    assert nodes(spark, VALUES, levels=2) == brute(VALUES)


def test_empty_table_and_repeated_rows(spark):
    assert nodes(spark, []) == []
    df = spark.createDataFrame([(1, '{"a":[{"b":1,"c":{}}]}')], "row_id long, doc string")
    t = N.related_table(N.json_nodes(df, "row_id", "doc", "t"), "$.a[]").collect()
    assert [(r.record_id, r.parent_path, r.fields) for r in t] == [(1, "$", {"b": "1"})]


def test_tables_hold_every_object_and_value(spark):
    values = [*VALUES, '{"t":["a",1,"1",null,[true,{"x":[]}]],"s":"[not json","o":"{","n":1.50,"big":12345678901234567890123,"f":{"k":"[1]"}}', "[1,{}]", '{"\\ud800":"\\ud800"}', '{"i[0]":{}}']
    df = spark.createDataFrame([(i, v, "a") for i, v in enumerate(values)], "row_id long, doc string, record_id string")
    got = N.tables(df, "row_id", "doc", "t").collect()
    assert sorted((r.record_id, r.node_path, r.parent_path) for r in got if r.fields is not None and r.record_id < len(VALUES)) == brute(VALUES)
    rows = {(r.shape, r.node_path, r.parent_path, r.fields, r.item) for r in got if r.record_id == len(VALUES)}
    assert rows == {
        ("$", "$", "", '{"s":"[not json","o":"{","n":1.50,"big":12345678901234567890123}', None), ("$.f", "$.f", "$", "{}", None), ("$.f.k[]", "$.f.k[0]", "$.f", None, "1"),
        ("$.t[]", "$.t[0]", "$", None, '"a"'), ("$.t[]", "$.t[1]", "$", None, "1"), ("$.t[]", "$.t[2]", "$", None, '"1"'), ("$.t[]", "$.t[3]", "$", None, "null"),
        ("$.t[][]", "$.t[4][0]", "$", None, "true"), ("$.t[][]", "$.t[4][1]", "$", "{}", None), ("$.t[][].x", "$.t[4][1].x", "$.t[4][1]", None, "[]"),
    }
    assert {(r.node_path, r.parent_path, r.item) for r in got if r.record_id == len(VALUES) + 1} == {("$[0]", "", "1"), ("$[1]", "", None)}
    assert {r.shape for r in got if r.record_id == len(VALUES) + 3} == {"$", "$.i[0]"}


def test_query_has_the_objects_of_both_columns(spark, sf_dir):
    from tracelode.plans import catalogue

    key = ["record_table", "record_id", "node_path", "parent_path"]
    tables, found = (f(spark, sf_dir).collect() for f in (catalogue.p2_tables, catalogue.p2_found))
    assert sorted(tuple(r[k] for k in key) for r in tables if r.fields is not None) == sorted(tuple(r[k] for k in key) for r in found)


def test_related_table_keeps_lists_and_bracket_texts(spark):
    df = spark.createDataFrame([(1, '{"a":[{"t":["x",1],"b":"[broken","e":[],"m":[1,{}],"o":[{}],"z":null,"c":{}}]}')], "row_id long, doc string")
    (row,) = N.related_table(N.json_nodes(df, "row_id", "doc", "t"), "$.a[]").collect()
    assert row.fields == {"t": '["x",1]', "b": "[broken", "e": "[]", "m": "[1,{}]", "z": None}
