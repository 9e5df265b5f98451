import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracelode import runtime
from tracelode.operators import book as B
from tracelode.operators import dataflow as D
from tracelode.operators import docstore as S
from tracelode.operators import evaluate as E
from tracelode.operators import generate as N
from tracelode.operators import graph as G
from tracelode.operators import pipeline as L
from tracelode.operators import speech as V
from tracelode.operators import tensor as T
from tracelode.operators import textops as X


def book(spark, *rows):
    return spark.createDataFrame(list(rows), B.BOOK)


START = [("NONE", "AddSession", 3), ("AddSession", "QuerySession", 2), ("QuerySession", "DeleteSession", 1)]


@pytest.mark.parametrize("given,want", [(2, 3), (10, 10)])
def test_inject(spark, given, want):
    got = {(r.src, r.dst): r.occ for r in B.inject(book(spark, *START), book(spark, ("NONE", "AddSession", given))).collect()}
    assert got[("NONE", "AddSession")] == want and len(got) == 3


@pytest.mark.parametrize("mark,left,removed", [(("NONE", "AddSession", 1), 2, 0), (("QuerySession", "DeleteSession", 1), None, 1), (("AddSession", "QuerySession", -1), None, 1), (("Foo", "Bar", 1), None, 0)])
def test_discard(spark, mark, left, removed):
    marks = spark.createDataFrame([mark], "src string, dst string, dec bigint")
    b = book(spark, *START)
    got = {(r.src, r.dst): r.occ for r in B.apply_discards(b, marks).collect()}
    assert got.get(mark[:2]) == left and B.removed_by(b, marks).count() == removed and len(got) == 3 - removed


def test_marking_twice_removes(spark):
    marks = spark.createDataFrame([("NONE", "AddSession", -1)] * 2, "src string, dst string, dec bigint")
    assert B.apply_discards(book(spark, *START), marks).count() == 2


def test_rounds(spark, rows):
    old = book(spark, *START)
    new = B.record(old, spark.createDataFrame([("X", "Y"), ("X", "Y"), ("NONE", "AddSession")], "src string, dst string"))
    assert rows(B.round_diff(old, new)) == [("NONE", "AddSession", 1), ("X", "Y", 2)]
    with pytest.raises(ValueError):
        B.round_diff(None, new)
    with pytest.raises(PySparkException):
        B.diff(new, old, strict=True).collect()
    assert rows(B.record(old, B.diff(old, new).selectExpr("src", "dst", "explode(sequence(1, int(occ)))").select("src", "dst"))) == rows(new)


def test_shared_keys_with_a_hot_key(spark):
    df = spark.createDataFrame([(i % 3 * (i % 2), i) for i in range(300)] + [(77, 1), (77, 1), (None, 5), (None, 6)], "k int, o int")
    got = runtime.with_shared_key(df, ["k"], "o")
    assert got.count() == 300 and got.where("k = 77 or k is null").count() == 0


DOCS = [("1", "main_a", "main_session", '{"portal-session":{"title":"t1"},"n":5}'), ("2", "main_a", "main_session", '{"portal-session":{"title":"t2"},"n":50}'), ("3", "Main_a", "group", None)]


def test_store(spark):
    s = spark.createDataFrame(DOCS, "id string, source string, type string, data string")
    assert [r.id for r in S.query_path(s, "data", "portal-session.title", "t1").collect()] == ["1"]
    assert [r.id for r in S.fetch(s, {"data.n": {"$gt": 9}}).collect()] == ["2"]
    assert [r.id for r in S.fetch(s, {"$nor": [{"source": "main_a"}]}).collect()] == ["3"]
    assert {r.id for r in S.fetch(s, {"data.n": {"$exists": False}, "source": {"$regex": "(?i)main"}}).collect()} == {"3"}
    assert {r.id for r in S.fetch(s, {"data.n": {"$not": {"$lt": 10}}}).collect()} == {"2", "3"}
    for bad in ({"$where": 1}, {"a\x00": 1}, {"a": {"$near": 1}}):
        with pytest.raises(ValueError):
            S.fetch(s, bad)
    assert S.get_one(s, "main_a", "main_session", "2").first().status == 200 and S.get_one(s, "other", "main_session", "2").first().status == 404
    assert S.get(s, "main_a", "group").count() == 0 and S.get(s, "Main_a", "group").count() == 1
    twice = s.unionByName(s).withColumn("checksum", S.checksum("data"))
    assert S.add(twice.where("data is not null"), ["source", "type", "checksum"], "id").count() == 2
    assert s.select(S.checksum(F.lit('{"b":1,"a":2}')).alias("x"), S.checksum(F.lit('{"a":2, "b":1.0}')).alias("y")).where("x = y").count() == 3
    v = {r.id: r.v for r in s.select("id", S.violations(F.lit("ab"), F.lit("bad"), F.col("data")).alias("v")).collect()}
    assert v["1"].startswith("source has less than 3 characters;type is none of") and v["3"].endswith("data is null")


def grid(spark, values, shape):
    df = spark.createDataFrame([(1, [float(x) for x in values])], "t long, v array<double>")
    return T.cells(df, "t", "v", shape)


def dense(t):
    return {tuple(r.idx): r.val for r in t.collect()}


def test_tensor_algebra(spark):
    t = grid(spark, range(12), [3, 4])
    assert dense(T.transpose(T.transpose(t, 0, 1, 2), 0, 1, 2)) == dense(t) and T.shape_of(T.transpose(t, 0, 1, 2), 2).first()["shape"] == [4, 3]
    p = grid(spark, range(24), [2, 3, 4])
    assert dense(T.permute(T.permute(p, [2, 0, 1]), [1, 2, 0])) == dense(p)
    halves = T.split(t, 2, 1)
    back = T.cat([(halves.where("chunk = 0").drop("chunk"), 2), (halves.where("chunk = 1").drop("chunk"), 2)], 1)
    assert dense(back) == dense(t)
    assert T.allclose(t, t).first().equal and not T.allclose(t, t.where("idx[0] < 2")).first().equal
    with pytest.raises(ValueError):
        T.permute(t, [0, 0])


def test_linear_and_conv(spark):
    t = grid(spark, range(12), [3, 4])
    w = spark.createDataFrame([(o, k, float(o == k)) for o in range(4) for k in range(4)], "o int, k int, w double")
    assert dense(T.linear(t, w, 2)) == dense(t)
    x = grid(spark, range(25), [1, 1, 5, 5])
    k = spark.createDataFrame([(0, 0, 1, 1, 2.0), (0, 0, 0, 0, 0.0)], "o int, c int, kh int, kw int, w double")
    assert dense(T.conv2d(x, k, 5, 5, (3, 3)))[(0, 0, 0, 0)] == 12.0 and T.conv2d(x, k, 5, 5, (3, 3)).count() == 9
    assert T.conv_size(5, 3) == 3 and T.conv_size(8, 3, 2, 1, 2) == 3
    e = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    assert e.select(T.dense_linear(F.col("v"), [[1, 0], [0, 1], [1, 1]], 2)).first()[0] == [1, 2, 3, 3, 4, 7] and e.select(T.dense_permute(F.col("v"), [2, 2], [1, 0])).first()[0] == [1, 3, 2, 4]


def test_speech(spark):
    lib = V.voices(spark)
    df = V.text_to_speech(spark.createDataFrame([(1, "hello"), (2, None)], "id long, said string").withColumn("v", F.lit("Emma")), "said", "v")
    half = V.isolate_audio(df)
    assert {r.duration for r in half.collect()} == {8.0} and half.first().transitions[1]["name"] == "isolate_audio"
    assert V.speech_to_speech(df, "v", lib).count() == 2 and V.speech_to_speech(df.withColumn("v", F.lit("No")), "v", lib).count() == 0
    said, longer = V.speech_to_text(df, True, ["id"])
    assert said.first().diarize and len(longer.first().transitions) == 2
    assert [r.valid for r in V.outbound_calls(df.withColumn("v", F.lit("No")), "v", lib, ["id"]).collect()] == [False, False]
    assert V.search(lib, name="Nobody").first().kind == "none" and V.search(lib, category="absent").count() == 0 and V.search(lib, gender="feminine").count() == 5
    with pytest.raises(ValueError):
        V.search(lib)
    assert V.add_voice(lib, "New", "old", "feminine").where("voice_name = 'New'").first().id == "11"
    both = df.select(F.struct(*V.FIELDS).alias("a"), F.struct(*V.FIELDS).alias("b"))
    assert [r[0] for r in both.select(V.equal("a", "b")).collect()] == [True, True]


def test_outcomes(spark):
    df = spark.createDataFrame([(None, 2, 2, None, None), ("x", 2, 2, None, None), (None, 0, 0, None, None), (None, 2, 1, "SyntaxError", "m"), (None, 2, 1, "KeyError", "m"), (None, 2, 1, None, "m"), (None, 2, 1, None, None), (None, 2, None, None, None)], "e string, n int, p int, t string, m string")
    args = [F.col(c) for c in "enptm"]
    assert [r[0] for r in df.select(E.outcome(*args)).collect()] == ["pass", "generation_or_eval_error", "no_result", "syntax_error", "runtime_error", "error_with_message", "wrong_output_or_state", "failed_unclassified"]
    assert df.select(E.outcome(*args, legacy=True)).collect()[3][0] == "error_with_message"


CODE = """
x = torch.randn(3, 4)
y = torch.permute(x, (1, 0))
if flag:
    z = torch.transpose(y, 0, 1)
s = client.open(name)
client.close()
"""


def test_data_flow(spark):
    df = spark.createDataFrame([(1, CODE), (2, "a = torch.randn(2)\nb = torch.randn(2)"), (3, "def f(:"), (4, None), (5, "")], "id long, code string")
    f = D.facts(df, "id", "code")
    t = {(r.id, r.src, r.dst): r.occ for r in D.transitions(f, "id").collect()}
    assert (1, "torch.permute", "torch.transpose") in t and (1, "torch.randn", "torch.permute") in t and (1, "NONE", "client.open") in t and (1, "client.open", "client.close") in t
    assert not any(k[0] == 2 for k in t) and all(v >= 1 for v in t.values())
    calls = {(r.id, r.func): r.gated for r in D.calls_per_function(f, "id").collect()}
    assert calls[(1, "torch.transpose")] == 1 and calls[(1, "torch.permute")] == 0
    assert {r.func for r in D.facts(df, "id", "code", ["transpose", "client.open"]).where("fact = 'call'").collect()} == {"torch.transpose", "client.open"}


def test_graph(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "c"), ("d", "c")], "src string, dst string")
    assert G.path_depth(e).first().depth == 2
    assert rows(G.chains(e)) == [("a -> b -> c", 2), ("a -> c", 1), ("d -> c", 1)]
    assert G.chains(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")).count() == 0
    assert G.path_depth(e.where("false")).first().depth == 0


def test_random_documents(spark):
    assert N.documents(spark, 20).where("get_json_object(data, '$.title') is null").count() == 0 and N.tensors(spark, 2, (2, 3)).count() == 12


def test_texts(spark):
    df = spark.createDataFrame([("```python\na\n```\nthen\n```\nb\n```",), ("no `fence`",)], "t string")
    assert [r[0] for r in df.select(X.last_code_block(F.col("t"))).collect()] == ["b\n", "no fence"]
    one = spark.createDataFrame([(1, [("system", "s1"), ("system", "s2"), ("user", "u")]), (2, [("user", "u")]), (3, [("system", "s")]), (4, [("system", "s"), ("assistant", "a")]), (5, [])], "id int, m array<struct<role:string,content:string>>")
    got = {}
    for r in X.flatten_system(one, ["id"], "m").orderBy("pos").collect():
        got.setdefault(r.id, []).append((r.role, r.content))
    assert got == {1: [("user", "s1\n\ns2\n\n---\n\nu")], 2: [("user", "u")], 3: [("user", "s")], 4: [("user", "s"), ("assistant", "a")]}
    j = spark.createDataFrame([(1, 'schema {"a": "long long long"} real {"verdict": "ok"}'), (2, "none"), (3, None)], "id int, t string")
    assert [tuple(r) for r in X.best_candidate(X.json_candidates(j, ["id"], "t"), ["id"], ["verdict"]).collect()] == [(1, '{"verdict": "ok"}')]
    v = spark.createDataFrame([("<OK>", True), ("free text", False), ('{"verdict": "ok"}', True), ('{"verdict": "needs_revision"}', False)], "t string, want boolean")
    assert v.where(X.accepted(F.lit(None).cast("string"), F.col("t")) != F.col("want")).count() == 0


def test_pipeline(spark, rows):
    docs = spark.createDataFrame([(1, 1, "s", "t", '{"id":"9","a":"1"}'), (1, 2, "s", "t", '{"a":"2","checksum":"c"}'), (2, 1, "s", "u", "{}"), (2, 2, "x", "t", "{}")], "trace long, n long, source string, type string, data string")
    assert {r.trace: r.oracle for r in L.state_oracle(docs, ["trace"], "source", "type", "data").collect()}[1] == '{"s||t":["{\\"a\\":\\"1\\"}","{\\"a\\":\\"2\\"}"]}'
    assert [(r.trace, r.source, r.type) for r in L.align(docs, "trace", "n", ["source", "type"]).orderBy("trace", "n").collect()] == [(1, "s", "t"), (1, "s", "t"), (2, "s", "u"), (2, "s", "u")]
    assert L.clear(docs, docs.where("type = 't'"), docs.where("trace = 2"), ["source", "type"]).count() == 3
    calls = spark.createDataFrame([(1, i, f) for i, f in enumerate(["A", "B", "C", "D"])], "p long, call_no int, f string")
    start = B.transition_pairs(calls, "p", "f", ["call_no"])
    none = spark.createDataFrame([], B.BOOK)
    same, b, kept = L.modify(calls, calls, start, lambda c: (c, none), "p", "f")
    assert kept and rows(b) == rows(start)
    _, b, kept = L.modify(calls, calls, start, lambda c: (c.where("f <> 'D'"), book(spark, ("X", "Y", 5))), "p", "f")
    assert kept and ("X", "Y", 5) in rows(b) and ("C", "D", 1) not in rows(b)
    _, b, kept = L.modify(calls, calls, start, lambda c: (c.where("f = 'A'"), none), "p", "f")
    assert not kept and rows(b) == rows(start)
    v = spark.createDataFrame([(1, True, True, None), (2, False, True, None), (3, False, True, "e")], "id long, result_pass boolean, state_pass boolean, error_info string")
    assert rows(L.keep_cases(spark.range(1, 5), v, ["id"])) == [(1, "keep"), (2, "recollect"), (3, "drop"), (4, "drop")]


def test_paths_have_no_cap_in_depth(spark, rows):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "src string, dst string")
    assert G.path_depth(e).first().depth == 9
    assert rows(G.chains(e)) == [(" -> ".join(f"n{i}" for i in range(10)), 9)]
    assert G.path_depth(e, 4).first().depth == 4


def test_flow_counts_once(spark):
    code = "x = torch.randn(3, 4)\ny = torch.permute(x, (1, 0))\ns = api.open(n)\ns.read()\nlen(y)\nprint(len(y))"
    df = spark.createDataFrame([(1, code)], "id int, code string")
    got = {(r.src, r.dst): r.occ for r in D.transitions(D.facts(df, "id", "code"), "id").collect()}
    assert got == {("torch.randn", "torch.permute"): 1, ("NONE", "api.open"): 2, ("api.open", "s.read"): 1}


def test_long_paths_have_no_cap(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "src string, dst string")
    assert G.path_depth(e).first().depth == 9 and G.chains(e).count() == 1


def test_filters_on_numbers_by_value(spark):
    s = spark.createDataFrame(DOCS, "id string, source string, type string, data string")
    assert [r.id for r in S.fetch(s, {"data.n": {"$in": [5.0, 7]}}).collect()] == ["1"]
    assert {r.id for r in S.fetch(s, {"data.n": {"$nin": [5]}}).collect()} == {"2", "3"}


def stored(spark, *rows):
    df = spark.createDataFrame(list(rows), "id long, source string, type string, data string")
    return df.withColumn("checksum", S.checksum("data"))


def test_service(spark):
    ask = lambda rows, schema: spark.createDataFrame(rows, schema)
    told = lambda df: {r.req: (r.status, r.id) for r in df.collect()}
    store = stored(spark, (3, "shop", "group", '{"a":1,"b":2}'), (4, "shop", "group", '{"a":2}'))
    doc = "req long, source string, type string, data string"
    new, status = S.insert(store, ask([(1, "shop", "group", '{"b":2, "a":1.0}'), (2, "shop", "group", '{"a":9}'), (3, "shop", "group", '{"a": 9}'), (4, "ab", "group", "{}"), (5, "shop", "what", "{}"), (6, "shop", "group", None), (7, "shop", "group", "{")], doc))
    assert told(status) == {1: (200, 3), 2: (200, 5), 3: (200, 5), 4: (400, None), 5: (400, None), 6: (400, None), 7: (400, None)}
    assert {r.id for r in new.collect()} == {3, 4, 5}
    first = S.insert(store.where("false"), ask([(9, "shop", "group", "{}")], doc))[1]
    assert told(first) == {9: (200, 2)}
    change = "req long, source string, type string, id long, data string"
    after, status = S.update(store, ask([(1, "shop", "group", 3, '{"a":5}'), (2, "shop", "group", 3, '{"a":6}'), (3, "shop", "group", 4, '{"a":6}'), (4, "shop", "main_session", 4, "{}"), (5, "shop", "group", 77, "{}"), (6, "shop", "group", 4, "no")], change))
    assert told(status) == {1: (200, 3), 2: (200, 3), 3: (409, 4), 4: (404, 4), 5: (404, 77), 6: (400, 4)}
    got = {r.id: (r.data, r.checksum) for r in after.collect()}
    assert got[3][0] == '{"a":6}' and got[4][0] == '{"a":2}' and got[3][1] == after.select(S.checksum(F.lit('{"a":6.0}'))).first()[0]
    at = "req long, source string, type string, id long"
    left, status = S.remove(store, ask([(1, "shop", "group", 3), (2, "shop", "group", 3), (3, "else", "group", 4)], at))
    assert told(status) == {1: (200, 3), 2: (404, 3), 3: (404, 4)} and [r.id for r in left.collect()] == [4]
    assert told(S.find(store, ask([(1, "shop", "group", 3), (2, "shop", "group", None)], at))) == {1: (200, 3), 2: (404, None)}
    assert [tuple(r) for r in S.lookup(store, ask([(1, "shop", "group", '{"b":2,"a":1}')], doc)).collect()] == [(1, 3)]
    assert S.insert(store.where("false"), ask([], doc))[0].count() == 0 and S.update(store, ask([], change))[1].count() == 0


def test_keys_go_at_every_depth(spark):
    df = spark.createDataFrame([('{"id":1,"b":[{"id":2,"c":{"checksum":"x","d":null}}],"a":"t"}',), (None,), ("{",)], "j string")
    assert [r[0] for r in df.select(S.strip_keys("j", ["id", "checksum"])).collect()] == ['{"a":"t","b":[{"c":{"d":null}}]}', None, None]


def test_cells_must_fill_the_shape(spark):
    with pytest.raises(PySparkException):
        grid(spark, range(5), [2, 2]).collect()


def replayed(first, calls):
    """What the server has after the calls of a session trace, step by step."""
    docs = {e.no: dict(id=e.id, text=e.text, remote=e.remote) for e in first}
    for c in calls:
        d = docs[c.target]
        if c.op == "AddSession":
            assert d["id"] is None
            d["id"], d["remote"] = max([x["id"] or 0 for x in docs.values()] + [1]) + 1, d["text"]
        elif c.op == "UpdateSession":
            d["remote"] = d["text"]
        elif c.op == "LocalEdit":
            d["text"] = '{"title":"edit %d"}' % c.call_no
        else:
            assert d["id"] is not None
            if c.op == "DeleteSession":
                d.update(id=None, text=None, remote=None)
    return {(d["id"], d["remote"]) for d in docs.values() if d["id"]}


def test_session_traces(spark):
    import ast

    from tracelode.operators import simulate as M

    traces, book = M.run(spark, 40, "session", 5)
    final = {}
    for r in M.final_documents(traces).collect():
        final.setdefault(r.trace_id, set()).add((r.id, r.data))
    for t in traces.collect():
        assert replayed(t.first, t.calls) == final.get(t.trace_id, set())
        assert sum(c.counted for c in t.calls) <= 5 and len({c.params for c in t.calls}) == len(t.calls)
        for c in t.calls:
            last = {"GetSession": {"GetSessions", "UpdateSession"}, "GetSessionByQuery": {"GetSessions"}, "LocalEdit": {"LocalEdit"}, "DeleteSession": {"AddSession"}}.get(c.op, set())
            assert not last & set(c.srcs)
    pairs = {}
    for r in M.steps_of(traces).collect():
        for s in set(r.srcs):
            pairs[s, r.op] = pairs.get((s, r.op), 0) + 1
    assert pairs == book and ("AddSession", "DeleteSession") not in book
    assert all(ast.parse(r.init + "\n" + r.program) for r in M.programs(traces).collect())
    small = M.run(spark, 5, "session", 1)[1]
    grown = M.run(spark, 5, "session", 1, seed=4, known=small)[1]
    assert M.run(spark, 5, "session", 1)[1] == small and sum(grown.values()) > sum(small.values())
    both = M.programs(M.forked(traces, 3), F.lit("user_variable_3['title'] == 'x'"), 3).collect()
    assert len(both) == 40 and all(ast.parse(r.program) and "else:" in r.program for r in both)


def test_tensor_and_voice_traces(spark):
    import ast

    from tracelode.operators import simulate as M

    for domain in ("tensor", "voice"):
        traces, book = M.run(spark, 20, domain, 5)
        for t in traces.collect():
            assert len(t.calls) == 5 and all(x > 0 for e in t.entities for x in e["shape"] or []) and len({e.no for e in t.entities}) == len(t.entities)
        assert all(ast.parse(r.init + "\n" + r.program) for r in M.programs(traces).collect()) and all(k[0] == "NONE" or k[0] in M_OPS[domain] for k in book)


M_OPS = {"tensor": {"permute", "transpose", "split", "cat", "linear", "conv2d"}, "voice": {"search_voice_library", "text_to_speech", "speech_to_speech", "speech_to_text", "isolate_audio", "make_outbound_call"}}


def test_random_inputs(spark):
    values = spark.range(50).select(N.field_value(F.lit("title"), F.col("id"), F.lit("x")).alias("v")).distinct().count()
    assert values == 50
    d = spark.range(3).withColumn("v", N.field_value(F.lit("title"), F.col("id"), F.lit(None).cast("string")))
    assert d.where(N.field_value(F.lit("title"), F.col("id"), F.col("v")) == F.col("v")).count() == 0
    t = N.shaped_tensors(spark, 200).select(F.explode("values").alias("v")).agg(F.avg("v"), F.stddev("v")).first()
    assert abs(t[0]) < 0.05 and abs(t[1] - 1) < 0.05
    forms = {(r.name is not None, r.category is not None, r.gender is not None) for r in N.voice_terms(spark, 100).collect()}
    assert len(forms) == 4 and N.paragraphs(spark, 0).count() == 0
