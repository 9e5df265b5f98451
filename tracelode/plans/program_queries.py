"""Queries on programs and generated traces. What needs a syntax tree or a generator has no SQL; the tests hold those
against hand-made fixtures and invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import dataflow as D
from tracelode.operators import generate as N
from tracelode.operators import pipeline as L
from tracelode.operators import simulate as S
from tracelode.plans.registry import query


@query("code_messages")
def q_ast_transitions(code_messages):
    """Transition pairs of all programs, by producer and consumer and by receiver."""
    one = code_messages.select("request_id", "code").distinct()
    t = D.transitions(D.facts(one, "request_id", "code"), "request_id")
    return t.groupBy("src", "dst").agg(F.sum("occ").alias("occ"), F.countDistinct("request_id").alias("programs"))


# Programs whose pairs can be told by reading, with what must come out.
FLOW = {
    1: ("import torch\nx = torch.randn(3, 4)\ny = torch.permute(x, (1, 0))\nz = torch.transpose(y, 0, 1)", [("torch.randn", "torch.permute", 1), ("torch.permute", "torch.transpose", 1)]),
    2: ("s = client.open(name)\ns.read()\ns.close()", [("NONE", "client.open", 2), ("client.open", "s.read", 1), ("client.open", "s.close", 1), ("s.read", "s.close", 1)]),
    3: ("a = svc.get(1)\nn = len(a)\nprint(n)\nb = svc.put(a, n)", [("NONE", "svc.get", 1), ("NONE", "svc.put", 1), ("svc.get", "svc.put", 3)]),
    4: ("r = api.send(api.load(1))", [("NONE", "api.load", 1), ("NONE", "api.send", 1), ("api.load", "api.send", 2)]),
    5: ("import json, math\nd = json.loads(t)\nq = math.floor(2.5)\nw = shop.buy(d)", [("NONE", "shop.buy", 2)]),
    6: ("v = 3\nif v > 2:\n    u = box.put(v)\nelse:\n    u = box.take(v)\nbox.seal(u)", [("NONE", "box.put", 2), ("NONE", "box.take", 2), ("NONE", "box.seal", 1), ("box.take", "box.seal", 1), ("box.put", "box.take", 1), ("box.take", "box.seal", 1)]),
    7: ("def broken(:", []),
}
_PAIRS = {(i, s, d): sum(n for a, b, n in want if (a, b) == (s, d)) for i, (_, want) in FLOW.items() for s, d, _ in want}


@query("region", sql="SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', '{d}', {n})" for (i, s, d), n in _PAIRS.items()) + ") t(id, src, dst, occ)")
def q_flow_fixture(region):
    """Pairs of a few programs that are known by reading; the table is read for its session only."""
    programs = region.sparkSession.createDataFrame([(i, code) for i, (code, _) in FLOW.items()], "id int, code string")
    return D.transitions(D.facts(programs, "id", "code"), "id")


@query("code_messages")
def q_ast_calls(code_messages):
    one = code_messages.select("request_id", "code").distinct()
    return D.calls_per_function(D.facts(one, "request_id", "code"), "request_id").groupBy("func").agg(F.sum("calls").alias("calls"), F.sum("gated").alias("gated"))


def _traces(evaluators, task):
    n = evaluators.where(F.col("task") == task).count()
    return S.run(evaluators.sparkSession, n, task, 5)


def _invariants(evaluators, task):
    traces, book = _traces(evaluators, task)
    steps = S.steps_of(traces)
    per = steps.groupBy("trace_id").agg(F.count_if("counted").alias("calls"), F.countDistinct("params").alias("different"), F.count("*").alias("all"))
    return per.select("trace_id", "calls", (F.col("different") == F.col("all")).alias("no_repeats"), F.lit(len(book)).alias("pairs"))


@query("evaluators")
def q_session_traces(evaluators):
    """As many generated traces as there are session cases, with invariants of each."""
    return _invariants(evaluators, "session")


@query("evaluators")
def q_tensor_traces(evaluators):
    return _invariants(evaluators, "tensor")


@query("evaluators")
def q_voice_traces(evaluators):
    return _invariants(evaluators, "voice")


@query("evaluators")
def q_trace_documents(evaluators):
    """What the server has after each trace."""
    return S.final_documents(_traces(evaluators, "session")[0])


@query("evaluators")
def q_trace_programs(evaluators):
    """The traces of all domains as programs."""
    one = [S.programs(_traces(evaluators, t)[0]).select(F.lit(t).alias("task"), "*") for t in S.DOMAINS]
    return one[0].unionByName(one[1]).unionByName(one[2])


@query("evaluators")
def q_random_documents(evaluators):
    docs = N.documents(evaluators.sparkSession, evaluators.count() * 10)
    return docs.groupBy("source", "type").agg(F.count("*").alias("docs"), F.bool_and(F.get_json_object("data", "$.title").isNotNull()).alias("titled"))


OPLOG = "SELECT user_id, json_extract_string(props, '$.k') AS k, event_type, round(value, 2) AS value, row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'view'"


@query("events", sql=f"SELECT user_id, k, event_type AS last_op, value FROM ({OPLOG}) WHERE n = 1 AND event_type <> 'error'")
def q_fold_log(events):
    """Objects that live after the log: errors delete an object, views are local, everything else writes it."""
    log = events.select("user_id", F.get_json_object("props", "$.k").alias("k"), "event_type", F.col("event_type").alias("last_op"), F.round("value", 2).alias("value"), "ts", "event_id")
    return L.fold(log, ["user_id", "k"], ["ts", "event_id"], "event_type", ["last_op", "value"], "error", "view")


@query("events", sql=f"SELECT user_id, count(*) AS entries, count(*) FILTER (WHERE n = 1) AS objects FROM ({OPLOG}) GROUP BY 1")
def q_log_sizes(events):
    writes = events.where("event_type <> 'view'")
    return writes.groupBy("user_id").agg(F.count("*").alias("entries"), F.countDistinct(F.get_json_object("props", "$.k")).alias("objects"))


@query("code_messages", sql="""
SELECT request_id, item_id, CASE WHEN code IS NULL THEN 'no_condition' WHEN NOT regexp_matches(code, '(?m)^if .+ > \\d+:$') THEN 'no_constant' END AS skip_reason FROM code_messages""")
def q_reversed_skip(code_messages):
    """Which programs have a branch on a number that can be reversed, and why the others don't."""
    constant = F.nullif(F.regexp_extract("code", r"(?m)^if .+ > (\d+):$", 1), F.lit(""))
    reason = L.reversed_skip(F.col("code"), constant, (constant.try_cast("bigint") + 1).cast("string"), F.contains("code", F.concat(constant, F.lit(":"))))
    return code_messages.select("request_id", "item_id", reason.alias("skip_reason"))


@query("evaluators")
def q_random_inputs(evaluators):
    """Random paragraphs, search terms and tensors, as many as there are cases, by what they must fulfil."""
    n, spark = evaluators.count(), evaluators.sparkSession
    texts = N.paragraphs(spark, n).select(F.lit("paragraph").alias("kind"), (F.size(F.split("text", r"\\. ")) == 3).alias("ok"))
    terms = N.voice_terms(spark, n).select(F.lit("term"), F.coalesce("name", "category", "gender").isNotNull())
    tensors = N.shaped_tensors(spark, n).select(F.lit("tensor"), (F.size("values") == F.aggregate("shape", F.lit(1), lambda a, x: a * x)) & (F.element_at("shape", -1) % 2 == 0))
    return texts.union(terms).union(tensors).groupBy("kind").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"))
