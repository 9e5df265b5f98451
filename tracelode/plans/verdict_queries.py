"""Queries on evaluation, repair and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import conversation as C
from tracelode.operators import evaluate as E
from tracelode.operators import repair as R
from tracelode.operators import textops as X
from tracelode.plans.registry import query

LINES = "SELECT l_orderkey, sum(l_extendedprice) AS total, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN max(l_linestatus) ELSE 'P' END AS status FROM lineitem GROUP BY 1"


@query("orders", "lineitem", sql=f"""
SELECT o_orderkey, coalesce(abs(o_totalprice - total) <= 50000 AND o_orderstatus = status, FALSE) AS same FROM orders LEFT JOIN ({LINES}) ON l_orderkey = o_orderkey""")
def q_result_compare(orders, lineitem):
    """Each order as a result, and what its lines say as the oracle; ids don't count."""
    total = lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"), F.min("l_linestatus").alias("a"), F.max("l_linestatus").alias("b"))
    oracle = total.select(F.col("l_orderkey").alias("o_orderkey"), F.to_json(F.struct(F.lit(1).alias("id"), F.when(F.col("a") == F.col("b"), F.col("b")).otherwise("P").alias("status"), "total")).alias("oracle"))
    actual = orders.select("o_orderkey", F.to_json(F.struct(F.lit(2).alias("id"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))).alias("actual"))
    return actual.join(oracle, "o_orderkey", "left").select("o_orderkey", E.same_result(F.col("actual"), F.col("oracle"), 50_000.0).alias("same"))


@query("orders", sql="""
WITH a AS (SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL), b AS (SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL),
k AS (SELECT DISTINCT o_custkey, o_orderpriority FROM b),
d AS (SELECT o_custkey, o_orderpriority, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM (SELECT * FROM a SEMI JOIN k USING (o_custkey, o_orderpriority)) a FULL JOIN b USING (o_custkey, o_orderpriority, o_orderstatus))
SELECT o_custkey, bool_and(x = y) AS state_pass, min(CASE WHEN x <> y THEN o_custkey_key END) AS detail FROM (SELECT *, o_orderpriority AS o_custkey_key FROM d) GROUP BY 1""")
def q_state_compare(orders):
    """The documents of each customer by priority against those of an oracle; keys that only the first has don't count."""
    docs = orders.select("o_custkey", "o_orderpriority", "o_orderstatus")
    return E.same_state(docs.where("o_orderstatus in ('F', 'O')"), docs.where("o_orderstatus in ('F', 'P')"), "o_custkey", ["o_orderpriority"], "o_orderstatus")


@query("events", sql="""
WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL),
d AS (SELECT user_id, sum(coalesce(a.n, 0)) AS x, sum(coalesce(b.n, 0)) AS y, sum(greatest(0, coalesce(b.n, 0) - coalesce(a.n, 0))) AS m FROM a FULL JOIN b USING (user_id, event_type) GROUP BY 1),
v AS (SELECT user_id, CASE WHEN x > y THEN 'more calls than expected: ' || x::BIGINT || ' of ' || y::BIGINT WHEN x < y THEN 'fewer calls than expected: ' || x::BIGINT || ' of ' || y::BIGINT WHEN m = 1 THEN 'an expected call is missing' WHEN m > 1 THEN m::BIGINT || ' calls differ' END AS message FROM d)
SELECT user_id, message IS NULL AS ok, message FROM v""")
def q_call_log_verdict(events):
    calls = events.select("user_id", "event_type")
    return E.call_log_verdict(calls.where("event_type <> 'purchase'"), calls.where("event_type <> 'error'"), "user_id", ["event_type"])


@query("evaluators", sql="SELECT evaluator_id, arg_min(md5(coalesce(program_info, '-')), case_no) AS program FROM evaluators GROUP BY 1")
def q_reference_program(evaluators):
    cases = evaluators.select("evaluator_id", "case_no", F.md5(F.coalesce("program_info", F.lit("-"))).alias("program"))
    return E.reference_program(cases, "evaluator_id")


# Code that is broken in one way each: what it becomes, how its result is told, and what its branch tests.
BROKEN = {
    1: ("x = 1\ny = x", "x = 1\ny = x", "inferred", None),
    2: ("    x = 1\n    if x > 0:\n        RESULT = x", "x = 1\nif x > 0:\n    RESULT = x", "assigned", "x"),
    3: ("x = 1\n    if x:\n        y = 2\n    z = 3", "x = 1\nif x:\n    y = 2\nz = 3", "inferred", "x"),
    4: ("if n:\n\ta = 1\n        b = 2", "if n:\n    a = 1\n    b = 2", "inferred", "n"),
    5: ("for i in r:\n   a = i\n    b = a", "for i in r:\n    a = i\n    b = a", None, None),
    6: ("(((", "(((", None, None),
    7: ("total", "total", "expression", None),
}


def _text(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


@query("region", sql="SELECT * FROM (VALUES " + ", ".join(f"({i}, {_text(b)}, {_text(c)}, {_text(d)})" for i, (_, b, c, d) in BROKEN.items()) + ") t(id, code, kind, tested)")
def q_repair_fixture(region):
    """Repair of a few programs that are known by reading; the table is read for its session only."""
    df = region.sparkSession.createDataFrame([(i, v[0]) for i, v in BROKEN.items()], "id int, code string")
    fixed = df.select("id", R.repaired(F.col("code")).alias("code"))
    return fixed.select("id", "code", R.result_kind(F.col("code")).alias("kind"), R.tested(F.col("code")).alias("tested"))


@query("code_messages")
def q_repair_code(code_messages):
    """All code with its indentation repaired and its result set."""
    fixed = code_messages.where("code is not null").select("request_id", "item_id", R.repaired(F.col("code")).alias("code"))
    return fixed.select("request_id", "item_id", R.result_set(F.col("code")).alias("code"), R.result_kind(F.col("code")).alias("kind"), R.tested(F.col("code")).alias("tested"))


@query("chat_requests", sql="""
WITH m AS (SELECT request_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM chat_requests) SELECT request_id, arg_max(m.content, i) AS content FROM m WHERE m.role <> 'assistant' GROUP BY 1""")
def q_last_given(chat_requests):
    """The last message of each request that isn't the model's own."""
    turns = chat_requests.select("request_id", F.posexplode("messages").alias("turn", "m")).where("m.role <> 'assistant'")
    return C.last_output(turns.select("request_id", "turn", F.lit("assistant").alias("role"), "m.content"), ["request_id"])


GOAL, STEP = 400, " and one more."


@query("prompt_messages", sql=f"""
WITH r AS (SELECT request_id, greatest(1, ceil(({GOAL} - length(prompt)) / {len(STEP)}.0))::INT AS need FROM prompt_messages WHERE prompt IS NOT NULL)
SELECT request_id AS idx, CASE WHEN need <= 3 THEN 'ok' ELSE 'rejected' END AS verdict, least(need, 3) AS rounds FROM r""")
def q_conversation_rounds(prompt_messages):
    """Texts that grow round by round until an evaluator finds them long enough."""
    start = prompt_messages.where("prompt is not null").select(F.col("request_id").alias("idx"), F.col("prompt").alias("content"))
    grow = lambda todo: todo.select("idx", F.concat(_own(todo), F.lit(STEP)).alias("content"))
    judge = lambda made: made.select("idx", F.to_json(F.struct(F.when(F.length("content") >= GOAL, "ok").otherwise("short").alias("verdict"), F.col("content").alias("text"))).alias("content"))
    return C.rounds(start, grow, judge)[1]


def _own(todo):
    """The text itself, also out of the evaluator's answer."""
    return F.coalesce(F.get_json_object("content", "$.text"), F.col("content"))


@query("events", sql="SELECT event_id, '<k>' || json_extract_string(props, '$.k') || '</k>' AS tagged FROM events")
def q_tagged(events):
    return events.select("event_id", C.tagged(F.col("props")).alias("tagged"))


@query("raw_messages", sql="""
SELECT message_id, CASE WHEN contains(body, 'OK') THEN 'ok' WHEN custom_id < 'item-5' THEN 'rejected' ELSE 'revise' END AS verdict FROM raw_messages""")
def q_final_verdict(raw_messages):
    """Bodies as an evaluator's answers, some in the last round."""
    last = F.when(F.col("custom_id") < "item-5", 3).otherwise(1)
    return raw_messages.select("message_id", C.final_verdict(F.col("body"), last, 3).alias("verdict"))


@query("translations", "evaluators", sql="""
SELECT DISTINCT program_id, t.evaluator_id, e.task AS summary FROM translations t LEFT JOIN (SELECT evaluator_id, task FROM evaluators WHERE case_no = (SELECT min(case_no) FROM evaluators)) e ON e.evaluator_id = t.evaluator_id""")
def q_trace_summary(translations, evaluators):
    """Programs with what their evaluator's first case is about."""
    low = evaluators.agg(F.min("case_no").alias("case_no"))
    first = evaluators.join(F.broadcast(low), "case_no", "left_semi").select("evaluator_id", F.col("task").alias("summary"))
    return C.with_summary(translations.select("program_id", "evaluator_id").distinct(), first, "evaluator_id")


@query("customer", "orders", sql="SELECT c_custkey AS idx FROM customer UNION SELECT o_orderkey FROM orders")
def q_open_indices(customer, orders):
    return C.open_indices(customer.select(F.col("c_custkey").alias("idx")), orders.select(F.col("o_orderkey").alias("idx")))


@query("customer", sql="SELECT c_custkey, 'user_name = ' || c_name || chr(10) || 'user_segment = ' || c_mktsegment AS block FROM customer")
def q_variable_block(customer):
    return customer.select("c_custkey", C.variable_block(F.array(F.lit("user_name"), F.lit("user_segment")), F.array("c_name", "c_mktsegment")).alias("block"))


@query("lineitem", sql="""SELECT DISTINCT l_returnflag, l_linenumber, 'order["' || l_returnflag || '"][' || l_linenumber || ']' AS path FROM lineitem""")
def q_path_text(lineitem):
    one = lineitem.select("l_returnflag", "l_linenumber").distinct()
    return one.withColumn("path", X.path_text(F.lit("order"), F.array("l_returnflag", F.col("l_linenumber").cast("string"))))


@query("events", sql="SELECT event_id FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') = '87'")
def q_call_matches(events):
    params = F.from_json("props", "map<string,string>")
    return events.where(X.matches(F.col("event_type"), params, "click", {"k": "87"})).select("event_id")
