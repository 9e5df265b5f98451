"""Queries that compare, evaluate and report."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.operators import evaluate as E
from tracelode.operators import graph as G
from tracelode.operators import book as B
from tracelode.plans.book_queries import PAIRS, pairs
from tracelode.plans.registry import query

HALF = "2024-01-16"


def halves(events):
    return events.where(f"ts < timestamp_ntz'{HALF}'"), events.where(f"ts >= timestamp_ntz'{HALF}'")


@query("events", sql=f"""
WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '{HALF}' GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{HALF}' GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.n, 0) AS actual, coalesce(b.n, 0) AS expected
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def q_call_log_diff(events):
    """Calls that one half of the log holds more often than the other, as a difference of multisets."""
    return E.multiset_diff(*halves(events), ["user_id", "event_type"])


@query("events", sql=f"""
WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '{HALF}' GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{HALF}' GROUP BY 1, 2),
j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type)
SELECT user_id, bool_and(x = y) AS equal, sum(greatest(0, x - y))::BIGINT AS more, sum(greatest(0, y - x))::BIGINT AS missing FROM j GROUP BY 1""")
def q_multiset_equal(events):
    return E.multiset_equal(*halves(events), ["user_id"], ["event_type"])


@query("events", sql=f"""
WITH x AS (SELECT user_id, event_type, event_id, ts < TIMESTAMP '{HALF}' AS l, row_number() OVER (PARTITION BY user_id, event_type, ts < TIMESTAMP '{HALF}' ORDER BY event_id) AS rn FROM events)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, coalesce(a.rn, b.rn) AS rn, a.event_id AS left_id, b.event_id AS right_id,
CASE WHEN b.event_id IS NULL THEN 'only left' WHEN a.event_id IS NULL THEN 'only right' ELSE 'matched' END AS verdict
FROM (SELECT * FROM x WHERE l) a FULL JOIN (SELECT * FROM x WHERE NOT l) b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.rn = b.rn""")
def q_match_ranked(events):
    a, b = (x.select("user_id", "event_type", "event_id") for x in halves(events))
    return E.match_ranked(a, b, ["user_id", "event_type"], "event_id")


@query("events", sql="""
SELECT user_id, bool_and(abs(value - nxt) <= 25) AS steady, count(*) AS steps FROM (SELECT user_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY 1""")
def q_tolerance_compare(events):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = events.select("user_id", "value", F.lead("value").over(w).alias("nxt")).where("nxt is not null")
    return s.groupBy("user_id").agg(F.bool_and(E.close(F.col("value"), F.col("nxt"), 25.0)).alias("steady"), F.count("*").alias("steps"))


OUTCOME = """SELECT request_id, run_id, CASE WHEN code IS NULL THEN 'generation_or_eval_error' WHEN length(code) = 0 THEN 'no_result' WHEN contains(code, 'RESULT') THEN 'pass'
WHEN contains(code, 'raise ') THEN 'runtime_error' ELSE 'wrong_output_or_state' END AS outcome FROM code_messages"""


def outcomes(code_messages):
    code = F.col("code")
    none = F.lit(None).cast("string")
    got = E.outcome(F.when(code.isNull(), "no code"), F.when(F.length(code) > 0, 1).otherwise(0), F.contains(code, F.lit("RESULT")).cast("int"), F.when(F.contains(code, F.lit("raise ")), "RuntimeError"), none)
    return code_messages.select("request_id", "run_id", got.alias("outcome"))


@query("code_messages", sql=f"""
WITH o AS ({OUTCOME}), n AS (SELECT run_id, outcome, count(*) AS n FROM o GROUP BY 1, 2)
SELECT run_id, outcome, n, round(100.0 * sum(CASE WHEN outcome = 'pass' THEN n ELSE 0 END) OVER (PARTITION BY run_id) / sum(n) OVER (PARTITION BY run_id), 2)::DOUBLE AS pass_rate FROM n""")
def q_outcome_report(code_messages):
    return E.outcome_report(outcomes(code_messages), ["run_id"], "outcome")


@query("code_messages", sql=f"SELECT request_id FROM (SELECT DISTINCT request_id FROM ({OUTCOME}) WHERE outcome <> 'pass') ORDER BY request_id LIMIT 20")
def q_failed_20(code_messages):
    """The first 20 failed requests, as the report lists them."""
    return outcomes(code_messages).where("outcome <> 'pass'").select("request_id").distinct().orderBy("request_id").limit(20)


@query("code_messages", sql="""
SELECT request_id, coalesce(contains(code, 'RESULT'), false) AS result_pass, CASE WHEN coalesce(length(code), 0) = 0 THEN 'No code generated' END AS error_info, coalesce(length(code) > 100, false) AS state_pass FROM code_messages""")
def q_eval_loop(code_messages):
    code = F.coalesce("code", F.lit(""))
    r = E.verdict_record(F.contains(code, F.lit("RESULT")), F.when(F.length(code) == 0, "No code generated"), F.length(code) > 100)
    return code_messages.select("request_id", r.alias("r")).select("request_id", "r.*")


@query("prompt_messages", "code_messages", sql="""
WITH c AS (SELECT request_id, min(code) AS code, count(*) AS n FROM code_messages GROUP BY 1),
s AS (SELECT p.run_id, CASE WHEN c.n IS NULL THEN 'no_code_row' WHEN c.code IS NULL THEN 'null_code' WHEN length(c.code) = 0 THEN 'empty_code' WHEN c.n > 1 THEN 'code_twice' WHEN NOT contains(c.code, 'RESULT') THEN 'no_sink' ELSE 'kept' END AS reason
FROM prompt_messages p LEFT JOIN c USING (request_id)) SELECT reason, count(*) AS n, min(run_id) AS first_run FROM s GROUP BY 1""")
def q_skip_reasons(prompt_messages, code_messages):
    c = code_messages.groupBy("request_id").agg(F.min("code").alias("code"), F.count("*").alias("n"))
    reason = (
        F.when(F.col("n").isNull(), "no_code_row").when(F.col("code").isNull(), "null_code").when(F.length("code") == 0, "empty_code").when(F.col("n") > 1, "code_twice").when(~F.contains("code", F.lit("RESULT")), "no_sink").otherwise("kept")
    )
    return prompt_messages.join(c, "request_id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("run_id").alias("first_run"))


@query("code_messages", sql="""
SELECT run_id, count(*) AS responses, min(length(coalesce(code, ''))) AS least, floor(median(length(coalesce(code, ''))))::BIGINT AS median, max(length(coalesce(code, ''))) AS most,
count(*) FILTER (WHERE length(coalesce(code, '')) < 64) AS short, count(*) FILTER (WHERE length(coalesce(code, '')) = 0) AS blank,
min(item_id) AS least_tokens, floor(median(item_id))::BIGINT AS median_tokens, max(item_id) AS most_tokens FROM code_messages GROUP BY 1""")
def q_response_diag(code_messages):
    return E.response_diagnostics(code_messages, ["run_id"], "code", "item_id")


USAGE = "try_cast(coalesce(json_extract_string(body, '$.usage.completion_tokens'), json_extract_string(body, '$.usage.output_tokens')) AS BIGINT)"


@query("raw_messages", sql=f"""
WITH r AS (SELECT source, {USAGE} AS tokens, json_extract_string(body, '$.error.message') AS err FROM raw_messages WHERE json_valid(body))
SELECT coalesce(source, '-') AS source, count(*) AS calls, count(err) AS errors, sum(coalesce(tokens, 0))::BIGINT AS tokens, round(avg(tokens), 2) AS mean_tokens,
CASE WHEN count(tokens) = 0 THEN 'N/A' ELSE printf('%.1f%%', 100.0 * count(err) / count(*)) END AS error_rate FROM r GROUP BY 1""")
def q_usage_summary(raw_messages):
    """Calls, errors and tokens per source, of readable bodies."""
    tokens = F.coalesce(F.get_json_object("body", "$.usage.completion_tokens"), F.get_json_object("body", "$.usage.output_tokens")).try_cast("bigint")
    r = raw_messages.where(F.try_parse_json("body").isNotNull()).select(F.coalesce("source", F.lit("-")).alias("source"), tokens.alias("t"), F.get_json_object("body", "$.error.message").alias("err"))
    return r.groupBy("source").agg(
        F.count("*").alias("calls"), F.count("err").alias("errors"), F.sum(F.coalesce("t", F.lit(0))).cast("bigint").alias("tokens"), F.round(F.avg("t"), 2).alias("mean_tokens"),
        F.when(F.count("t") == 0, "N/A").otherwise(F.format_string("%.1f%%", 100.0 * F.count("err") / F.count("*"))).alias("error_rate"),
    )


@query("events", sql=f"""
WITH e AS (SELECT user_id, event_type, count(*) FILTER (WHERE ts < TIMESTAMP '{HALF}') AS o, count(*) FILTER (WHERE ts >= TIMESTAMP '{HALF}') AS m FROM events GROUP BY 1, 2),
a AS (SELECT user_id, sum(greatest(0, m - o))::BIGINT AS added, sum(greatest(0, o - m))::BIGINT AS removed, sum(o) AS calls FROM e GROUP BY 1)
SELECT user_id, added, removed, greatest(added, removed) AS delta, (greatest(1, floor(calls * 0.3)) + 1)::BIGINT AS allowed, greatest(added, removed) <= greatest(1, floor(calls * 0.3)) + 1 AS ok FROM a""")
def q_type_delta(events):
    return E.type_delta(*halves(events), ["user_id"], "event_type")


@query("events", sql="SELECT event_type AS func, count(*) AS calls, count(DISTINCT user_id) AS traces FROM events GROUP BY 1")
def q_calls_by_type(events):
    return events.groupBy(F.col("event_type").alias("func")).agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("traces"))


@query("events", sql="""
WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM w)
SELECT user_id, min(CASE WHEN run >= 3 THEN no END) AS stopped_at, count(*) AS runs FROM r GROUP BY 1""")
def q_failure_cutoff(events):
    return E.failure_cutoff(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)


ACYCLIC = f"SELECT src, dst FROM ({PAIRS}) WHERE src < dst"


@query("events", sql=f"""
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({PAIRS}) WHERE src <> dst), p AS (SELECT [src, dst] AS path, dst AS node, 1 AS steps FROM e
UNION ALL SELECT list_append(p.path, e.dst), e.dst, p.steps + 1 FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst) AND p.steps < 6)
SELECT coalesce(max(steps), 0) AS depth FROM p""")
def q_path_depth(events):
    return G.path_depth(pairs(events))


@query("events", sql=f"""
WITH RECURSIVE e AS ({ACYCLIC}), p AS (SELECT [src, dst] AS path, dst AS node, 1 AS steps FROM e WHERE src NOT IN (SELECT dst FROM e)
UNION ALL SELECT list_append(p.path, e.dst), e.dst, p.steps + 1 FROM p JOIN e ON e.src = p.node WHERE p.steps < 6)
SELECT array_to_string(path, ' -> ') AS chain, steps FROM p WHERE node NOT IN (SELECT src FROM e)""")
def q_chains(events):
    """Chains of the pairs that go up the alphabet, which have no cycle."""
    return G.chains(pairs(events).where("src < dst"))


@query("events", sql=f"""
WITH e AS ({ACYCLIC}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), d AS (SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS in_degree, (SELECT count(*) FROM e WHERE src = node) AS out_degree FROM n)
SELECT *, CASE WHEN in_degree = 0 THEN 'source' WHEN out_degree = 0 THEN 'sink' ELSE 'inner' END AS role FROM d""")
def q_graph_degree(events):
    return G.degrees(pairs(events).where("src < dst"))


@query("events", sql="""
WITH c AS (SELECT user_id, event_id, ts, event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT coalesce(p.event_type, 'NONE') AS src, c.event_type AS dst, count(*) AS occ FROM c
LEFT JOIN (SELECT user_id, k, event_id, event_type, lead(event_id) OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS used_by FROM c) p ON p.used_by = c.event_id GROUP BY 1, 2""")
def q_def_use_edges(events):
    """From the call that last produced an object to the call that uses it; NONE where nothing produced it."""
    w = Window.partitionBy("user_id", F.get_json_object("props", "$.k")).orderBy("ts", "event_id")
    return B.count_pairs(events.select(F.coalesce(F.lag("event_type").over(w), F.lit("NONE")).alias("src"), F.col("event_type").alias("dst")))


@query("events", sql=f"""
WITH n AS (SELECT CASE WHEN src IN ('view', 'click') THEN 'web.' || src ELSE 'shop.' || src END AS a, CASE WHEN dst IN ('view', 'click') THEN 'web.' || dst ELSE 'shop.' || dst END AS b FROM ({PAIRS}) WHERE src <> 'NONE'),
e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM n)
SELECT count(*) AS binding_edges, round(count(*) FILTER (WHERE split_part(a, '.', 1) <> split_part(b, '.', 1)) / greatest(1, count(*)), 6) AS cross_module_share,
(SELECT count(DISTINCT event_type) FROM events) AS distinct_calls, round((SELECT count(DISTINCT event_type) FROM events WHERE value > 99) / (SELECT greatest(1, count(DISTINCT event_type)) FROM events), 6) AS gated_share FROM e""")
def q_metrics(events):
    name = lambda c: F.concat(F.when(F.col(c).isin("view", "click"), "web.").otherwise("shop."), F.col(c))
    edges = pairs(events).where("src <> 'NONE'").select(name("src").alias("src"), name("dst").alias("dst"))
    return G.metrics(events.select(name("event_type").alias("func"), (F.col("value") > 99).alias("gated")), edges)


@query("chat_requests", "raw_messages", sql="""
WITH d AS (SELECT request_id, count(*) AS deliveries, max(received_at) AS last_at FROM raw_messages GROUP BY 1)
SELECT c.request_id, split_part(c.custom_id, '-', 1) AS prefix, coalesce(d.deliveries, 0) AS deliveries, d.last_at >= c.sent_at AS after_request FROM chat_requests c LEFT JOIN d USING (request_id)""")
def q_response_join(chat_requests, raw_messages):
    d = raw_messages.groupBy("request_id").agg(F.count("*").alias("deliveries"), F.max("received_at").alias("last_at"))
    met = chat_requests.join(d, "request_id", "left")
    return met.select("request_id", F.split("custom_id", "-")[0].alias("prefix"), F.coalesce("deliveries", F.lit(0)).alias("deliveries"), (F.col("last_at") >= F.col("sent_at")).alias("after_request"))


@query("evaluators", "translations", sql="""
WITH t AS (SELECT evaluator_id, count(DISTINCT program_id) AS programs, arg_max(verdict, (logged_at, program_id)) AS verdict FROM translations WHERE evaluator_id IS NOT NULL AND verdict IS NOT NULL GROUP BY 1)
SELECT (row_number() OVER (PARTITION BY coalesce(e.task, '-') ORDER BY e.case_id) - 1) AS case_pos, e.case_id, coalesce(e.task, '-') AS task, t.programs, t.verdict FROM evaluators e JOIN t USING (evaluator_id)""")
def q_corpus_pack(evaluators, translations):
    """Cases that have a translation, with the number of their programs, the last verdict and a dense position per task."""
    t = translations.where("evaluator_id is not null and verdict is not null").groupBy("evaluator_id").agg(F.countDistinct("program_id").alias("programs"), F.max_by("verdict", F.struct("logged_at", "program_id")).alias("verdict"))
    met = evaluators.join(t, "evaluator_id").withColumn("task", F.coalesce("task", F.lit("-")))
    pos = F.row_number().over(Window.partitionBy("task").orderBy("case_id")) - 1
    return met.select(pos.alias("case_pos"), "case_id", "task", "programs", "verdict")


@query("events", sql="""
WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type FROM events)
SELECT user_id, turn, CASE WHEN turn % 2 = 1 THEN 'generator' ELSE 'evaluator' END AS speaker, CASE WHEN turn = 1 THEN 'BEGIN' WHEN turn >= 12 OR event_type = 'purchase' THEN 'END' ELSE 'CONTINUE' END AS status FROM t WHERE turn <= 12""")
def q_turn_state(events):
    """Two speakers in turn, from BEGIN to END at an acceptance or at the cap of twelve turns."""
    t = events.withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("turn <= 12")
    state = F.when(F.col("turn") == 1, "BEGIN").when((F.col("turn") >= 12) | (F.col("event_type") == "purchase"), "END").otherwise("CONTINUE")
    return t.select("user_id", "turn", F.when(F.col("turn") % 2 == 1, "generator").otherwise("evaluator").alias("speaker"), state.alias("status"))


@query("code_messages", "prompt_messages", sql="SELECT count(*) AS code_rows, count(DISTINCT c.request_id) AS coded, (SELECT count(*) FROM prompt_messages) AS prompts, count(*) FILTER (WHERE length(code) = 0) AS empty_rows FROM code_messages c")
def q_artifact_counts(code_messages, prompt_messages):
    c = code_messages.agg(F.count("*").alias("code_rows"), F.countDistinct("request_id").alias("coded"), F.count_if(F.length("code") == 0).alias("empty_rows"), F.lit(1).alias("_k"))
    return c.join(prompt_messages.agg(F.count("*").alias("prompts"), F.lit(1).alias("_k")), "_k").drop("_k")
