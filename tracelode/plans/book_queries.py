"""Queries on transition pairs, coverage and choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators import book as B
from tracelode.plans.registry import query

#: End of the first round of the event log.
ROUND, FIRST_HOURS = "2024-01-16", "2024-01-01 12:00:00"
STEPS = "SELECT user_id, event_id, ts, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'NONE') AS src FROM events"
PAIRS = f"SELECT src, event_type AS dst, count(*) AS occ FROM ({STEPS}) GROUP BY 1, 2"
OLD = f"SELECT src, event_type AS dst, count(*) AS occ FROM ({STEPS}) WHERE ts < TIMESTAMP '{ROUND}' GROUP BY 1, 2"
U = "((('0x' || substr(md5({0}), 1, 8))::BIGINT + 1) / 4294967297.0)"


def pairs(events: DataFrame) -> DataFrame:
    return B.transition_pairs(events, "user_id", "event_type", ["ts", "event_id"])


def old_and_new(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    steps = events.select("ts", B.previous("user_id", "event_type", ["ts", "event_id"]).alias("src"), F.col("event_type").alias("dst"))
    return B.count_pairs(steps.where(f"ts < timestamp_ntz'{ROUND}'")), B.count_pairs(steps)


def literal_book(df: DataFrame, rows: list[tuple], schema: str = B.BOOK) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


@query("events", sql=PAIRS)
def q_transition_pairs(events):
    return pairs(events)


@query("chat_requests", sql="""
WITH m AS (SELECT request_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS turn FROM chat_requests),
p AS (SELECT coalesce(lag(m.role) OVER (PARTITION BY request_id ORDER BY turn), 'NONE') AS src, m.role AS dst FROM m)
SELECT src, dst, count(*) AS occ FROM p WHERE dst IS NOT NULL GROUP BY 1, 2""")
def q_role_pairs(chat_requests):
    turns = chat_requests.select("request_id", F.posexplode("messages").alias("turn", "m")).select("request_id", "turn", F.col("m.role").alias("role"))
    return B.transition_pairs(turns, "request_id", "role", ["turn"])


@query("events", sql=f"""
SELECT v.src, v.dst, coalesce(b.occ, 0)::BIGINT AS occ FROM (VALUES ('view', 'click'), ('click', 'purchase'), ('NONE', 'refund'), ('refund', 'view')) v(src, dst)
LEFT JOIN ({PAIRS}) b ON b.src = v.src AND b.dst = v.dst""")
def q_book_lookup(events):
    asked = literal_book(events, [("view", "click"), ("click", "purchase"), ("NONE", "refund"), ("refund", "view")], "src string, dst string")
    return B.lookup(pairs(events), asked)


@query("events", sql=f"SELECT n.src, n.dst, (n.occ - coalesce(o.occ, 0))::BIGINT AS occ FROM ({PAIRS}) n LEFT JOIN ({OLD}) o USING (src, dst) WHERE n.occ > coalesce(o.occ, 0)")
def q_book_diff(events):
    return B.diff(*old_and_new(events), strict=True)


@query("events", sql=f"""
SELECT coalesce(b.src, v.src) AS src, coalesce(b.dst, v.dst) AS dst, greatest(coalesce(b.occ, 0), coalesce(v.occ, 0))::BIGINT AS occ
FROM ({PAIRS}) b FULL JOIN (VALUES ('view', 'click', 2), ('click', 'view', 100000), ('NONE', 'refund', 4)) v(src, dst, occ) ON b.src = v.src AND b.dst = v.dst""")
def q_book_inject(events):
    return B.inject(pairs(events), literal_book(events, [("view", "click", 2), ("click", "view", 100000), ("NONE", "refund", 4)]))


MARKS = [("view", "click", 10), ("view", "click", 5), ("click", "view", -1), ("purchase", "view", 10_000_000), ("refund", "view", 1)]
MARKS_SQL = "VALUES ('view', 'click', 15, false), ('click', 'view', 0, true), ('purchase', 'view', 10000000, false), ('refund', 'view', 1, false)"


@query("events", sql=f"""
SELECT src, dst, occ FROM (SELECT b.src, b.dst, CASE WHEN v.gone THEN 0 ELSE greatest(0, b.occ - coalesce(v.dec, 0)) END::BIGINT AS occ
FROM ({PAIRS}) b LEFT JOIN ({MARKS_SQL}) v(src, dst, dec, gone) ON b.src = v.src AND b.dst = v.dst) WHERE occ > 0""")
def q_book_discard(events):
    return B.apply_discards(pairs(events), literal_book(events, MARKS, "src string, dst string, dec bigint"))


@query("events", sql=f"""
SELECT b.src, b.dst FROM ({PAIRS}) b JOIN ({MARKS_SQL}) v(src, dst, dec, gone) ON b.src = v.src AND b.dst = v.dst WHERE v.gone OR v.dec >= b.occ""")
def q_book_removed(events):
    return B.removed_by(pairs(events), literal_book(events, MARKS, "src string, dst string, dec bigint"))


@query("events", sql=f"""
SELECT coalesce(b.src, v.src) AS src, coalesce(b.dst, v.dst) AS dst, greatest(coalesce(b.occ, 0), coalesce(v.occ, 0))::BIGINT AS occ
FROM (SELECT * FROM ({PAIRS}) WHERE NOT (src = 'view' AND dst = 'view')) b FULL JOIN (VALUES ('view', 'archive', 3), ('click', 'click', 1)) v(src, dst, occ) ON b.src = v.src AND b.dst = v.dst""")
def q_book_reconcile(events):
    gone = literal_book(events, [("view", "view")], "src string, dst string")
    return B.reconcile(pairs(events), gone, literal_book(events, [("view", "archive", 3), ("click", "click", 1)]))


@query("events", sql=f"""
WITH p AS (SELECT date_trunc('week', ts) AS week, src, event_type AS dst, count(*) AS grown FROM ({STEPS}) GROUP BY 1, 2, 3)
SELECT CAST(week AS DATE) AS round_day, src, dst, grown, (sum(grown) OVER (PARTITION BY src, dst ORDER BY week))::BIGINT AS occ FROM p""")
def q_round_versions(events):
    """Versions of the book at the end of each week's round, with the round's growth."""
    steps = events.select(F.date_trunc("week", "ts").cast("date").alias("round_day"), B.previous("user_id", "event_type", ["ts", "event_id"]).alias("src"), F.col("event_type").alias("dst"))
    grown = steps.groupBy("round_day", "src", "dst").agg(F.count("*").alias("grown"))
    return grown.withColumn("occ", F.sum("grown").over(Window.partitionBy("src", "dst").orderBy("round_day")))


@query("events", sql=f"""
WITH o AS ({OLD}), n AS ({PAIRS})
SELECT coalesce(o.src, n.src) AS src, coalesce(o.dst, n.dst) AS dst, CASE WHEN o.src IS NULL THEN 'only_new' WHEN n.src IS NULL THEN 'only_old' ELSE 'matched' END AS kind
FROM o FULL JOIN n ON o.src = n.src AND o.dst = n.dst""")
def q_pair_sets(events):
    return B.pair_sets(*old_and_new(events))


CANDIDATES = "SELECT DISTINCT user_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS src FROM events"
ENERGY = f"""SELECT c.user_id, v.op, min(coalesce(b.occ, 0))::BIGINT AS least, count(*) FILTER (WHERE coalesce(b.occ, 0) = 0) AS unseen FROM
(SELECT * FROM ({CANDIDATES}) UNION ALL SELECT user_id, 'NONE' FROM ({CANDIDATES})) c CROSS JOIN (VALUES ('view'), ('click'), ('purchase'), ('signup'), ('error'), ('refund'), ('share')) v(op)
LEFT JOIN ({PAIRS}) b ON b.src = c.src AND b.dst = v.op GROUP BY 1, 2"""
OPS = ("view", "click", "purchase", "signup", "error", "refund", "share")


def candidates(events: DataFrame) -> DataFrame:
    """Per user, what each operation would add: the pairs (last operation, op) and (NONE, op)."""
    last = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    sources = last.select("user_id", F.explode(F.array("last", F.lit("NONE"))).alias("src"))
    return sources.select("user_id", "src", F.explode(F.array(*[F.lit(x) for x in OPS])).alias("dst")).withColumn("op", F.col("dst"))


@query("events", sql=f"SELECT user_id, op, least, unseen, round(1 / (least + 1e-7), 4) AS weight FROM ({ENERGY})")
def q_energy(events):
    return B.energy(candidates(events), pairs(events), ["user_id", "op"]).withColumn("weight", F.round("weight", 4))


def _pick_sql(weight: str, keep: str) -> str:
    u = U.format("'0|' || user_id || '|' || op")
    return f"SELECT user_id, op FROM (SELECT user_id, op, row_number() OVER (PARTITION BY user_id ORDER BY -ln({u}) / {weight}, op) AS n FROM ({ENERGY}) WHERE {keep}) WHERE n = 1"


@query("events", sql=_pick_sql("(1 / (least + 1e-7))", "true"))
def q_weighted_pick(events):
    rows = B.energy(candidates(events), pairs(events), ["user_id", "op"])
    return B.weighted_pick(rows, ["user_id"], ["user_id", "op"], F.col("weight")).select("user_id", "op")


@query("events", sql=_pick_sql("(unseen * unseen)", "unseen > 0"))
def q_new_coverage_pick(events):
    """A candidate counts once per uncovered pair and is weighted by their number: a weight of its square."""
    rows = B.energy(candidates(events), pairs(events), ["user_id", "op"])
    return B.weighted_pick(rows, ["user_id"], ["user_id", "op"], F.col("unseen") * F.col("unseen")).select("user_id", "op")


@query("events", sql=_pick_sql("1.0", "true"))
def q_uniform_pick(events):
    rows = candidates(events).select("user_id", "op").distinct()
    return B.weighted_pick(rows, ["user_id"], ["user_id", "op"], F.lit(1.0)).select("user_id", "op")


@query("events", sql=f"""
WITH ops AS (SELECT DISTINCT event_type AS op FROM events), p AS (SELECT DISTINCT src, event_type AS dst FROM ({STEPS}) WHERE ts < TIMESTAMP '{FIRST_HOURS}')
SELECT a.op AS src, b.op AS dst FROM ops a CROSS JOIN ops b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.src = a.op AND p.dst = b.op)
UNION ALL SELECT 'NONE', op FROM ops WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.src = 'NONE' AND p.dst = op)""")
def q_uncovered(events):
    """Pairs of operation names that the first hours never saw. The names are few, whatever the size of the log."""
    steps = events.select("ts", B.previous("user_id", "event_type", ["ts", "event_id"]).alias("src"), F.col("event_type").alias("dst"))
    old = B.count_pairs(steps.where(f"ts < timestamp_ntz'{FIRST_HOURS}'"))
    names = events.where("event_type is not null").agg(F.sort_array(F.collect_set("event_type")).alias("ops"))
    every = names.select(F.explode(F.array_append("ops", F.lit("NONE"))).alias("src"), "ops").select("src", F.explode("ops").alias("dst"))
    return every.join(old, B.PAIR, "left_anti")


@query("events", sql=f"SELECT src || '||' || dst AS pair_key, src, dst, occ FROM ({PAIRS})")
def q_pair_key(events):
    keyed = pairs(events).select(B.pair_key(F.col("src"), F.col("dst")).alias("pair_key"), "occ")
    src, dst = B.split_key(F.col("pair_key"))
    return keyed.select("pair_key", src.alias("src"), dst.alias("dst"), "occ")


@query("events", sql="SELECT event_id, user_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'NONE') AS prev_op, event_type AS op FROM events")
def q_prev_call(events):
    return events.select("event_id", "user_id", B.previous("user_id", "event_type", ["ts", "event_id"]).alias("prev_op"), F.col("event_type").alias("op"))


@query("events", sql="""
WITH n AS (SELECT user_id, event_id, event_type, lead(event_type) OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts, event_id) AS nxt FROM events)
SELECT event_type AS src, nxt AS dst, count(*) AS occ FROM n WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def q_receiver_pairs(events):
    """Consecutive calls on the same receiver (the user's object k)."""
    receiver = Window.partitionBy("user_id", F.get_json_object("props", "$.k")).orderBy("ts", "event_id")
    return B.count_pairs(events.select(F.col("event_type").alias("src"), F.lead("event_type").over(receiver).alias("dst")).where("dst is not null"))


@query("events", sql=f"""
SELECT x.user_id, x.event_type AS op, count(*) AS calls FROM events x WHERE ts >= TIMESTAMP '{ROUND}'
AND NOT EXISTS (SELECT 1 FROM events y WHERE y.ts < TIMESTAMP '{ROUND}' AND y.user_id = x.user_id AND y.event_type = x.event_type AND json_extract_string(y.props, '$.k') = json_extract_string(x.props, '$.k')) GROUP BY 1, 2""")
def q_not_called(events):
    """Calls whose operation and parameters the trace hadn't made in the first round."""
    calls = events.select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), "ts")
    done = calls.where(f"ts < timestamp_ntz'{ROUND}'").drop("ts")
    return calls.where(f"ts >= timestamp_ntz'{ROUND}'").join(done, ["user_id", "event_type", "k"], "left_anti").groupBy("user_id", F.col("event_type").alias("op")).agg(F.count("*").alias("calls"))


@query("events", sql="""
WITH x AS (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, island AS island, count(*) AS failures, min(ts) AS first_ts FROM x WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2""")
def q_failure_islands(events):
    """Runs of at least two failures in a row, a success ending each run."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    marked = events.withColumn("island", F.count_if(F.col("event_type") != "error").over(w))
    runs = marked.where("event_type = 'error'").groupBy("user_id", "island").agg(F.count("*").alias("failures"), F.min("ts").alias("first_ts"))
    return runs.where("failures >= 2")


@query("events", sql="""
WITH x AS (SELECT *, lag(event_type) OVER w AS p, lag(json_extract_string(props, '$.k')) OVER w AS pk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, event_type FROM x WHERE NOT coalesce((event_type = p AND json_extract_string(props, '$.k') = pk) OR (event_type = 'view' AND p = 'click'), false)""")
def q_redundancy_filter(events):
    """Drops a call that repeats the one before it, and a query right after a wider query."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k")
    seen = events.withColumns({"p": F.lag("event_type").over(w), "pk": F.lag(k).over(w), "k": k})
    redundant = ((F.col("event_type") == F.col("p")) & (F.col("k") == F.col("pk"))) | ((F.col("event_type") == "view") & (F.col("p") == "click"))
    return seen.where(~F.coalesce(redundant, F.lit(False))).select("event_id", "user_id", "event_type")


@query("events", sql="""
WITH t AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS ops FROM events GROUP BY 1),
p AS (SELECT user_id, ops, len(ops) - list_position(list_reverse(ops), 'click') + 1 AS pos FROM t WHERE list_contains(ops, 'click'))
SELECT user_id, CAST(pos AS INT) AS last_click, list_contains(ops[pos + 1:], 'purchase') AS bought_after FROM p""")
def q_lineage_scan(events):
    """Back to the last click of a lineage, and whether a purchase follows it."""
    w = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    ops = events.groupBy("user_id").agg(F.transform(w, lambda x: x["event_type"]).alias("ops")).where(F.array_contains("ops", "click"))
    at = F.size("ops") - F.array_position(F.reverse("ops"), "click") + 1
    after = F.slice("ops", (at + 1).cast("int"), F.size("ops"))
    return ops.select("user_id", at.cast("int").alias("last_click"), F.array_contains(after, "purchase").alias("bought_after"))


@query("events", sql=f"""
WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call_no FROM events),
f AS (SELECT user_id, b.branch, call_no, event_type FROM s CROSS JOIN (VALUES ('if'), ('else')) b(branch) WHERE call_no <= 3 OR (call_no % 2 = 0) = (b.branch = 'if'))
SELECT user_id, branch, row_number() OVER (PARTITION BY user_id, branch ORDER BY call_no) AS call_no, event_type AS op FROM f""")
def q_branch_fork(events):
    """Both branches share the first three calls; the later ones belong to one branch each."""
    s = events.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    forked = s.withColumn("branch", F.explode(F.array(F.lit("if"), F.lit("else")))).where((F.col("n") <= 3) | ((F.col("n") % 2 == 0) == (F.col("branch") == "if")))
    number = F.row_number().over(Window.partitionBy("user_id", "branch").orderBy("n")).cast("bigint")
    return forked.select("user_id", "branch", number.alias("call_no"), F.col("event_type").alias("op"))


@query("events", sql=f"""
WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '{ROUND}'), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '{ROUND}' AND value > 20)
SELECT user_id, event_type FROM a UNION SELECT user_id, event_type FROM b""")
def q_end_state_union(events):
    """Main rows, then those of the branch that the main part lacks."""
    main = events.where(f"ts < timestamp_ntz'{ROUND}'").select("user_id", "event_type").distinct()
    branch = events.where(f"ts >= timestamp_ntz'{ROUND}' and value > 20").select("user_id", "event_type").distinct()
    return main.unionByName(branch.join(main, ["user_id", "event_type"], "left_anti"))
