"""Queries on documents: add, find, change, remove, check."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.operators import docstore as D
from tracelode.plans.registry import query


def store(documents, data="text"):
    return documents.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("type"), F.col(data).alias("data"))


@query("documents", sql="SELECT doc_id AS id, length(text) AS n FROM documents WHERE source = 'api_guide' AND lang = 'de' ORDER BY id")
def q_doc_get(documents):
    return D.get(store(documents), "api_guide", "de").select("id", F.length("data").alias("n")).orderBy("id")


@query("documents", sql="SELECT 200 AS status, 'found' AS message, min(doc_id) AS id FROM documents WHERE source = 'api_guide' AND lang = 'de' UNION ALL SELECT 404, 'not found', NULL")
def q_doc_get_one(documents):
    """A document that is there and one that isn't."""
    s = store(documents)
    smallest = s.where("source = 'api_guide' and type = 'de'").agg(F.min("id").alias("id"))
    there = s.join(F.broadcast(smallest), "id", "left_semi")
    return D.get_one(there, "api_guide", "de", F.col("id")).unionByName(D.get_one(s, "api_guide", "de", -1))


@query("documents", sql="SELECT source, lang, md5(text) AS checksum, min(doc_id) AS stored_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1, 2, 3")
def q_doc_add_dedup(documents):
    return D.add(documents.where("text is not null").select("doc_id", "source", "lang", F.md5("text").alias("checksum")), ["source", "lang", "checksum"], "doc_id")


@query("session_docs", sql="""
SELECT source, type, checksum, min(session_row) AS stored_id, count(*) AS copies FROM session_docs WHERE checksum IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def q_doc_by_checksum(session_docs):
    return D.add(session_docs.where("checksum is not null"), ["source", "type", "checksum"], "session_row").where("copies > 1")


@query("events", sql="SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '87'")
def q_doc_query_path(events):
    return D.query_path(events, "props", "k", "87").select("event_id", "user_id")


FILTER = {"$or": [{"type": "error", "k": {"$gte": 90}}, {"type": {"$in": ["signup", "purchase"]}, "k": {"$lt": 5, "$ne": 3}}], "source": {"$exists": True}}


@query("events", sql="""
SELECT event_id AS id FROM events WHERE (event_type = 'error' AND json_extract_string(props, '$.k')::DOUBLE >= 90)
OR (event_type IN ('signup', 'purchase') AND json_extract_string(props, '$.k')::DOUBLE < 5 AND json_extract_string(props, '$.k')::DOUBLE <> 3)""")
def q_doc_fetch_filter(events):
    docs = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.col("event_type").alias("type"), F.col("props").alias("data"))
    return D.fetch(docs, FILTER).select("id")


@query("orders", "customer", sql="""
SELECT c.c_custkey, CASE WHEN o.t IS NULL THEN c.c_mktsegment ELSE o.p END AS segment, round(CASE WHEN o.t IS NULL THEN c.c_acctbal ELSE o.t END, 2) AS balance
FROM customer c LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS t FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def q_doc_upsert(orders, customer):
    """Customers take priority and value over from their last order."""
    last = D.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderpriority", "o_totalprice"])
    changes = last.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("segment"), F.col("o_totalprice").alias("balance"))
    base = customer.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return D.upsert(base, changes, ["c_custkey"], ["segment", "balance"]).withColumn("balance", F.round("balance", 2))


@query("documents", "content_labels", sql="SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM content_labels WHERE abusive = 1 AND doc_id IS NOT NULL)")
def q_doc_delete(documents, content_labels):
    return D.delete(documents.select("doc_id", "source"), content_labels.where("abusive = 1"), ["doc_id"])


@query("documents", sql="""
SELECT source, 'n_chars' AS field, CAST(n_chars AS VARCHAR) AS value, min(doc_id) AS id FROM documents WHERE source IS NOT NULL GROUP BY 1, 3 HAVING count(*) = 1
UNION ALL SELECT source, 'lang', lang, min(doc_id) FROM documents WHERE source IS NOT NULL GROUP BY 1, 3 HAVING count(*) = 1""")
def q_doc_unique_field(documents):
    d = documents.where("source is not null").select("source", F.col("doc_id").alias("id"), F.expr("stack(2, 'n_chars', cast(n_chars as string), 'lang', lang) as (field, value)"))
    return D.unique_fields(d, ["source"], "field", "value")


@query("orders", sql="""
SELECT o_custkey, o_orderkey, n AS rank, CASE WHEN o_orderstatus = 'O' THEN 'Add' ELSE 'Update' END AS op FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n <= 2""")
def q_doc_flush_budget(orders):
    pending = orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey")).alias("remote"))
    return D.flush(pending, "o_custkey", "o_orderkey", "remote", 2).select("o_custkey", "o_orderkey", "rank", "op")


@query("session_docs", sql=f"""
WITH v AS (SELECT session_row, concat_ws(';', CASE WHEN source IS NULL THEN 'source is null' WHEN length(source) < 3 THEN 'source has less than 3 characters' END,
CASE WHEN type IS NULL THEN 'type is null' WHEN type NOT IN ({", ".join(repr(t) for t in D.TYPES)}) THEN 'type is none of {", ".join(D.TYPES)}' END,
CASE WHEN data IS NULL THEN 'data is null' WHEN NOT json_valid(data) THEN 'data is no JSON' END) AS violations FROM session_docs)
SELECT session_row, violations, CASE WHEN violations = '' THEN 200 ELSE 400 END AS status FROM v""")
def q_doc_validate(session_docs):
    v = session_docs.select("session_row", D.violations(F.col("source"), F.col("type"), F.col("data")).alias("violations"))
    return v.withColumn("status", D.status(F.col("violations")))


@query("documents", sql="SELECT doc_id, coalesce(task, 'none') AS meta, CASE WHEN lang IS NULL OR lang = 'en' THEN 'english' ELSE lang END AS lang FROM documents")
def q_doc_local_edit(documents):
    """Two fields set from other values, one of which the document has, one of which it may not have."""
    doc = F.to_json(F.struct(F.col("lang").alias("lang")))
    lang = F.when(F.col("lang").isNull() | (F.col("lang") == "en"), "english").otherwise(F.col("lang"))
    edited = D.edit(D.edit(doc, "meta", F.coalesce("task", F.lit("none"))), "lang", lang)
    return documents.select("doc_id", F.get_json_object(edited, "$.meta").alias("meta"), F.get_json_object(edited, "$.lang").alias("lang"))


@query("orders", sql="""
WITH old AS (SELECT o_custkey, max(o_orderkey) AS top FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT o_orderkey, coalesce(top, 1) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS new_id FROM orders LEFT JOIN old USING (o_custkey) WHERE o_orderdate >= TIMESTAMP '1996-01-01'""")
def q_doc_next_id(orders):
    split = F.col("o_orderdate") < F.expr("timestamp_ntz'1996-01-01'")
    stored = orders.where(split).select("o_custkey", F.col("o_orderkey").cast("string").alias("id"))
    return D.next_ids(orders.where(~split), stored, ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "new_id")


@query("orders", "customer", sql="""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS has_finished FROM customer c""")
def q_exists_remote(orders, customer):
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("_done")).distinct()
    return customer.select("c_custkey").join(done, "c_custkey", "left").select("c_custkey", F.col("_done").isNotNull().alias("has_finished"))


@query("translations", sql="""
WITH v AS (SELECT DISTINCT program_id, verdict, iteration, logged_at FROM translations), l AS (SELECT program_id, list(coalesce(verdict, '-') ORDER BY logged_at) AS t FROM translations GROUP BY 1),
e AS (SELECT evaluator_id, t.program_id, len(l.t) AS steps FROM (SELECT DISTINCT evaluator_id, program_id FROM translations WHERE evaluator_id IS NOT NULL) t JOIN l USING (program_id))
SELECT evaluator_id, arg_max(program_id, steps * 1000000000 - program_id) AS program_id, max(steps)::INT AS steps FROM e GROUP BY 1""")
def q_longest_lineage(translations):
    """Per evaluator, the program that was logged most often; the smallest of equals."""
    steps = translations.groupBy("program_id").agg(F.count("*").cast("int").alias("steps"))
    owners = translations.where("evaluator_id is not null").select("evaluator_id", "program_id").distinct().join(steps, "program_id")
    return D.longest(owners.withColumn("order", F.col("program_id")), "evaluator_id", "steps", "order", ["program_id", "steps"])


@query("events", sql="SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 2) AS value FROM events GROUP BY 1, 2")
def q_latest_version(events):
    return D.latest(events, ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]).withColumn("value", F.round("value", 2))


@query("events", sql="""
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_op, count(*) AS calls FROM events GROUP BY 1)
SELECT last_op, count(*) AS users, min(user_id) AS first_user, sum(calls)::BIGINT AS calls FROM l GROUP BY 1""")
def q_latest_call_groups(events):
    last = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_op"), F.count("*").alias("calls"))
    return last.groupBy("last_op").agg(F.count("*").alias("users"), F.min("user_id").alias("first_user"), F.sum("calls").alias("calls"))


@query("events", sql="SELECT event_id, json_object('user', CAST(user_id AS VARCHAR)) AS doc FROM events")
def q_strip_keys(events):
    """Server keys k and checksum leave the document, the user stays."""
    full = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.md5("props").alias("checksum"), F.col("user_id").cast("string").alias("user")))
    return events.select("event_id", D.strip_keys(full, ["k", "checksum"]).alias("doc"))


@query("session_docs", sql="""
SELECT session_row, json_extract_string(data, '$.title') AS title, json_extract_string(data, '$.groups[0].label') AS label, json_extract_string(data, '$.missing.deep') AS missing
FROM session_docs WHERE json_valid(data) AND json_type(data) = 'OBJECT' AND NOT contains(data, '\\u')""")
def q_nested_get(session_docs):
    """Values at nested paths, null where a step is missing, of documents without escaped characters."""
    v = F.try_parse_json("data")
    docs = session_docs.where(F.schema_of_variant(v).startswith("OBJECT") & ~F.contains("data", F.lit("\\u")))
    return docs.select("session_row", *[F.try_variant_get(v, p, "string").alias(n) for n, p in (("title", "$.title"), ("label", "$.groups[0].label"), ("missing", "$.missing.deep"))])


@query("session_docs", sql="SELECT session_row, lower(regexp_replace(trim(type), '[^A-Za-z]+', '_', 'g')) AS type FROM session_docs")
def q_normalise_doc(session_docs):
    return session_docs.select("session_row", F.lower(F.regexp_replace(F.trim("type"), "[^A-Za-z]+", "_")).alias("type"))


@query("customer", sql="""
SELECT 'mktsegment' AS attribute, c_mktsegment AS term, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY 2""")
def q_distinct_terms(customer):
    terms = customer.select(F.expr("stack(2, 'mktsegment', c_mktsegment, 'nation', cast(c_nationkey as string)) as (attribute, term)"))
    return terms.groupBy("attribute", "term").agg(F.count("*").alias("n"))


@query("orders", sql="""
SELECT o_custkey, o_orderkey, n AS pos FROM (SELECT *, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS dirty,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE (dirty = 0 OR o_orderstatus = 'O') AND n <= 3""")
def q_prefer_dirty(orders):
    """Of each customer's three largest orders the open ones, or all where none of his orders is open."""
    w = Window.partitionBy("o_custkey")
    n = F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    seen = orders.withColumns({"dirty": F.max((F.col("o_orderstatus") == "O").cast("int")).over(w), "pos": n})
    return seen.where("(dirty = 0 or o_orderstatus = 'O') and pos <= 3").select("o_custkey", "o_orderkey", "pos")


@query("events", sql="""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS result_event, list(event_id ORDER BY ts DESC, event_id DESC)[1:3]::VARCHAR AS last_three FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1""")
def q_result_choice(events):
    """The last changed entity, and the last three from the latest on."""
    rows = events.where("event_type in ('click', 'purchase')").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 3")
    last = F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda x: x["event_id"].cast("string"))
    return rows.groupBy("user_id").agg(F.max(F.when(F.col("n") == 1, F.col("event_id"))).alias("result_event"), F.concat(F.lit("["), F.array_join(last, ", "), F.lit("]")).alias("last_three"))


@query("orders", "lineitem", sql="SELECT l_orderkey, 'response_' || l_orderkey || '[' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) || ']' AS child, l_partkey FROM lineitem")
def q_child_names(orders, lineitem):
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")) - 1
    return lineitem.select("l_orderkey", F.concat(F.lit("response_"), "l_orderkey", F.lit("["), n.cast("string"), F.lit("]")).alias("child"), "l_partkey")


@query("orders", sql="""
SELECT o_custkey, arg_max(o_orderstatus, src) AS status, arg_max(v, src) AS v, count(*) AS sources FROM
(SELECT o_custkey, o_orderstatus, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS src FROM orders) GROUP BY 1""")
def q_merge_last_wins(orders):
    return orders.groupBy("o_custkey").agg(
        F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("v"), F.count("*").alias("sources")
    )


@query("orders", sql="""
SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_pos FROM orders GROUP BY 1, 2""")
def q_ordered_union(orders):
    """Union of two branches without repetition: each value at its first place."""
    a, b = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'")
    return a.unionByName(b).groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_pos"))


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 25")
def q_first_n(orders):
    return orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("session_docs", sql="""
SELECT source, type, count(*) AS docs, count(*) > 1 AS shares_key, min(session_row) AS first_row FROM session_docs WHERE source IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2""")
def q_key_groups(session_docs):
    """Documents by source and type, and which keys several documents share."""
    g = session_docs.where("source is not null and type is not null").groupBy("source", "type").agg(F.count("*").alias("docs"), F.min("session_row").alias("first_row"))
    return g.withColumn("shares_key", F.col("docs") > 1)
