"""Queries on the service: requests against a store, with a status each. Stores and requests are made from the tables of the shop."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelode.operators import docstore as D
from tracelode.plans.registry import query

KINDS = {"signup": "main_session", "purchase": "main_session", "click": "group", "view": "settings"}


def _events(events):
    """Requests: signups and purchases share a type, errors have none that is valid."""
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in KINDS.items()], F.lit("bad"))
    return events.select(F.col("event_id").cast("bigint").alias("req"), F.concat(F.lit("user_"), "user_id").alias("source"), kind.alias("type"), F.col("props").alias("data"), "event_type")


def _signups(events):
    s = _events(events).where("event_type = 'signup'")
    return s.select(F.col("req").alias("id"), "source", "type", "data", D.checksum("data").alias("checksum"))


EVENTS = """
r AS (SELECT event_id AS req, 'user_' || user_id AS source, CASE event_type WHEN 'signup' THEN 'main_session' WHEN 'purchase' THEN 'main_session' WHEN 'click' THEN 'group' WHEN 'view' THEN 'settings' ELSE 'bad' END AS type,
json_extract_string(props, '$.k') AS k, event_type FROM events),
s AS (SELECT req AS id, source, type, k FROM r WHERE event_type = 'signup')"""


@query("events", sql=f"""
WITH {EVENTS}, q AS (SELECT * FROM r WHERE event_type <> 'signup'), o AS (SELECT source, type, k, min(id) AS id FROM s GROUP BY ALL),
f AS (SELECT source, type, k, min(req) AS req FROM q WHERE type <> 'bad' GROUP BY ALL),
n AS (SELECT source, type, k, (SELECT max(id) FROM s) + row_number() OVER (ORDER BY req) AS id FROM f ANTI JOIN o USING (source, type, k)),
a AS (SELECT * FROM o UNION ALL SELECT * FROM n)
SELECT q.req, CASE WHEN q.type = 'bad' THEN 400 ELSE 200 END AS status, CASE WHEN q.type = 'bad' THEN 'type is none of {", ".join(D.TYPES)}' ELSE 'added' END AS message, a.id FROM q LEFT JOIN a USING (source, type, k)""")
def q_service_insert(events):
    """Documents added to a store that has some of them: known ones get the id they have."""
    requests = _events(events).where("event_type <> 'signup'").drop("event_type")
    return D.insert(_signups(events), requests)[1]


@query("events", sql=f"""
WITH {EVENTS}, q AS (SELECT * FROM r WHERE event_type <> 'signup'), o AS (SELECT source, type, k, min(id) AS id FROM s GROUP BY ALL),
f AS (SELECT DISTINCT source, type, k FROM q WHERE type <> 'bad')
SELECT type, count(*) AS documents FROM (SELECT type FROM s UNION ALL SELECT type FROM f ANTI JOIN o USING (source, type, k)) GROUP BY 1""")
def q_service_store(events):
    """What the store holds after it."""
    requests = _events(events).where("event_type <> 'signup'").drop("event_type")
    return D.insert(_signups(events), requests)[0].groupBy("type").agg(F.count("*").alias("documents"))


@query("events", sql=f"WITH {EVENTS} SELECT q.req, s.id FROM r q JOIN s USING (source, type, k) WHERE q.event_type = 'purchase'")
def q_service_lookup(events):
    """Stored documents that equal what was asked for."""
    asked = _events(events).where("event_type = 'purchase'").drop("event_type")
    return D.lookup(_signups(events), asked)


def _customers(customer):
    data = F.concat(F.lit('{"n":'), "c_custkey", F.lit("}"))
    return customer.select(F.col("c_custkey").cast("bigint").alias("id"), F.lit("shop").alias("source"), F.lit("main_session").alias("type"), data.alias("data")).withColumn("checksum", D.checksum("data"))


def _orders(orders):
    """A request per order: low priorities name a source that has no documents, open orders take the next customer's data."""
    source = F.when(F.col("o_orderpriority") == "5-LOW", "kiosk").otherwise("shop")
    n = F.col("o_custkey") + F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    data = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit('{"n":-'), "o_orderkey", F.lit("}"))).when(F.col("o_orderpriority") == "2-HIGH", F.lit("{")).otherwise(F.concat(F.lit('{"n":'), n, F.lit("}")))
    return orders.select(F.col("o_orderkey").cast("bigint").alias("req"), source.alias("source"), F.lit("main_session").alias("type"), F.col("o_custkey").cast("bigint").alias("id"), data.alias("data"))


ORDERS = """
q AS (SELECT o_orderkey AS req, CASE WHEN o_orderpriority = '5-LOW' THEN 'kiosk' ELSE 'shop' END AS source, o_custkey AS id, o_orderpriority = '2-HIGH' AS bad,
CASE WHEN o_orderpriority = '1-URGENT' THEN -o_orderkey ELSE o_custkey + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END END AS n FROM orders)"""


@query("customer", "orders", sql=f"""
WITH {ORDERS}, c AS (SELECT c_custkey AS id FROM customer), l AS (SELECT id, max(req) AS req, arg_max(n, req) AS n FROM q WHERE NOT bad AND source = 'shop' GROUP BY 1),
a AS (SELECT c.id, coalesce(l.n, c.id) AS n, l.req FROM c LEFT JOIN l USING (id)),
w AS (SELECT *, count(*) OVER (PARTITION BY n) AS c, row_number() OVER (PARTITION BY n ORDER BY coalesce(req, -1), id) AS k FROM a), x AS (SELECT id FROM w WHERE req IS NOT NULL AND c > 1 AND k > 1)
SELECT q.req, CASE WHEN bad THEN 400 WHEN source = 'kiosk' OR c.id IS NULL THEN 404 WHEN x.id IS NOT NULL THEN 409 ELSE 200 END AS status,
CASE WHEN bad THEN 'data is no JSON' WHEN source = 'kiosk' OR c.id IS NULL THEN 'not found' WHEN x.id IS NOT NULL THEN 'duplicate' ELSE 'updated' END AS message, q.id
FROM q LEFT JOIN c ON c.id = q.id LEFT JOIN x ON x.id = q.id""")
def q_service_update(customer, orders):
    return D.update(_customers(customer), _orders(orders))[1]


@query("customer", "orders", sql=f"""
WITH {ORDERS}, f AS (SELECT id, min(req) AS req FROM q WHERE source = 'shop' AND id IN (SELECT c_custkey FROM customer) GROUP BY 1)
SELECT q.req, CASE WHEN f.req IS NOT NULL THEN 200 ELSE 404 END AS status, CASE WHEN f.req IS NOT NULL THEN 'deleted' ELSE 'not found' END AS message, q.id FROM q LEFT JOIN f ON f.id = q.id AND f.req = q.req""")
def q_service_remove(customer, orders):
    return D.remove(_customers(customer), _orders(orders).drop("data"))[1]


@query("customer", "orders", sql=f"""
WITH {ORDERS} SELECT req, CASE WHEN hit THEN 200 ELSE 404 END AS status, CASE WHEN hit THEN 'found' ELSE 'not found' END AS message, id FROM (SELECT *, source = 'shop' AND id IN (SELECT c_custkey FROM customer) AS hit FROM q)""")
def q_service_find(customer, orders):
    return D.find(_customers(customer), _orders(orders).drop("data"))


@query("orders", sql="""
SELECT o_orderkey, '{"items":[{"n":' || o_custkey || '}],"status":"' || o_orderstatus || '"}' AS doc FROM orders""")
def q_strip_deep(orders):
    """Keys that the server adds go at every depth."""
    text = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","id":7,"items":[{"checksum":"x","n":'), "o_custkey", F.lit(',"id":{"a":1}}]}'))
    return orders.select("o_orderkey", D.strip_keys(text, ["id", "checksum"]).alias("doc"))


@query("orders", sql="SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def q_numbered(orders):
    """Places over the whole table without a task that sees all of it."""
    one = orders.select("o_orderkey", F.struct("o_totalprice", "o_orderkey").alias("by"))
    return D.numbered(one, "by").select("o_orderkey", F.col("_no").alias("place"))
