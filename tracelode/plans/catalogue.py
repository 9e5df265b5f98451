"""All queries outside the subpackage llm, with the SQL that a plain database needs for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelode.operators import nested
from tracelode.plans import book_queries, data_queries, program_queries, registry, service_queries, store_queries, tensor_queries, text_queries, verdict_queries  # noqa: F401
from tracelode.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.found(table(spark, sf_dir, "session_docs"), table(spark, sf_dir, "evaluators"))


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables of all shapes of both columns, each row linked to the object it came from."""
    docs = nested.tables(table(spark, sf_dir, "session_docs"), "session_row", "data", "session_docs")
    return docs.unionByName(nested.tables(table(spark, sf_dir, "evaluators"), "case_id", "program_info", "evaluators"))


P2 = """
WITH RECURSIVE src AS (SELECT 'session_docs' AS t, session_row AS id, data AS d FROM session_docs UNION ALL SELECT 'evaluators', case_id, program_info FROM evaluators),
n AS (SELECT t, id, '$' AS path, '' AS parent, CASE WHEN json_type(v) = 'VARCHAR' THEN (CASE WHEN json_valid(v ->> '$') THEN v ->> '$' END)::JSON ELSE v END AS j FROM (SELECT t, id, d::JSON AS v FROM src WHERE json_valid(d))
UNION ALL SELECT t, id, path || c.k, CASE WHEN json_type(j) = 'OBJECT' THEN path ELSE parent END,
CASE WHEN json_type(c.v) = 'VARCHAR' THEN (CASE WHEN json_valid(c.v ->> '$') THEN c.v ->> '$' END)::JSON ELSE c.v END
FROM (SELECT t, id, path, parent, j, unnest(CASE json_type(j) WHEN 'OBJECT' THEN list_transform(json_keys(j), lambda k: {'k': '.' || k, 'v': json_extract(j, k)})
ELSE list_transform(range(json_array_length(j)::BIGINT), lambda i: {'k': '[' || i || ']', 'v': json_extract(j, '$[' || i || ']')}) END) AS c FROM n WHERE json_type(j) IN ('OBJECT', 'ARRAY')))
SELECT t AS record_table, id AS record_id, path AS node_path, parent AS parent_path FROM n WHERE json_type(j) = 'OBJECT'"""


def queries() -> dict[str, registry.Query]:
    return {f.__name__: f for f in (p2_found, p2_tables)} | registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2} | registry.SQL
