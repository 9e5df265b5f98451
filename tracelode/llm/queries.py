"""Queries of the operators on training data; their SQL, where SQL can express them, is in oracle_sql()."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelode.llm import abuse, copies, cutoffs, defects, mixing, neardups, packing, spans
from tracelode.runtime import table

#: How far p8_limited goes beyond the largest size at which the target can be met, see mixing.reached.
REACH = 0.5

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.found(*(table(spark, sf_dir, t) for t in ("prompt_messages", "raw_messages", "chat_requests")))


def p1_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.all_defects(*(table(spark, sf_dir, t) for t in ("prompt_messages", "raw_messages", "chat_requests", "code_messages")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "translations"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_report(table(spark, sf_dir, "translations"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.removal_clusters(table(spark, sf_dir, "translations"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.similar_pairs(table(spark, sf_dir, "translations"), width=3, least=0.6)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.near_groups(table(spark, sf_dir, "translations"))


def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of p4_found: three words and 0.6, one row per document."""
    return neardups.near_groups(table(spark, sf_dir, "translations"), width=3, least=0.6)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs.cut_answers(table(spark, sf_dir, "raw_messages"), table(spark, sf_dir, "chat_requests"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs.cut_rates(table(spark, sf_dir, "raw_messages"), table(spark, sf_dir, "chat_requests"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copies(table(spark, sf_dir, "session_docs"))


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.records(table(spark, sf_dir, "session_docs"))


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.document_packs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_packs(spark, sf_dir))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), tempered=True)


def p8_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A size at which repetition limits bind, so that the exponent is bisected; p8_plan tells it."""
    return mixing.document_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), reach=REACH)


def p8_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), REACH)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_defects, p3_found, p3_report, p3_clusters, p4_found, p4_groups, p4_members, p5_found, p5_rates, p6_found, p6_collapsed, p7_packs, p7_fill, p8_mixture, p8_tempered, p8_limited, p8_plan, p8_shares, p9_found, p9_scores, p9_rates)}


P3 = """
WITH t AS (SELECT DISTINCT program_id, program FROM translations WHERE program_id IS NOT NULL AND length(program) >= 240),
w AS (SELECT program_id, md5(program) AS doc, i, md5(substr(program, i + 1, 240)) AS h FROM t, unnest(range(length(program) - 239)) r(i)),
s AS (SELECT h FROM w GROUP BY h HAVING min(program_id) < max(program_id)),
m AS (SELECT program_id, doc, i, lag(i) OVER (PARTITION BY program_id, doc ORDER BY i) AS p FROM w SEMI JOIN s USING (h)),
g AS (SELECT *, sum(CASE WHEN i - p <= 240 THEN 0 ELSE 1 END) OVER (PARTITION BY program_id, doc ORDER BY i) AS k FROM m)
SELECT DISTINCT program_id, span_from, span_chars FROM (SELECT program_id, min(i) AS span_from, max(i) + 240 - min(i) AS span_chars FROM g GROUP BY program_id, doc, k)"""

P4 = """
WITH f AS (SELECT DISTINCT 'program' AS field_name, program_id, program AS text FROM translations UNION ALL SELECT DISTINCT 'task_instructions', program_id, task_instructions FROM translations),
d AS (SELECT field_name, program_id, row_number() OVER () AS doc, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM f WHERE program_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT DISTINCT field_name, program_id, doc, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) r(i)),
n AS (SELECT doc, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.field_name, x.program_id AS p, y.program_id AS q, x.doc AS dx, y.doc AS dy, count(*) AS c FROM s x JOIN s y ON x.field_name = y.field_name AND x.g = y.g AND x.doc < y.doc AND x.program_id <> y.program_id GROUP BY ALL)
SELECT DISTINCT field_name, least(p, q) AS first_id, greatest(p, q) AS second_id FROM b JOIN n nx ON nx.doc = dx JOIN n ny ON ny.doc = dy WHERE c / (nx.n + ny.n - c) >= 0.6"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3, "p4_found": P4}
