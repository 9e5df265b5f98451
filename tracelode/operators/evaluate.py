"""Comparison of results with oracles, outcome buckets and reports."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tolerances per task, and the names of the outcome buckets.
TOLERANCE = {"session": 1e-4, "tensor": 1e-2, "voice": 1e-6}
OUTCOMES = ["pass", "generation_or_eval_error", "no_result", "syntax_error", "runtime_error", "error_with_message", "wrong_output_or_state", "failed_unclassified"]


def close(a: Column, b: Column, eps: float) -> Column:
    """Within eps; null equals null only."""
    return F.coalesce(F.abs(a - b) <= eps, a.isNull() & b.isNull())


def multiset_diff(actual: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, actual, expected): values whose numbers differ between both sides. Counts are aggregated on each side
    before they meet, so repeated values cost nothing."""
    a = actual.groupBy(*columns).agg(F.count("*").alias("_a"))
    b = expected.groupBy(*columns).agg(F.count("*").alias("_b"))
    both = a.select(*columns, "_a", F.lit(0).cast("bigint").alias("_b")).unionByName(b.select(*columns, F.lit(0).cast("bigint").alias("_a"), "_b"))
    one = both.groupBy(*columns).agg(F.sum("_a").alias("actual"), F.sum("_b").alias("expected"))
    return one.where("actual <> expected")


def multiset_equal(actual: DataFrame, expected: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, equal, more, missing): unordered equality of the rows of each group."""
    def side(df, c):
        return df.groupBy(*group, *columns).agg(F.count("*").alias(c))

    zero = F.lit(0).cast("bigint")
    both = side(actual, "a").withColumn("b", zero).unionByName(side(expected, "b").withColumn("a", zero))
    one = both.groupBy(*group, *columns).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return one.groupBy(*group).agg(F.bool_and(F.col("a") == F.col("b")).alias("equal"), F.sum(F.greatest(zero, F.col("a") - F.col("b"))).alias("more"), F.sum(F.greatest(zero, F.col("b") - F.col("a"))).alias("missing"))


def match_ranked(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Unordered one-to-one matching: equal values are numbered on both sides and joined on value and number."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    l = left.withColumn("rn", number).withColumnRenamed(order, "left_id")  # noqa: E741
    r = right.withColumn("rn", number).withColumnRenamed(order, "right_id")
    met = l.join(r, [*keys, "rn"], "full_outer")
    verdict = F.when(F.col("right_id").isNull(), "only left").when(F.col("left_id").isNull(), "only right").otherwise("matched")
    return met.select(*keys, "rn", "left_id", "right_id", verdict.alias("verdict"))


def outcome(error: Column, n_cases: Column, n_passed: Column, error_type: Column, message: Column, legacy: bool = False) -> Column:
    """The bucket of an evaluation. An error without any case to judge comes first; no cases are no result; syntax and
    runtime errors go by their type, which legacy ignores as the original does."""
    typed = F.lit(False) if legacy else error_type.isNotNull()
    return (
        F.when(error.isNotNull(), "generation_or_eval_error")
        .when(n_cases.isNull() | (n_cases == 0), "no_result")
        .when(n_passed == n_cases, "pass")
        .when(typed & error_type.rlike("(Syntax|Indentation)Error"), "syntax_error")
        .when(typed & error_type.rlike("(Error|Exception)$"), "runtime_error")
        .when(message.isNotNull(), "error_with_message")
        .when(n_passed.isNotNull(), "wrong_output_or_state")
        .otherwise("failed_unclassified")
    )


def outcome_report(rows: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """(group, bucket, n, pass_rate in percent of the group, 2 decimals)."""
    n = rows.groupBy(*group, bucket).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    rate = 100.0 * F.sum(F.when(F.col(bucket) == "pass", F.col("n")).otherwise(0)).over(w) / F.sum("n").over(w)
    return n.withColumn("pass_rate", F.round(rate, 2))


def type_delta(old: DataFrame, new: DataFrame, group: list[str], name: str, ratio: float = 0.3, gap: int = 1) -> DataFrame:
    """(group, added, removed, delta, allowed, ok): how far the calls per function moved, and whether that is allowed."""
    zero = F.lit(0).cast("bigint")
    o = old.groupBy(*group, name).agg(F.count("*").alias("o")).withColumn("m", zero)
    m = new.groupBy(*group, name).agg(F.count("*").alias("m")).withColumn("o", zero)
    each = o.unionByName(m).groupBy(*group, name).agg(F.sum("o").alias("o"), F.sum("m").alias("m"))
    agg = each.groupBy(*group).agg(F.sum(F.greatest(zero, F.col("m") - F.col("o"))).alias("added"), F.sum(F.greatest(zero, F.col("o") - F.col("m"))).alias("removed"), F.sum("o").alias("calls"))
    delta = agg.withColumn("delta", F.greatest("added", "removed")).withColumn("allowed", allowed_changes(F.col("calls"), ratio) + gap)
    return delta.withColumn("ok", F.col("delta") <= F.col("allowed")).drop("calls")


def allowed_changes(calls: Column, ratio: float) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(calls * ratio))


def response_diagnostics(rows: DataFrame, group: list[str], text: str, tokens: str) -> DataFrame:
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return rows.groupBy(*group).agg(
        F.count("*").alias("responses"), F.min(n).alias("least"), F.floor(F.median(n)).cast("bigint").alias("median"), F.max(n).alias("most"),
        F.count_if(n < 64).alias("short"), F.count_if(n == 0).alias("blank"), F.min(tokens).alias("least_tokens"), F.floor(F.median(tokens)).cast("bigint").alias("median_tokens"), F.max(tokens).alias("most_tokens"),
    )


def verdict_record(result_pass: Column, error_info: Column, state_pass: Column) -> Column:
    return F.struct(result_pass.alias("result_pass"), error_info.alias("error_info"), state_pass.alias("state_pass"))


def failure_cutoff(runs: DataFrame, group: str, order: list[str], failed: Column, cap: int) -> DataFrame:
    """Per group, where the cap of failures in a row is first reached; null if never."""
    w = Window.partitionBy(group).orderBy(*order)
    island = F.sum((~failed).cast("int")).over(w)
    numbered = runs.withColumn("_island", island).withColumn("_no", F.row_number().over(w))
    run = F.sum(failed.cast("int")).over(Window.partitionBy(group, "_island").orderBy(*order))
    return numbered.withColumn("_run", run).groupBy(group).agg(F.min(F.when(F.col("_run") >= cap, F.col("_no"))).cast("bigint").alias("stopped_at"), F.count("*").alias("runs"))


# Comparison of nested results. Values are JSON texts; what built-in functions can't compare at any depth goes through Arrow batches.


def _same(a: Any, b: Any, eps: float, top: bool = True) -> bool:
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    if number(a) and number(b):
        return abs(a - b) <= eps
    if top and isinstance(a, dict) and isinstance(b, dict):
        # the keys of the candidate decide; a key that the oracle lacks is a difference
        return all(k in b and _same(v, b[k], eps, False) for k, v in a.items())
    return type(a) is type(b) and a == b


def same_result(actual: Column, oracle: Column, eps: float, server_keys: tuple[str, ...] = ("id", "checksum")) -> Column:
    """Whether a result equals its oracle: numbers within eps, objects by the keys of the result with numbers within eps, everything else if
    equal; keys that the server adds don't count at any depth. Null equals null only; text that is no JSON is compared as text."""
    gone = frozenset(server_keys)

    def strip(v: Any) -> Any:
        if isinstance(v, dict):
            return {k: strip(x) for k, x in v.items() if k not in gone}
        return [strip(x) for x in v] if isinstance(v, list) else v

    def read(t: str) -> Any:
        try:
            return strip(json.loads(t))
        except ValueError:
            return t

    @F.pandas_udf("boolean")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is None and y is None if x is None or y is None else _same(read(x), read(y), eps) for x, y in zip(a, b)], dtype=bool)

    return compare(actual, oracle)


def same_state(actual: DataFrame, oracle: DataFrame, case: str, key: list[str], data: str) -> DataFrame:
    """(case, state_pass, detail): whether each case's documents equal those of its oracle by key, in any order, JSON compared by
    canonical text. Only keys that the oracle has are looked at, as a key without documents has no entry; detail names the first
    key that differs."""
    asked = oracle.select(case, *key).distinct()
    canonical = F.coalesce(F.to_json(F.try_parse_json(data)), F.col(data))
    side = lambda df: df.select(case, *key, canonical.alias("_d"))
    per_key = multiset_equal(side(actual.join(asked, [case, *key], "left_semi")), side(oracle), [case, *key], ["_d"])
    named = F.when(~F.col("equal"), F.concat_ws("||", *key))
    return per_key.groupBy(case).agg(F.bool_and("equal").alias("state_pass"), F.min(named).alias("detail"))


def call_log_verdict(actual: DataFrame, expected: DataFrame, case: str, columns: list[str]) -> DataFrame:
    """(case, ok, message): unordered comparison of call logs, the numbers of calls first. Messages: more calls, fewer calls, a call that
    is missing, calls that differ."""
    n = lambda df, name: df.groupBy(case).agg(F.count("*").alias(name))
    sizes = n(actual, "_a").join(n(expected, "_b"), case, "full_outer").select(case, F.coalesce("_a", F.lit(0)).alias("_a"), F.coalesce("_b", F.lit(0)).alias("_b"))
    diff = multiset_equal(actual, expected, [case], columns)
    met = sizes.join(diff, case)
    message = (
        F.when(F.col("_a") > F.col("_b"), F.concat(F.lit("more calls than expected: "), "_a", F.lit(" of "), "_b"))
        .when(F.col("_a") < F.col("_b"), F.concat(F.lit("fewer calls than expected: "), "_a", F.lit(" of "), "_b"))
        .when(F.col("missing") == 1, "an expected call is missing")
        .when(F.col("missing") > 1, F.concat("missing", F.lit(" calls differ")))
    )
    return met.select(case, message.isNull().alias("ok"), message.alias("message"))


def reference_program(cases: DataFrame, key: str) -> DataFrame:
    """(key, program) of the first case of each evaluator."""
    return cases.groupBy(key).agg(F.min_by("program", "case_no").alias("program"))


def summarised(shape: Column, dtype: Column, value: Column) -> Column:
    """A value in short: shape and type of a tensor, the text of anything else."""
    return F.when(shape.isNotNull(), F.concat(F.lit("tensor(shape=["), F.array_join(F.transform(shape, lambda x: x.cast("string")), ", "), F.lit("], dtype="), dtype, F.lit(")"))).otherwise(value)
