"""From traces to test cases: folding operation logs, reversed branches, modification with rollback, upkeep of cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators import book as B
from tracelode.operators.evaluate import type_delta

SERVER_KEYS = ["id", "checksum"]
Modify = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def fold(log: DataFrame, key: list[str], order: list[str], op: str, columns: list[str], delete: str = "Delete", local: str | None = None) -> DataFrame:
    """The live rows after a log of Add, Update and Delete: the last version of each key, unless that deletes it. Rows of the
    local operation change nothing on the server."""
    rows = log.where(F.col(op) != local) if local else log
    last = rows.groupBy(*key).agg(F.max_by(F.struct(op, *columns), F.struct(*order)).alias("_v"))
    return last.where(F.col(f"_v.{op}") != delete).select(*key, *[F.col(f"_v.{c}").alias(c) for c in columns])


def state_oracle(docs: DataFrame, group: list[str], source: str, kind: str, data: str) -> DataFrame:
    """(group, oracle): JSON of the documents by `source||type`, without what the server added; keys without documents have
    no entry."""
    fields = F.map_filter(F.from_json(data, "map<string,string>"), lambda k, v: ~k.isin(SERVER_KEYS))
    per_key = docs.groupBy(*group, B.pair_key(F.col(source), F.col(kind)).alias("_k")).agg(F.sort_array(F.collect_list(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields)))))).alias("_d"))
    return per_key.groupBy(*group).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_d"))))).alias("oracle"))


def clear(store: DataFrame, touched: DataFrame, initial: DataFrame, key: list[str]) -> DataFrame:
    """The store as a test case needs it: documents of touched keys are replaced by the initial ones."""
    return store.join(touched.select(*key).distinct(), key, "left_anti").unionByName(initial)


def align(docs: DataFrame, trace: str, order: str, pair: list[str]) -> DataFrame:
    """At least two documents of each trace share the pair (source, type): where none do, the second takes the first's."""
    w = Window.partitionBy(trace).orderBy(order)
    counts = docs.groupBy(trace, *pair).agg(F.count("*").alias("_c")).groupBy(trace).agg(F.max("_c").alias("_most"))
    n = docs.withColumn("_n", F.row_number().over(w)).join(counts, trace)
    change = (F.col("_most") < 2) & (F.col("_n") == 2)
    return n.withColumns({c: F.when(change, F.first(c).over(w)).otherwise(F.col(c)) for c in pair}).drop("_n", "_most")


def reversed_skip(condition: Column, constant: Column, negated: Column, found_in_program: Column) -> Column:
    """Why a case has no twin with its branch reversed; null if it has one."""
    return (
        F.when(condition.isNull(), "no_condition").when(constant.isNull(), "no_constant").when(~F.coalesce(found_in_program, F.lit(False)), "constant_not_in_program").when(negated.isNull(), "not_negatable").when(negated == constant, "negation_has_no_effect")
    )


def modify(programs: DataFrame, old_calls: DataFrame, book: DataFrame, change: Modify, key: str, func: str, ratio: float = 0.3) -> tuple[DataFrame, DataFrame, bool]:
    """(calls, book, kept): calls after an injected change, if every program stays within its allowance, else what came in.
    change returns (new calls, added pairs with occ); removed pairs are those of programs that lost them."""
    new_calls, added = change(old_calls)
    report = type_delta(old_calls, new_calls, [key], func, ratio)
    if not report.where("not ok").isEmpty():
        return old_calls, book, False
    w = Window.partitionBy(key).orderBy("call_no")
    pairs = lambda df: df.select(F.coalesce(F.lag(func).over(w), F.lit(B.FIRST)).alias("src"), F.col(func).alias("dst")).distinct()
    removed = pairs(old_calls).exceptAll(pairs(new_calls))
    return new_calls, B.reconcile(book, removed, added), True


def keep_cases(cases: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """Stored cases after a new evaluation: (key, action): kept where they pass, recollect where only the result moved, else
    drop; cases without a verdict are dropped."""
    met = cases.select(*key).join(verdicts, key, "left")
    action = F.when(F.col("result_pass") & F.col("state_pass"), "keep").when(F.col("state_pass") & F.col("error_info").isNull(), "recollect").otherwise("drop")
    return met.select(*key, action.alias("action"))
