"""Conversations of a generator and an evaluator over programs, as rows (idx, agent, turn, role, content, structured).

Calls to a model are a function that the caller gives: it takes the requests of a round as a DataFrame and returns replies. All programs
that are still open go through a round together; the driver loops over rounds, never over programs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode import runtime

AGENTS = ("generator", "evaluator")
TURNS = "idx bigint, agent string, turn int, role string, content string"
Reply = Callable[[DataFrame], DataFrame]


def pairs(programs: DataFrame, key: str = "idx") -> DataFrame:
    """(key, agent): two agents for each program."""
    return programs.select(key).distinct().withColumn("agent", F.explode(F.array(*[F.lit(a) for a in AGENTS])))


def accepted(content: Column) -> Column:
    """The evaluator's verdict: its JSON says ok, else its text contains OK."""
    verdict = F.lower(F.get_json_object(content, "$.verdict"))
    return F.coalesce(verdict == "ok", F.contains(content, F.lit("OK")), F.lit(False))


def final_verdict(content: Column, round_no: Column, rounds: int) -> Column:
    """ok or revise; in the last round, where nobody revises any more, revise becomes rejected."""
    return F.when(accepted(content), "ok").when(round_no >= rounds, "rejected").otherwise("revise")


def tagged(content: Column) -> Column:
    """A generator's JSON as text in tags, `<field>` per line in the order of names; what is no JSON object stays as it is."""
    fields = F.from_json(content, "map<string,string>")
    entries = F.array_sort(F.map_entries(fields))
    text = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("<"), e["key"], F.lit(">"), F.coalesce(e["value"], F.lit("")), F.lit("</"), e["key"], F.lit(">"))), "\n")
    whole = F.try_parse_json(content).isNotNull() & F.startswith(F.trim(content), F.lit("{"))
    return F.when(whole, text).otherwise(content)


def last_output(turns: DataFrame, key: list[str]) -> DataFrame:
    """(key, content): the last message of the assistant."""
    return turns.where("role = 'assistant'").groupBy(*key).agg(F.max_by("content", "turn").alias("content"))


def with_summary(traces: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Traces with the summary of their intent, null where there is none."""
    return traces.join(summaries.select(key, "summary"), key, "left")


def variable_block(names: Column, values: Column) -> Column:
    """`name = value` a line."""
    return F.array_join(F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: F.concat(x["n"], F.lit(" = "), x["v"])), "\n")


def open_indices(existing: DataFrame, resumed: DataFrame, key: str = "idx") -> DataFrame:
    """Indices that exist or were resumed, each once."""
    return existing.select(key).unionByName(resumed.select(key)).distinct()


def rounds(programs: DataFrame, generate: Reply, evaluate: Reply, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(turns, outcome (idx, verdict, rounds)) of programs (idx, content) that go back and forth until the evaluator accepts them or most
    rounds are over.

    generate and evaluate take (idx, content), the last message of the other side, and return (idx, content); a program without a reply
    keeps its last text, and an evaluator's missing reply accepts nothing.
    """
    todo = runtime.cut(programs.select(F.col("idx").cast("bigint").alias("idx"), "content"))
    turns = todo.select("idx", F.lit(AGENTS[0]).alias("agent"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "content")
    outcome = None
    for k in range(1, most + 1):
        got = todo.withColumnRenamed("content", "_old").join(generate(todo).select("idx", "content"), "idx", "left")
        made = runtime.cut(got.select("idx", F.coalesce("content", "_old").alias("content")))
        verdicts = runtime.cut(made.select("idx").join(evaluate(made).select("idx", "content"), "idx", "left"))
        turns = turns.unionByName(made.select("idx", F.lit(AGENTS[0]).alias("agent"), F.lit(2 * k - 1).alias("turn"), F.lit("assistant").alias("role"), "content"))
        turns = turns.unionByName(verdicts.select("idx", F.lit(AGENTS[1]).alias("agent"), F.lit(2 * k).alias("turn"), F.lit("assistant").alias("role"), "content"))
        judged = verdicts.withColumn("verdict", final_verdict(F.col("content"), F.lit(k), most))
        done = judged.where("verdict <> 'revise'").select("idx", "verdict", F.lit(k).alias("rounds"))
        outcome = done if outcome is None else outcome.unionByName(done)
        todo = runtime.cut(judged.where("verdict = 'revise'").select("idx", "content"))
        if todo.isEmpty():
            break
    return turns, outcome
