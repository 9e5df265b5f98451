"""Graphs of operations: degrees, simple paths, chains and metrics. Edge tables hold a row per pair of names, so they are
small whatever the size of the log they come from. The number of simple paths can grow exponentially with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode import runtime


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, role) over distinct edges without loops."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    zero = F.lit(0).cast("bigint")
    ends = e.select(F.col("src").alias("node"), F.lit(1).cast("bigint").alias("o"), zero.alias("i")).unionByName(e.select(F.col("dst").alias("node"), zero.alias("o"), F.lit(1).cast("bigint").alias("i")))
    d = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return d.withColumn("role", F.when(F.col("in_degree") == 0, "source").when(F.col("out_degree") == 0, "sink").otherwise("inner"))


def simple_paths(edges: DataFrame, starts: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(path, steps): simple paths, of up to depth edges if given, from all nodes or from starts (node). Each round joins the
    paths' ends with the edges; without depth, rounds run until no path grows."""
    e = runtime.cut(edges.select("src", "dst").where("src <> dst").distinct())
    first = e if starts is None else e.join(starts.select(F.col("node").alias("src")), "src", "left_semi")
    level = first.select(F.array("src", "dst").alias("path"), F.lit(1).alias("steps"))
    out = level
    k = 2
    while depth is None or k <= depth:
        end = level.withColumn("src", F.element_at("path", -1))
        level = end.join(e, "src").where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), F.lit(k).alias("steps"))
        if depth is None:
            level = runtime.cut(level)
            if level.isEmpty():
                break
        out = out.unionByName(level)
        k += 1
    return out


def path_depth(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """One row: edges of the longest simple path, 0 without edges."""
    return simple_paths(edges, None, depth).agg(F.coalesce(F.max("steps"), F.lit(0)).alias("depth"))


def chains(edges: DataFrame, depth: int | None = None, strip: str | None = None) -> DataFrame:
    """(chain, steps): simple paths from sources to sinks that are no contiguous part of another; without sources all nodes
    are sources, without sinks there is no chain. strip leaves a first node of that name out."""
    d = degrees(edges)
    sources = d.where("role = 'source'").select("node")
    if sources.isEmpty():
        sources = d.select("node")
    sinks = d.where("out_degree = 0").select(F.col("node").alias("_end"))
    p = simple_paths(edges, sources, depth).withColumn("_end", F.element_at("path", -1)).join(sinks, "_end", "left_semi")
    if strip:
        p = p.withColumn("path", F.when(F.col("path")[0] == strip, F.slice("path", 2, F.size("path"))).otherwise(F.col("path")))
    p = p.select("path").distinct().withColumn("key", F.concat(F.lit("\x1f"), F.array_join("path", "\x1f"), F.lit("\x1f")))
    # a part of another chain ends in the same sink, as it can't go on: it is a suffix, found through its own suffixes
    suffixes = p.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("path")), lambda i: F.slice("path", i, F.size("path")))).alias("path")).distinct()
    best = p.join(suffixes, "path", "left_anti")
    return best.select(F.array_join("path", " -> ").alias("chain"), (F.size("path") - 1).alias("steps"))


def modules(name):
    return F.when(F.instr(name, ".") > 0, F.split(name, r"\.")[0])


def metrics(calls: DataFrame, edges: DataFrame, func: str = "func", gated: str = "gated") -> DataFrame:
    """One row: distinct edges, share of edges across modules, share of gated calls, distinct functions."""
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    one = e.agg(F.count("*").alias("binding_edges"), F.count_if(~modules(F.col("a")).eqNullSafe(modules(F.col("b")))).alias("cross"))
    two = calls.agg(F.countDistinct(func).alias("distinct_calls"), F.countDistinct(F.when(F.col(gated), F.col(func))).alias("gated"))
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 6)
    both = one.withColumn("_k", F.lit(1)).join(two.withColumn("_k", F.lit(1)), "_k")  # one row each
    return both.select("binding_edges", share("cross", "binding_edges").alias("cross_module_share"), "distinct_calls", share("gated", "distinct_calls").alias("gated_share"))
