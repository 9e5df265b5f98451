"""Connected components of links between records, and helpers for tasks that read sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode import runtime


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows that arrive sorted by keys, in pieces that hold each group whole."""
    rest = None
    for b in batches:
        b = b if rest is None or not len(rest) else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        other = np.zeros(len(b), bool)
        for k in keys:
            other |= (b[k] != b[k].iloc[-1]).to_numpy()
        at = np.flatnonzero(other)
        whole = int(at[-1]) + 1 if len(at) else 0
        if whole:
            yield b.iloc[:whole].reset_index(drop=True)
        rest = b.iloc[whole:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def _fingerprint(edges: DataFrame) -> tuple:
    columns = edges.columns
    return tuple(edges.select(F.count("*"), F.bit_xor(F.xxhash64(*columns)), F.bit_xor(F.xxhash64(*columns, F.lit(1)))).first())


def components(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, x, label): the least node of the connected component of every node in edges (by, x, y), nodes being numbers.

    Large stars and small stars in turn: a node hands its greater neighbours, then its lesser ones, to its least neighbour, so
    that paths shorten by half and rounds grow with the logarithm of a chain's length. Only minima are gathered per node,
    links come back through salted keys, and three numbers a round reach the driver.
    """
    by = by or []
    pairs = runtime.cut(edges.where("x <> y").select(*by, F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    before = _fingerprint(pairs)
    while True:
        both = pairs.unionByName(pairs.select(*by, F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy(*by, "x").agg(F.least("x", F.min("y")).alias("m"))
        large = runtime.join_salted(both.where("y > x"), least, [*by, "x"], "inner").select(*by, F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = runtime.cut(large)
        low = large.groupBy(*by, "x").agg(F.min("y").alias("m"))
        told = runtime.join_salted(large, low, [*by, "x"], "inner")
        small = told.select(*by, F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(low.select(*by, "x", F.col("m").alias("y")))
        pairs = runtime.cut(small.distinct())
        after = _fingerprint(pairs)
        if after == before:
            break
        before = after
    return pairs.select(*by, "x", F.col("y").alias("label")).unionByName(pairs.select(*by, F.col("y").alias("x"), F.col("y").alias("label")).distinct())
