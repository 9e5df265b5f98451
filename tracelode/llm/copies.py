"""Problem 6: records that differ only in white space, letter case, punctuation or field order.

Each record becomes a canonical 128-bit hash. Every partition fills two Bloom filters, of hashes seen once and seen again;
merging them carries what two partitions have seen once into the filter of repeats. Only rows that this filter lets through are
shuffled for exact grouping, all others are singletons at once. The filter grows with the rows, BITS_PER_ROW each, in
shards; above MAX_SHARDS the hashes are cut into slices, which are written apart and go through a filter each, one
after the other, so that no more than one filter of bounded size is ever sent around.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode import runtime

#: A shard of the filter has 2^20 bits (128 KB); 256 of them, 32 MB, are the most that is ever broadcast.
SHARD_BITS, MAX_SHARDS = 20, 256
BITS_PER_ROW = 8


def plain(text: str) -> str:
    """Letters and digits only, in lower case."""
    return "".join(filter(str.isalnum, text.lower()))


def _number(x) -> str:
    if isinstance(x, float):  # NaN and the infinities
        return f"n{x}"
    d = Decimal(x)
    return "n0" if d == 0 else f"n{d.normalize():f}" if abs(d.adjusted()) < 400 else f"n{d.normalize()}"


def opened(text: str):
    """The object or list whose JSON the text is, else the text."""
    s = text.strip(" \t\n\r")
    if s[:1] + s[-1:] in ("{}", "[]"):
        try:
            return json.loads(s, parse_float=Decimal, parse_int=Decimal)
        except (ValueError, RecursionError, ArithmeticError):
            pass
    return text


def canonical(v) -> str:
    """Equal strings for equal values: fields sorted, texts and names reduced to letters and digits, types kept apart."""
    if isinstance(v, str):
        v = opened(v)
        if isinstance(v, str):
            return "t" + plain(v)
    if isinstance(v, dict):
        return "{" + ",".join(sorted(plain(k) + ":" + canonical(x) for k, x in v.items())) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    if v is True or v is False or v is None:
        return str(v)[:1]
    return _number(v)


def record_hash(source: str | None, kind: str | None, data: str | None) -> bytes | None:
    if source is None or kind is None or data is None:
        return None
    try:
        v = json.loads(data, parse_float=Decimal, parse_int=Decimal)
        return xxhash.xxh3_128_digest(f"{canonical(source)}|{canonical(kind)}|{canonical(v)}".encode("utf-8", "surrogatepass"))
    except (ValueError, RecursionError, ArithmeticError):
        return None


def _hashed(id_col: str, source: str, kind: str, data: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [record_hash(s, k, d) for s, k, d in zip(b[source], b[kind], b[data])]
            both = np.frombuffer(b"".join(h or bytes(16) for h in found), np.int64).reshape(-1, 2)
            none = np.array([h is None for h in found], bool)
            yield pd.DataFrame({"row": b[id_col].to_numpy(), "h1": pd.Series(both[:, 0], dtype="Int64").mask(none), "h2": pd.Series(both[:, 1], dtype="Int64").mask(none)})

    return run


def hashed(df: DataFrame, id_col: str, source: str, kind: str, data: str) -> DataFrame:
    """(row, h1, h2) of the rows with an id; null hashes where source, kind or data is null or data unreadable."""
    need = df.select(F.col(id_col).cast("bigint").alias(id_col), source, kind, data).where(F.col(id_col).isNotNull())
    return need.mapInPandas(_hashed(id_col, source, kind, data), "row bigint, h1 bigint, h2 bigint")


def _spots(shards: int) -> tuple[Column, list[Column]]:
    """Shard and two positions of a hash; both positions are in one shard."""
    mask = F.lit((1 << SHARD_BITS) - 1)
    return F.pmod("h1", F.lit(shards)).cast("int"), [F.col("h2").bitwiseAND(mask).cast("int"), F.shiftright("h2", SHARD_BITS).bitwiseAND(mask).cast("int")]


def _fill(shards: int):
    """Per partition and shard, the filters of hashes seen once and seen again, compressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, again = (np.zeros(shards << (SHARD_BITS - 3), np.uint8) for _ in "oa")
        for b in batches:
            at = np.concatenate([(b["shard"].to_numpy(np.int64) << SHARD_BITS) | b[p].to_numpy(np.int64) for p in ("p0", "p1")])
            at, n = np.unique(at, return_counts=True)
            byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
            twice = (n > 1) | (once[byte] & bit > 0)
            np.bitwise_or.at(again, byte[twice], bit[twice])
            np.bitwise_or.at(once, byte, bit)
        pack = zstandard.ZstdCompressor(level=1).compress
        once, again = (x.reshape(shards, -1) for x in (once, again))
        for shard in np.flatnonzero(once.any(axis=1)):
            yield pd.DataFrame({"shard": [shard], "once": [pack(once[shard].tobytes())], "again": [pack(again[shard].tobytes())]})

    return run


def _merge(words: int):
    """The words of the filter of repeats: seen again in a partition, or once in two."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        once, again = (np.zeros(words, np.int64) for _ in "oa")
        for x, y in zip(group["once"], group["again"]):
            x, y = (np.frombuffer(unpack(v), np.int64) for v in (x, y))
            again |= y | (once & x)
            once |= x
        return pd.DataFrame({"shard": [key[0]], "words": [again]})

    return run


def with_filter(rows: DataFrame, n: int) -> DataFrame:
    """rows, of which about n have a hash, with maybe: whether the filter of repeats lets the hash through. It does for every hash that
    occurs twice, and for few others."""
    shards = max(1, -(-n * BITS_PER_ROW >> SHARD_BITS))
    shard, spots = _spots(shards)
    placed = rows.withColumns({"shard": shard, "p0": spots[0], "p1": spots[1]})
    filled = placed.where("h1 is not null").select("shard", "p0", "p1").mapInPandas(_fill(shards), "shard int, once binary, again binary")
    repeats = filled.groupBy("shard").applyInPandas(_merge(1 << (SHARD_BITS - 6)), "shard int, words array<bigint>")
    hit = F.lit(True)
    for p in ("p0", "p1"):
        hit = hit & F.expr(f"shiftright(element_at(words, shiftright({p}, 6) + 1), {p} & 63) & 1 = 1")
    return placed.join(F.broadcast(repeats), "shard", "left").select("row", "h1", "h2", F.coalesce(hit, F.lit(False)).alias("maybe"))


def probed(df: DataFrame, id_col: str, source: str, kind: str, data: str) -> DataFrame:
    """(row, h1, h2, maybe) of every row with an id."""
    n = df.where(F.col(source).isNotNull() & F.col(kind).isNotNull() & F.col(data).isNotNull()).count()
    slices = max(1, -(-n * BITS_PER_ROW // (MAX_SHARDS << SHARD_BITS)))
    rows = hashed(df, id_col, source, kind, data)
    if slices == 1:
        return runtime.cut(with_filter(runtime.cut(rows), n))
    apart = runtime.written(rows.withColumn("slice", F.coalesce(F.pmod(F.shiftright("h1", 32), F.lit(slices)), F.lit(0)).cast("int")), "slice")
    out = [runtime.cut(with_filter(apart.where(F.col("slice") == k).drop("slice"), -(-n // slices))) for k in range(slices)]
    return reduce(DataFrame.unionByName, out)


def copies(df: DataFrame, id_col: str = "session_row", source: str = "source", kind: str = "type", data: str = "data") -> DataFrame:
    """(kept_row, copy_row): the smallest id of each set of equal records with each other id of the set.

    Rows with a null source, type or data or unreadable data belong to no set; rows logged identically count as copies;
    an empty table gives an empty result; further columns are not read.
    """
    likely = probed(df, id_col, source, kind, data).where("maybe")
    equal = runtime.with_shared_key(likely, ["h1", "h2"], "row", ends=True)
    return equal.where("row <> _lo").select(F.col("_lo").alias("kept_row"), F.col("row").alias("copy_row"))


def records(df: DataFrame, id_col: str = "session_row", source: str = "source", kind: str = "type", data: str = "data") -> DataFrame:
    """(kept_row, copies): one row per distinct record with the number of rows that are equal to it; singletons have 1, and
    so has each row with a null source, type or data or with unreadable data, which equals no other: the copies add up
    to the rows of df. Rows that the filter holds back are out at once, without a shuffle."""
    rows = probed(df, id_col, source, kind, data)
    grouped = rows.where("maybe").groupBy("h1", "h2").agg(F.min("row").alias("kept_row"), F.count("*").alias("copies")).select("kept_row", "copies")
    return rows.where("not maybe").select(F.col("row").alias("kept_row"), F.lit(1).cast("bigint").alias("copies")).unionByName(grouped)
