"""Problem 7: items in containers of fixed capacity with little unused space, by minimum bin slack.

Items are spread over blocks of about BLOCK items, so that no task gets them all; the last bins of a block are all that this
costs. Within a block, each bin takes the largest item left and the fullest feasible combination of the others, which a
subset-sum over a bitset of reachable fillings finds. Items above the capacity are divided into full bins and a rest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode import runtime
from tracelode.llm import tokens

BLOCK = 20_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum comes nearest to room from below.

    Bit s of reach is set if sum s can be had. Counts enter in powers of two; the way back goes through the stages.
    """
    limit = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            stages.append((reach, length, take))
            reach |= (reach << (length * take)) & limit
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for before, length, take in reversed(stages):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item; all lengths lie between 1 and capacity. A combination is used again while its items last."""
    order = np.argsort(lengths, kind="stable")
    values, first, n = np.unique(lengths[order], return_index=True, return_counts=True)
    where = {int(v): list(order[f : f + c][::-1]) for v, f, c in zip(values, first, n)}
    counts = {int(v): int(c) for v, c in zip(values, n)}
    out, bin_no = np.empty(len(lengths), np.int64), 0
    for largest in sorted(counts, reverse=True):
        while counts[largest] > 0:
            counts[largest] -= 1
            combo = fullest(counts, capacity - largest)
            counts[largest] += 1
            combo[largest] = combo.get(largest, 0) + 1
            for _ in range(min(counts[x] // k for x, k in combo.items())):
                for x, k in combo.items():
                    counts[x] -= k
                    for _ in range(k):
                        out[where[x].pop()] = bin_no
                bin_no += 1
    return out


def _pack_block(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["id", "part"], kind="stable").reset_index(drop=True)
    bins = pack(group["size"].to_numpy(np.int64), int(group["capacity"].iloc[0]))
    return group.assign(bin=bins)[["pack_name", "capacity", "block", "bin", "id", "part", "offset", "size"]]


def packed(items: DataFrame, packs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pack_name, capacity, pack_id, id, part, offset, size): which items (id, size) lie in which container of each kind.

    Items of null or no size lie nowhere; only items above a capacity have several parts, each but the last of full
    capacity; equal items are items of their own; packs without a positive capacity are left out. Empty tables give an
    empty result; further columns are not read.
    """
    sized = runtime.cut(items.where("size > 0").select(F.col("id").cast("bigint").alias("id"), F.col("size").cast("bigint").alias("size")))
    blocks = max(1, round(sized.count() / block))
    kinds = packs.where("capacity_tokens > 0 and pack_name is not null").select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    # by id and place, as one id may be that of a third of all items
    placed = sized.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("size") / F.col("capacity")) - 1))
    # the kinds are rows of a fixed table, each of which every item meets; blocks take no part in this join
    cutup = placed.join(F.broadcast(kinds)).withColumn("part", parts).withColumn("offset", F.col("part") * F.col("capacity"))
    cutup = cutup.select("pack_name", "capacity", "block", "id", "part", "offset", F.least("capacity", F.col("size") - F.col("offset")).alias("size"))
    schema = "pack_name string, capacity bigint, block int, bin bigint, id bigint, part bigint, offset bigint, size bigint"
    out = cutup.groupBy("pack_name", "block").applyInPandas(_pack_block, schema)
    return out.select("pack_name", "capacity", F.concat_ws("-", "block", "bin").alias("pack_id"), "id", "part", "offset", "size")


def document_packs(documents: DataFrame, pack_sizes: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str = tokens.TOKENIZERS) -> DataFrame:
    sized = tokens.with_tokens(documents.where("doc_id is not null"), ["doc_id"], "text", tokenizer, folder)
    return packed(sized.select(F.col("doc_id").alias("id"), F.col("n_tokens").alias("size")), pack_sizes)


def fill_report(packed_items: DataFrame) -> DataFrame:
    """(pack_name, packs, items, tokens, fill_share) per kind of container."""
    one = packed_items.groupBy("pack_name", "capacity", "pack_id").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    return one.groupBy("pack_name").agg(F.count("*").alias("packs"), F.sum("n").alias("items"), F.sum("s").alias("tokens"), (F.sum("s") / F.sum("capacity")).alias("fill_share"))
