"""Problem 4: near-duplicate texts, exactly, without comparing each with each.

Equal word sequences are one class. A class is a sorted array of shingle hashes with a hashed bitmap signature. Under an
order of the shingles by rarity, two sets of Jaccard similarity t or more share a shingle among their first
n - ceil(t n) + 1. Shingles that the same classes have there are one tile: each class enters it once, in its size band and, as a
visitor, in the next lower one, as no partner is smaller than t times its size. Within a tile, bit counts of the signatures
bound the overlap from above; pairs that pass meet the exact intersection of their sorted arrays. Tiles that hold more than
TILE classes are cut into blocks, and each pair of blocks is a tile of its own: no link is lost and no task gets an
unbounded group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode import runtime
from tracelode.llm import hashing
from tracelode.llm.linking import components, whole_groups

#: Words of a shingle and least similarity of near duplicates, where nothing else is asked for.
SHINGLE, SIMILAR = 5, 0.8
#: Counters of the sketch by which shingles are ordered (a bounded broadcast), least and most 64-bit words of a signature,
#: classes of a block, members of a class that one row of pairs is made of.
SKETCH, SKETCH_BLOCK, SIGNATURE, WIDEST, TILE, MEMBERS = 1 << 20, 1 << 14, 8, 64, 1024, 512


def _word_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash of each text's words, which equal classes share."""
    for b in batches:
        keys = [xxhash.xxh3_128_digest(" ".join(hashing.words(t)).encode("utf-8", "surrogatepass")) for t in b["text"]]
        both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        yield pd.DataFrame({"field": b["field"], "id": b["id"], "k1": both[:, 0], "k2": both[:, 1], "text": b["text"]})


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = hashing.WordHasher()
        for b in batches:
            # shingles of different fields are never the same
            of = {f: np.int64(xxhash.xxh3_64_intdigest(f) >> 1) for f in b["field"].unique()}
            sets = [np.sort(hashing.shingles(hashing.words(t), hasher, width) ^ of[f]) for f, t in zip(b["field"], b["text"])]
            yield pd.DataFrame({"cls": b["cls"], "n": [len(s) for s in sets], "items": sets})

    return run


def classes(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Of (field, id, text) rows: (field, id, cls) for every id, and (cls, n, items) per class. cls stands for a field and
    a sequence of words."""
    keyed = texts.mapInPandas(_word_key, "field string, id bigint, k1 bigint, k2 bigint, text string")
    least = keyed.groupBy("field", "k1", "k2").agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id"))
    least = least.select("field", F.xxhash64("field", "k1", "k2").alias("cls"), "text")
    members = keyed.select("field", "id", F.xxhash64("field", "k1", "k2").alias("cls")).distinct()
    return runtime.cut(members), runtime.cut(least.mapInPandas(_sets(width), "cls bigint, n int, items array<bigint>"))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SKETCH, np.int64)
    for b in batches:
        for s in b["items"]:
            total[np.asarray(s, np.int64) & (SKETCH - 1)] += 1
    total = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(-1, SKETCH_BLOCK)
    used = np.flatnonzero(total.any(axis=1))
    yield pd.DataFrame({"block": used, "counts": [total[k].tobytes() for k in used]})


def _add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in group["counts"])
    return pd.DataFrame({"block": [key[0]], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def _rarity(sets: DataFrame) -> np.ndarray:
    """Approximate number of classes per shingle, by slot; SKETCH counters (4 MB) at any size of the data."""
    counted = sets.select("items").mapInPandas(_count, "block int, counts binary").groupBy("block").applyInPandas(_add, "block int, counts binary")
    out = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), np.int32)
    for block, counts in counted.collect():
        out[block] = np.frombuffer(counts, np.int32)
    return out.ravel()


def _prefixes(rarity, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = rarity.value
        for b in batches:
            classes_, firsts = [], []
            for cls, n, items in zip(b["cls"], b["n"], b["items"]):
                if n == 0:
                    continue
                s = np.asarray(items, np.int64)
                rare = counts[s & (SKETCH - 1)]
                firsts.append(s[np.lexsort((s, rare))[: n - math.ceil(least * n - 1e-9) + 1]])
                classes_.append(cls)
            if firsts:
                lens = [len(p) for p in firsts]
                yield pd.DataFrame({"cls": np.repeat(classes_, lens), "item": np.concatenate(firsts)})

    return run


def width_of(band: int, least: float) -> int:
    """Words of the signatures in a size band: about a quarter of the bits get set, up to WIDEST words."""
    top = least ** -(band + 2)
    return min(WIDEST, max(SIGNATURE, 1 << math.ceil(math.log2(max(1.0, top / 16)))))


def _signature(items: np.ndarray, words: int) -> bytes:
    bits = np.zeros(words * 64, np.uint8)
    bits[hashing.mix(items.view(np.uint64)) % np.uint64(words * 64)] = 1
    return np.packbits(bits).tobytes()


def _entries(least: float):
    """Two rows for each tile a class enters: at home in its own size band, visiting the band below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("t1", "t2", "band", "home", "cls", "n", "sig")}
            for cls, n, items, tiles in zip(b["cls"], b["n"], b["items"], b["tiles"]):
                s = np.asarray(items, np.int64)
                own = int(math.log(n) / -math.log(least) + 1e-9)
                for band in (own, own - 1):
                    sig = _signature(s, width_of(band, least))
                    for t in tiles:
                        for k, v in zip(out, (t["t1"], t["t2"], band, band == own, cls, n, sig)):
                            out[k].append(v)
            yield pd.DataFrame(out)

    return run


def _compare(least: float):
    """Candidate pairs within tiles. Rows arrive sorted by tile; a tile has at most two blocks."""
    keys = ["band", "t1", "t2", "b1", "b2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, keys):
            new = np.zeros(len(b), bool)
            for k in keys:
                v = b[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.concatenate([[0], np.flatnonzero(new)])
            ends = np.append(starts[1:], len(b))
            cls, n, home, block = b["cls"].to_numpy(), b["n"].to_numpy(), b["home"].to_numpy(bool), b["block"].to_numpy()
            two = b["b1"].to_numpy() != b["b2"].to_numpy()
            sig = b["sig"].to_numpy()
            found: list[pd.DataFrame] = []
            for s, e in zip(starts, ends):
                if e - s < 2 or not home[s:e].any():
                    continue
                bits = np.frombuffer(b"".join(sig[s:e]), np.uint64).reshape(e - s, -1)
                for i in np.flatnonzero(home[s:e]):
                    # partners: in the same band each pair once, and the visitors from the band above
                    j = np.flatnonzero(np.where(home[s:e], cls[s:e] > cls[s + i], cls[s:e] != cls[s + i]))
                    if two[s]:
                        j = j[block[s + j] != block[s + i]]
                    need = least / (1 + least) * (n[s + i] + n[s + j]) - 1e-9
                    j, need = (x[np.minimum(n[s + i], n[s + j]) >= need] for x in (j, need))
                    most = (n[s + i] + n[s + j] - np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)) / 2
                    x = cls[s + j[most >= need]]
                    if len(x):
                        found.append(pd.DataFrame({"a": np.minimum(x, cls[s + i]), "b": np.maximum(x, cls[s + i])}))
            if found:
                yield pd.concat(found).drop_duplicates()

    return run


def tiles_of(sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """(cls, tiles): shingles that the same two or more classes have among their first ones are one tile, named by a
    128-bit hash of these classes. An item may be that of a third of all classes: see with_shared_key."""
    key = ["item"]
    salted = firsts.withColumn("_salt", runtime.salt_of("cls"))
    name = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"t{k}") for k in (1, 2)]
    part = salted.groupBy(*key, "_salt").agg(F.count("*").alias("c"), *name)
    whole = part.groupBy(*key).agg(F.sum("c").alias("c"), F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2")).where("c > 1").drop("c")
    marked = part.select(*key, "_salt").join(whole, key)
    return salted.join(marked, [*key, "_salt"]).groupBy("cls").agg(F.collect_set(F.struct("t1", "t2")).alias("tiles"))


def links(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of different classes that are similar by least or more."""
    spark = sets.sparkSession
    rarity = spark.sparkContext.broadcast(_rarity(sets))
    firsts = runtime.cut(sets.mapInPandas(_prefixes(rarity, least), "cls bigint, item bigint"))
    listed = tiles_of(sets, firsts)
    entries = sets.join(listed, "cls").mapInPandas(_entries(least), "t1 bigint, t2 bigint, band int, home boolean, cls bigint, n int, sig binary")
    entries = runtime.cut(entries.withColumn("_salt", runtime.salt_of("cls")))
    key = ["t1", "t2", "band"]
    part = entries.groupBy(*key, "_salt").agg(F.count("*").alias("c"), F.max(F.col("home").cast("int")).alias("h"))
    full = part.groupBy(*key).agg(F.sum("c").alias("c"), F.max("h").alias("h")).where("c > 1 and h = 1").select(*key, F.ceil(F.col("c") / TILE).cast("int").alias("blocks"))
    sized = entries.join(part.select(*key, "_salt").join(full, key), [*key, "_salt"])
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("b1"), F.lit(0).alias("b2")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("b1"), F.greatest(x, F.col("block")).alias("b2")))
    )
    placed = sized.withColumn("block", block).withColumn("p", F.explode(pairs)).select(*key, F.col("p.b1").alias("b1"), F.col("p.b2").alias("b2"), "block", "home", "cls", "n", "sig")
    # sorted by band first, as all signatures of a band are equally wide
    tiles = placed.repartition(*key, "b1", "b2").sortWithinPartitions("band", "t1", "t2", "b1", "b2")
    near = tiles.mapInPandas(_compare(least), "a bigint, b bigint").distinct()
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("items_b"))
    met = near.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("items_a", "items_b"))
    score = both / (F.size("items_a") + F.size("items_b") - both)
    return runtime.cut(met.select("a", "b", score.alias("similarity")).where(F.col("similarity") >= least))


def _texts(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    one = [df.select(F.lit(f).alias("field"), F.col(id_col).cast("bigint").alias("id"), F.col(f).alias("text")) for f in fields]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out.where(F.col("id").isNotNull() & F.col("text").isNotNull())


def similar_pairs(df: DataFrame, id_col: str = "program_id", fields: tuple[str, ...] = ("task_instructions", "program"), width: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """(field_name, first_id, second_id): every pair of different ids whose texts in a field are similar by least or more.

    Null ids and texts have no pairs; texts below width words have no shingles and no pairs, not even with their copies;
    repeated rows count once; copies are similar by 1. An empty table gives an empty result.
    """
    members, sets = classes(_texts(df, id_col, list(fields)), width)
    sizes = members.groupBy("cls").agg(F.count("*").alias("c"))
    # most classes have one member and no link: those can't give a pair
    own = sets.where("n > 0").join(sizes.where("c > 1"), "cls", "left_semi").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    linked = links(sets, least).select("a", "b").unionByName(own)
    # a class may hold a third of all ids: its members come in groups of about MEMBERS, and each two groups meet for themselves
    for end in "ab":
        groups = sizes.select(F.col("cls").alias(end), F.ceil(F.col("c") / MEMBERS).cast("int").alias("_groups"))
        linked = linked.join(groups, end).withColumn(f"g{end}", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")
    placed = runtime.join_salted(members, sizes, ["cls"], "inner").withColumn("g", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / MEMBERS)).cast("int"))
    first = placed.select("field", F.col("cls").alias("a"), F.col("g").alias("ga"), F.col("id").alias("x"))
    second = placed.select(F.col("cls").alias("b"), F.col("g").alias("gb"), F.col("id").alias("y"))
    met = linked.join(first, ["a", "ga"]).join(second, ["b", "gb"])
    ordered = met.where("x <> y and (a <> b or x < y)").select(F.col("field").alias("field_name"), F.least("x", "y").alias("first_id"), F.greatest("x", "y").alias("second_id"))
    return ordered.distinct()


def near_groups(df: DataFrame, id_col: str = "program_id", fields: tuple[str, ...] = ("task_instructions", "program"), width: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """(field_name, id, class_id, group_id, links): one row per id and text of a field, with the smallest id of its exact
    class, the smallest id that chains of similar texts lead to, and the number of other classes its class is linked to."""
    members, sets = classes(_texts(df, id_col, list(fields)), width)
    linked = links(sets, least)
    reps = members.groupBy("cls").agg(F.min("id").alias("class_id"))
    both = linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = components(linked.select(F.col("a").alias("x"), F.col("b").alias("y")))
    grouped = label.withColumnRenamed("x", "cls").join(reps, "cls")
    first = grouped.groupBy("label").agg(F.min("class_id").alias("group_id"))
    placed = runtime.join_salted(grouped.select("cls", "label"), first, ["label"], "inner").select("cls", "group_id")
    degree = both.groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("links"))
    told = reps.join(degree, "cls", "left").join(placed, "cls", "left")
    out = runtime.join_salted(members, told, ["cls"], "inner")
    return out.select(F.col("field").alias("field_name"), "id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
