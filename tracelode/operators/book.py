"""Transition-pair books: how often one operation follows another, with rounds, injection and discards.

A book is a DataFrame (src, dst, occ) with one row per pair. Books are never changed in place: every operator returns
the next version, and keeping the old one is the rollback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["src", "dst"]
FIRST = "NONE"
BOOK = "src string, dst string, occ bigint"


def previous(trace: str | list[str], op: str, order: list[str]) -> Column:
    """The operation before this one in its trace; NONE for the first."""
    return F.coalesce(F.lag(op).over(Window.partitionBy(trace).orderBy(*order)), F.lit(FIRST))


def transition_pairs(steps: DataFrame, trace: str, op: str, order: list[str]) -> DataFrame:
    """The book of a log of operations; null operations are left out before pairing."""
    pairs = steps.where(F.col(op).isNotNull()).select(previous(trace, op, order).alias("src"), F.col(op).alias("dst"))
    return count_pairs(pairs)


def count_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*PAIR).agg(F.count("*").alias("occ"))


def record(book: DataFrame, pairs: DataFrame) -> DataFrame:
    """One more for every row of pairs."""
    return book.select(*PAIR, "occ").unionByName(count_pairs(pairs)).groupBy(*PAIR).agg(F.sum("occ").alias("occ"))


def lookup(book: DataFrame, asked: DataFrame) -> DataFrame:
    """Counts of the asked pairs; 0 for those not in the book."""
    return asked.select(*PAIR).join(book, PAIR, "left").select(*PAIR, F.coalesce("occ", F.lit(0)).cast("bigint").alias("occ"))


def both(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of either book with their counts in both, 0 where missing."""
    o, n = old.select(*PAIR, F.col("occ").alias("old_occ")), new.select(*PAIR, F.col("occ").alias("new_occ"))
    return o.join(n, PAIR, "full_outer").select(*PAIR, F.coalesce("old_occ", F.lit(0)).cast("bigint").alias("old_occ"), F.coalesce("new_occ", F.lit(0)).cast("bigint").alias("new_occ"))


def diff(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """What new has more than old. strict: a count that shrank is an error, else it is ignored."""
    met = both(old, new)
    if strict:
        met = met.withColumn("new_occ", F.when(F.col("new_occ") < F.col("old_occ"), F.raise_error(F.lit("a count of the book shrank")).cast("bigint")).otherwise(F.col("new_occ")))
    return met.where("new_occ > old_occ").select(*PAIR, (F.col("new_occ") - F.col("old_occ")).alias("occ"))


def round_diff(snapshot: DataFrame | None, book: DataFrame) -> DataFrame:
    """Growth since the round's snapshot; a round that never began is an error."""
    if snapshot is None:
        raise ValueError("no round has begun")
    return diff(snapshot, book)


def inject(book: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts become the larger of the book's and the given one; of several given, the largest."""
    given = pairs.groupBy(*PAIR).agg(F.max("occ").alias("occ"))
    return both(book, given).select(*PAIR, F.greatest("old_occ", "new_occ").alias("occ"))


def pending(marks: DataFrame) -> DataFrame:
    """Marks (src, dst, dec) summed per pair; any negative mark asks for removal."""
    return marks.groupBy(*PAIR).agg(F.sum(F.greatest("dec", F.lit(0))).alias("dec"), F.bool_or(F.col("dec") < 0).alias("remove"))


def _discarded(book: DataFrame, marks: DataFrame) -> DataFrame:
    left = F.when(F.coalesce("remove", F.lit(False)), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("occ") - F.coalesce("dec", F.lit(0))))
    return book.join(pending(marks), PAIR, "left").select(*PAIR, F.col("occ").alias("was"), left.cast("bigint").alias("occ"), F.col("dec").isNotNull().alias("marked"))


def apply_discards(book: DataFrame, marks: DataFrame) -> DataFrame:
    """The book after its pending discards; counts that reach 0 go, unknown pairs have no effect."""
    return _discarded(book, marks).where("occ > 0").select(*PAIR, "occ")


def removed_by(book: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs that apply_discards takes out."""
    return _discarded(book, marks).where("occ = 0 and marked").select(*PAIR)


def reconcile(book: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Removed pairs go, added ones are injected."""
    return inject(apply_discards(book, removed.select(*PAIR, F.lit(-1).alias("dec"))), added)


def pair_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, dst, kind): pairs of both books, or of one only."""
    o, n = old.select(*PAIR).distinct(), new.select(*PAIR).distinct()
    parts = (("matched", o.intersect(n)), ("only_old", o.exceptAll(n)), ("only_new", n.exceptAll(o)))
    one = [x.withColumn("kind", F.lit(k)) for k, x in parts]
    return one[0].unionByName(one[1]).unionByName(one[2])


def pair_key(src: Column, dst: Column) -> Column:
    return F.concat_ws("||", src, dst)


def split_key(key: Column) -> tuple[Column, Column]:
    """Both parts of a key, split at the first separator only."""
    parts = F.split(key, r"\|\|", 2)
    return F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))


PARTS = {"data": "occ", "pending_discards": "dec", "round_snapshot": "occ"}


def from_json_book(text: DataFrame, column: str = "value", part: str = "data") -> DataFrame:
    """A part of a book stored as {"data": {"src||dst": n}, "pending_discards": {...}, "round_snapshot": {...}}; a part that isn't
    there is empty."""
    data = F.from_json(column, ", ".join(f"{k} map<string,bigint>" for k in PARTS))[part]
    rows = text.select(F.explode(data).alias("key", PARTS[part]))
    src, dst = split_key(F.col("key"))
    return rows.select(src.alias("src"), dst.alias("dst"), PARTS[part])


def _as_map(pairs: DataFrame, count: str, name: str) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct(pair_key(F.col("src"), F.col("dst")).alias("k"), F.col(count).alias("v"))))
    return pairs.agg(F.map_from_entries(entries).alias(name))


def to_json_book(book: DataFrame, pending: DataFrame | None = None, snapshot: DataFrame | None = None) -> DataFrame:
    """One row: the book as JSON, with pending discards and a round's snapshot if given. A book has a row per pair of operation
    names, so it is small by nature."""
    out = _as_map(book, "occ", "data")
    for name, part in (("pending_discards", pending), ("round_snapshot", snapshot)):
        if part is not None:
            out = out.join(F.broadcast(_as_map(part, PARTS[name], name)))  # one row each
    return out.select(F.to_json(F.struct(*out.columns)).alias("value"))


def unit_hash(*parts: Column) -> Column:
    """A number above 0 and below 1 that depends on the parts only; any SQL engine with md5 gives the same."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0


def energy(candidates: DataFrame, book: DataFrame, keys: list[str]) -> DataFrame:
    """Per candidate (keys) with pairs src, dst: the least count of its pairs, how many were never seen, and the weight
    1 / (least + 1e-7)."""
    met = candidates.join(book, PAIR, "left").withColumn("occ", F.coalesce("occ", F.lit(0)))
    return met.groupBy(*keys).agg(F.min("occ").cast("bigint").alias("least"), F.count_if(F.col("occ") == 0).alias("unseen")).withColumn("weight", 1 / (F.col("least") + 1e-7))


def weighted_pick(rows: DataFrame, group: list[str], keys: list[str], weight: Column, seed: int = 0) -> DataFrame:
    """One row per group, with probability in proportion to weight: the least of -ln(u) / weight, where u hashes the keys.
    Ties go to the smallest keys; weights of 0 or null are never picked."""
    u = unit_hash(F.lit(seed), *[F.col(k) for k in keys])
    race = rows.where(weight > 0).withColumn("_race", -F.ln(u) / weight)
    first = F.row_number().over(Window.partitionBy(*group).orderBy("_race", *keys))
    return race.withColumn("_n", first).where("_n = 1").drop("_n", "_race")
