"""A document store as DataFrame operators: add, query, update, delete, validate.

A store is a DataFrame with the columns id, source, type and data (JSON text); every change gives the next version.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The session types of the store.
TYPES = ["main_session", "virtual_study", "group", "comparison_session", "settings", "custom_data", "genomic_chart", "custom_gene_list"]


def canonical(data: str | Column) -> Column:
    """JSON with its keys sorted at every depth; null if it can't be read."""
    return F.to_json(F.try_parse_json(data))


def checksum(data: str | Column) -> Column:
    """md5 of the canonical JSON; of the text itself where it is no JSON."""
    c = F.col(data) if isinstance(data, str) else data
    return F.md5(F.coalesce(canonical(c), c))


def get(store: DataFrame, source: str, kind: str) -> DataFrame:
    return store.where((F.col("source") == source) & (F.col("type") == kind))


def get_one(store: DataFrame, source: str, kind: str, doc_id: Any) -> DataFrame:
    """(status, message, id): 200 with the document whose id is doc_id (a value or a column), or one row of status 404."""
    hit = get(store, source, kind).where(F.col("id") == doc_id)
    one = hit.agg(F.first("id").alias("id"))
    found = F.col("id").isNotNull()
    return one.select(F.when(found, 200).otherwise(404).alias("status"), F.when(found, "found").otherwise("not found").alias("message"), "id")


def add(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each row with the id it gets: the first id of those equal in key (source, type, checksum). A minimum per key is
    aggregated before the shuffle, so a key of very many copies costs no more than others."""
    first = rows.groupBy(*key).agg(F.min(order).alias("stored_id"), F.count("*").alias("copies"))
    return first


def next_ids(new: DataFrame, store: DataFrame, order: list[str], group: list[str]) -> DataFrame:
    """New documents numbered within their group from the largest id that the group has in the store."""
    top = store.groupBy(*group).agg(F.max(F.col("id").try_cast("bigint")).alias("_top"))
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return new.withColumn("_n", n).join(top, group, "left").withColumn("new_id", F.coalesce("_top", F.lit(1)) + F.col("_n")).drop("_n", "_top")


def query_path(store: DataFrame, data: str, path: str, value: str) -> DataFrame:
    """Documents whose value at a dotted path equals value, compared as text."""
    return store.where(F.get_json_object(data, "$." + path) == value)


COMPARE = {"$eq": "__eq__", "$ne": "__ne__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def compile_filter(document: dict | str, column) -> Column:
    """A filter document as a Column; column(path) gives the value at a path as text.

    Numbers compare as numbers, everything else as text. Operators: implicit equality, $eq, $ne, $gt, $gte, $lt, $lte, $in,
    $nin, $exists, $regex, $not, $and, $or. A missing value satisfies only $ne, $nin, $not and $exists: false.
    """
    doc = json.loads(document) if isinstance(document, str) else document
    out = F.lit(True)
    for key, want in doc.items():
        if "\x00" in key or key.startswith("$") and key not in ("$and", "$or", "$not", "$nor"):
            raise ValueError(f"invalid query: {key!r}")
        if key in ("$and", "$or", "$nor"):
            parts = [compile_filter(x, column) for x in want]
            one = parts[0]
            for x in parts[1:]:
                one = one & x if key == "$and" else one | x
            out = out & (~one if key == "$nor" else one)
        elif isinstance(want, dict) and any(k.startswith("$") for k in want):
            for op, value in want.items():
                out = out & _operator(op, value, column(key), lambda v, k=key: compile_filter({k: v}, column))
        else:
            out = out & _operator("$eq", want, column(key), None)
    return out


def _operator(op: str, value: Any, c: Column, again) -> Column:
    number = isinstance(value, int | float) and not isinstance(value, bool)
    left = c.try_cast("double") if number else c
    right = F.lit(float(value)) if number else F.lit(value if isinstance(value, str) else json.dumps(value))
    if op in COMPARE:
        if value is None:
            return c.isNull() if op == "$eq" else c.isNotNull()
        got = getattr(left, COMPARE[op])(right)
        return F.coalesce(got, F.lit(op == "$ne"))
    if op in ("$in", "$nin"):
        hit = F.lit(False)
        for v in value:  # numbers by value, as in $eq
            hit = hit | _operator("$eq", v, c, None)
        return hit if op == "$in" else ~hit
    if op == "$exists":
        return c.isNotNull() if value else c.isNull()
    if op == "$regex":
        return F.coalesce(c.rlike(value), F.lit(False))
    if op == "$not":
        return ~again(value)
    raise ValueError(f"invalid query: {op}")


def fetch(store: DataFrame, document: dict | str, data: str = "data", fields: tuple[str, ...] = ("id", "source", "type")) -> DataFrame:
    """Documents that satisfy a filter document; paths other than fields lead into data."""
    column = lambda path: F.col(path).cast("string") if path in fields else F.get_json_object(data, "$." + path.removeprefix("data."))
    return store.where(compile_filter(document, column))


def upsert(store: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The store with columns taken from changes where a key matches, and new keys added. Of several changes of one key
    the caller keeps one before."""
    new = changes.select(*key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    met = store.join(new, key, "full_outer")
    return met.select(*key, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def delete(store: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return store.join(gone.select(*key).distinct(), key, "left_anti")


def violations(source: Column, kind: Column, data: Column) -> Column:
    """What is wrong with a document, joined by ';'; '' if nothing is."""
    found = F.array(
        F.when(source.isNull(), "source is null").when(F.length(source) < 3, "source has less than 3 characters"),
        F.when(kind.isNull(), "type is null").when(~kind.isin(TYPES), F.concat(F.lit("type is none of "), F.lit(", ".join(TYPES)))),
        F.when(data.isNull(), "data is null").when(F.try_parse_json(data).isNull(), "data is no JSON"),
    )
    return F.array_join(F.array_compact(found), ";")


def status(problem: Column) -> Column:
    return F.when(problem == "", 200).otherwise(400)


def _without(value: Any, gone: frozenset) -> Any:
    if isinstance(value, dict):
        return {k: _without(v, gone) for k, v in sorted(value.items()) if k not in gone}
    return [_without(v, gone) for v in value] if isinstance(value, list) else value


def strip_keys(data: str | Column, keys: list[str]) -> Column:
    """JSON without the given keys at any depth, keys sorted; null if it can't be read. Built-in functions don't reach every
    depth, hence Arrow batches."""
    gone = frozenset(keys)

    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else json.dumps(_without(json.loads(t), gone), separators=(",", ":"), ensure_ascii=False) for t in texts], dtype=object)

    c = F.col(data) if isinstance(data, str) else data
    return strip(F.when(F.try_parse_json(c).isNotNull(), c))


def unique_fields(fields: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """Field values that only one document of a group has, by which it can be told from its siblings."""
    return fields.groupBy(*group, key, value).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


def flush(pending: DataFrame, group: str, order: str, remote_id: str, budget: int) -> DataFrame:
    """The latest pending writes of each group up to budget, as Add (no id yet) or Update."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return pending.withColumn("rank", n).where(F.col("rank") <= budget).withColumn("op", F.when(F.col(remote_id).isNull(), "Add").otherwise("Update"))


def latest(log: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last version of each key; aggregated before the shuffle."""
    return log.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("v")).select(*key, "v.*")


def longest(lineages: DataFrame, key: str, size: str, order: str, columns: list[str]) -> DataFrame:
    """The row of most transitions of each key; the first of equals."""
    return lineages.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(size), -F.col(order))).alias("v")).select(key, "v.*")


# The service: every change gives the next store and a status row per request. A store has the columns id, source, type, data and
# checksum; requests carry a number req, and one number is one request.

STORE = "id bigint, source string, type string, data string, checksum string"


def _checked(requests: DataFrame) -> DataFrame:
    """Requests with what is wrong with them and the checksum of their document."""
    return requests.withColumns({"problem": violations(F.col("source"), F.col("type"), F.col("data")), "checksum": checksum("data")})


def insert(store: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, (req, status, message, id)) after requests (req, source, type, data) are added.

    A document whose (source, type, checksum) the store or an earlier request has gives that one's id; others are numbered in
    the order of req from the store's largest id. Invalid documents have status 400 and are not added.
    """
    key = ["source", "type", "checksum"]
    good = _checked(requests)
    first = good.where("problem = ''").groupBy(*key).agg(F.min(F.struct("req", "data")).alias("one"))
    known = store.groupBy(*key).agg(F.min("id").alias("old_id"))
    fresh = first.join(known, key, "left_anti").select(*key, "one.*")
    # numbers by range, so that no task sees all new documents
    ranked = numbered(fresh, "req")
    top = store.agg(F.coalesce(F.max("id"), F.lit(1)).alias("_top"))
    added = ranked.join(F.broadcast(top)).select((F.col("_top") + F.col("_no")).alias("id"), "source", "type", "data", "checksum")
    new = store.select("id", *key[:2], "data", "checksum").unionByName(added)
    ids = new.groupBy(*key).agg(F.min("id").alias("_id"))
    told = good.join(ids, key, "left").select("req", status(F.col("problem")).alias("status"), F.when(F.col("problem") == "", "added").otherwise(F.col("problem")).alias("message"), F.when(F.col("problem") == "", F.col("_id")).alias("id"))
    return new, told


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Rows with _no, their place from 1 in the order of a unique column: places within ranges, and the sizes of the ranges before."""
    placed = df.repartitionByRange(df[order]).withColumn("_part", F.spark_partition_id())
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a partition, whatever the size of the data
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return placed.withColumn("_w", within).join(F.broadcast(before), "_part").withColumn("_no", F.col("_before") + F.col("_w")).drop("_part", "_w", "_before")


def update(store: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, (req, status, message, id)) after requests (req, source, type, id, data) replaced data and its checksum.

    404 where (source, type, id) isn't stored, 400 where the document is invalid, 409 where another document has the same source, type and
    checksum, whether stored or made so by a lesser request; of several valid requests for one document the last counts.
    """
    at = ["source", "type", "id"]
    asked = _checked(requests).join(store.select(*at, F.lit(True).alias("_there")), at, "left")
    live = asked.where("problem = '' and _there")
    last = live.groupBy(*at).agg(F.max(F.struct("req", "data", "checksum")).alias("v"))
    after = store.join(last, at, "left").select(*at, F.coalesce("v.data", "data").alias("data"), F.coalesce("v.checksum", "checksum").alias("checksum"), F.col("v.req").alias("_req"), F.col("data").alias("_data"), F.col("checksum").alias("_checksum"))
    key = ["source", "type", "checksum"]
    owner = after.groupBy(*key).agg(F.count("*").alias("_c"), F.min(F.struct(F.coalesce("_req", F.lit(-1)).alias("r"), "id")).alias("_first"))
    met = after.join(owner, key, "left").withColumn("_clash", F.col("_req").isNotNull() & (F.col("_c") > 1) & (F.col("_first.id") != F.col("id")))
    new = met.select("id", "source", "type", F.when(F.col("_clash"), F.col("_data")).otherwise(F.col("data")).alias("data"), F.when(F.col("_clash"), F.col("_checksum")).otherwise(F.col("checksum")).alias("checksum"))
    clashes = met.where("_clash").select(*at, F.lit(True).alias("_clash"))
    told = asked.join(clashes, at, "left")
    code = F.when(F.col("problem") != "", 400).when(F.col("_there").isNull(), 404).when(F.col("_clash"), 409).otherwise(200)
    message = F.when(F.col("problem") != "", F.col("problem")).when(F.col("_there").isNull(), "not found").when(F.col("_clash"), "duplicate").otherwise("updated")
    return new, told.select("req", code.alias("status"), message.alias("message"), "id")


def remove(store: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, (req, status, message, id)) after requests (req, source, type, id): 200 for the first request for a stored document,
    404 for all others."""
    at = ["source", "type", "id"]
    first = requests.groupBy(*at).agg(F.min("req").alias("_first"))
    there = store.select(*at).distinct().join(first, at)
    met = requests.join(there, at, "left")
    hit = F.coalesce(F.col("req") == F.col("_first"), F.lit(False))
    told = met.select("req", F.when(hit, 200).otherwise(404).alias("status"), F.when(hit, "deleted").otherwise("not found").alias("message"), "id")
    return store.join(requests.select(*at).distinct(), at, "left_anti"), told


def lookup(store: DataFrame, asked: DataFrame) -> DataFrame:
    """(req, id) of the documents equal to those asked for (req, source, type, data), whatever the order of their fields."""
    want = asked.withColumn("checksum", checksum("data")).select("req", "source", "type", "checksum")
    return want.join(store.select("id", "source", "type", "checksum"), ["source", "type", "checksum"]).select("req", "id")


def find(store: DataFrame, requests: DataFrame) -> DataFrame:
    """(req, status, message, id): each request (req, source, type, id) answered with 200 or 404."""
    there = store.select("source", "type", "id", F.lit(True).alias("_there")).distinct()
    met = requests.join(there, ["source", "type", "id"], "left")
    hit = F.col("_there").isNotNull()
    return met.select("req", F.when(hit, 200).otherwise(404).alias("status"), F.when(hit, "found").otherwise("not found").alias("message"), "id")


def edit(data: Column, field: str, value: Column) -> Column:
    """A JSON object with one field set, whether it had the field or not; its other values as they were, keys sorted."""
    fields = F.map_filter(F.from_json(data, "map<string,string>"), lambda k, v: k != field)
    whole = F.map_concat(F.coalesce(fields, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.create_map(F.lit(field), value.cast("string")))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(whole))))
