"""Deeply nested JSON columns as flat tables with parent links.

Every level of nesting is one array column of nodes: a nested transform attaches the ancestor's path and the field name
or index to each child, flatten joins the children of all nodes of the level, and one inline per target table emits the
rows. Nothing is shuffled. Levels are added until no row has a deeper node, so any depth is covered.

JSON in text counts as JSON: from_json to map<string,string> gives nested values and texts alike as strings, so the same
step opens an object, and a text that holds one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode import runtime

STRICT = {"allowSingleQuotes": "false", "allowNumericLeadingZeros": "false", "mode": "PERMISSIVE"}
BLANK = " \t\n\r"
NODE = "struct<path:string,parent:string,text:string,is_object:boolean>"
#: Levels that are unrolled in one plan before it is checked whether deeper ones exist.
LEVELS = 12
#: Rows that tables() hands over at once.
CHUNK = 20_000


def _bind(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's variable isn't evaluated again at each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _alone(text: Column) -> Column:
    """text as the only element of a list, each element as text; null if it is no JSON. The brackets make trailing
    characters an error."""
    return _bind(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT), lambda got: F.when(F.size(got) == 1, got))


def _kind(text: Column) -> Column:
    """True: the text is an object's JSON; False: a list's; null: neither."""
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    return (
        F.when((first == "{") & (last == "}") & _alone(text).isNotNull(), F.lit(True))
        .when((first == "[") & (last == "]") & _alone(text).isNotNull(), F.lit(False))
    )


def _nodes(raw: Column) -> Column:
    """Structs (path, parent, text) to nodes; those whose text is neither object nor list go."""
    trimmed = F.transform(raw, lambda n: F.struct(n["path"].alias("path"), n["parent"].alias("parent"), F.btrim(n["text"], F.lit(BLANK)).alias("text")))
    kinds = F.transform(trimmed, lambda n: F.struct(n["path"].alias("path"), n["parent"].alias("parent"), n["text"].alias("text"), _kind(n["text"]).alias("is_object")))
    return F.filter(kinds, lambda n: n["is_object"].isNotNull())


def _raw(path: Column, parent: Column, text: Column) -> Column:
    return F.struct(path.alias("path"), parent.alias("parent"), text.alias("text"))


def _last_of_each_key(entries: Column) -> Column:
    """Of a field name that is given twice, the last value counts."""
    keys = F.transform(entries, lambda e: e["key"])
    once = F.size(F.array_distinct(keys)) == F.size(keys)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.when(once, entries).otherwise(last)


def _children(node: Column) -> Column:
    """Nodes right below a node."""
    fields = _bind(
        F.map_entries(F.from_json(node["text"], "map<string,string>", STRICT)),
        lambda es: F.transform(_last_of_each_key(es), lambda e: _raw(F.concat(node["path"], F.lit("."), e["key"]), node["path"], e["value"])),
    )
    items = F.transform(
        F.from_json(node["text"], "array<string>", STRICT), lambda v, i: _raw(F.concat(node["path"], F.lit("["), i.cast("string"), F.lit("]")), node["parent"], v)
    )
    return F.coalesce(_nodes(F.when(node["is_object"], fields).otherwise(items)), F.array().cast(f"array<{NODE}>"))


def json_nodes(df: DataFrame, id_col: str, json_col: str, record_table: str, levels: int = LEVELS, text: bool = True) -> DataFrame:
    """(record_table, record_id, node_path, parent_path, node): a row for every JSON object in json_col.

    Paths: `$` the root, `.key` a field as spelled, `[i]` a list element. parent_path is the path of the nearest
    enclosing object, '' where there is none. node is the object's JSON text, and null without text. Null, empty, blank and
    unreadable columns and a column that is a bare number, text or null yield nothing; empty objects are rows; repeated input
    rows with one id come out as often. An empty table gives an empty table; other columns of df are not read.
    """
    base = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(json_col).alias("_json")).where(F.col("_json").isNotNull())
    top = _raw(F.lit("$"), F.lit(""), F.element_at(_alone(F.btrim("_json", F.lit(BLANK))), 1))
    level = base.select("record_id", _nodes(F.array(top)).alias("_l0"))
    out: DataFrame | None = None
    while True:
        for k in range(levels):
            level = level.withColumn(f"_l{k + 1}", F.flatten(F.transform(f"_l{k}", _children)))
        objects = F.filter(F.flatten(F.array(*[F.col(f"_l{k}") for k in range(levels)])), lambda n: n["is_object"])
        kept = F.transform(objects, lambda n: F.struct(n["path"].alias("node_path"), n["parent"].alias("parent_path"), (n["text"] if text else F.lit(None).cast("string")).alias("node")))
        # cut: the levels are needed twice, for the rows and to see whether deeper ones exist
        level = runtime.cut(level.select("record_id", kept.alias("_nodes"), F.col(f"_l{levels}").alias("_l0")))
        rows = level.select("record_id", F.inline("_nodes"))
        out = rows if out is None else out.unionByName(rows)
        if level.where(F.size("_l0") > 0).isEmpty():
            break
        level = level.where(F.size("_l0") > 0).select("record_id", "_l0")
    return out.select(F.lit(record_table).alias("record_table"), "record_id", "node_path", "parent_path", "node")


def found(session_docs: DataFrame, evaluators: DataFrame) -> DataFrame:
    """(record_table, record_id, node_path, parent_path) of both tables; the ids are unique in both."""
    one = lambda df, key, column, name: json_nodes(df.select(key, column), key, column, name, text=False).drop("node")
    return one(session_docs, "session_row", "data", "session_docs").unionByName(one(evaluators, "case_id", "program_info", "evaluators"))


def _is_value(text: Column) -> Column:
    """Whether a field's value stays in its object's row: all but objects and lists of nothing but objects, which have rows
    of their own."""
    trimmed = F.btrim(text, F.lit(BLANK))
    items = F.from_json(trimmed, "array<string>", STRICT)
    only_objects = (F.size(items) > 0) & F.forall(items, lambda v: F.coalesce(_kind(F.btrim(v, F.lit(BLANK))), F.lit(False)))
    return F.coalesce(~F.when(_kind(trimmed), F.lit(True)).otherwise(only_objects), F.lit(True))


def related_table(nodes: DataFrame, shape: str) -> DataFrame:
    """One flat table of those nodes whose path without indices is shape (`$.filters[]`), scalar fields and lists that hold
    more than objects as a map that keeps the link (record_table, record_id, parent_path) to the row of the parent's table."""
    fits = F.regexp_replace("node_path", r"\[\d+\]", "[]") == shape
    fields = F.map_filter(F.from_json("node", "map<string,string>", STRICT), lambda k, v: _is_value(v))
    return nodes.where(fits).select("record_table", "record_id", "node_path", "parent_path", fields.alias("fields"))


class _Raw(str):
    """A number as spelled."""


def _opened(v):
    """The object or list that a text holds; any other value as it is."""
    if isinstance(v, _Raw) or not isinstance(v, str):
        return v
    s = v.strip(BLANK)
    if s[:1] + s[-1:] not in ("{}", "[]"):
        return v
    try:
        return json.loads(s, parse_float=_Raw, parse_int=_Raw, parse_constant=_Raw)
    except (ValueError, RecursionError):
        return v


def _json(v) -> str:
    if isinstance(v, _Raw):
        return str(v)
    out = json.dumps(v, ensure_ascii=False)
    return out if out.isascii() or not any("\ud800" <= c <= "\udfff" for c in out) else json.dumps(v)


def _name(path: str) -> str:
    return path.encode("utf-8", "replace").decode()


def table_rows(text: str) -> Iterator[tuple[str, str, str, str | None, str | None]]:
    """(shape, node_path, parent_path, fields, item) of one column value, as tables() has them."""
    try:
        root = json.loads(text, parse_float=_Raw, parse_int=_Raw, parse_constant=_Raw)
    except (ValueError, RecursionError):
        return
    root = _opened(root)
    stack = [("$", "$", "", root)] if isinstance(root, dict | list) else []
    while stack:
        shape, path, parent, v = stack.pop()
        if isinstance(v, dict):
            fields, below = [], []
            for k, x in v.items():
                x = _opened(x)
                if isinstance(x, dict | list):
                    below.append((f"{shape}.{k}", f"{path}.{k}", path, x))
                else:
                    fields.append(f"{_json(k)}:{_json(x)}")
            stack.extend(reversed(below))
            yield _name(shape), _name(path), _name(parent), "{" + ",".join(fields) + "}", None
        elif isinstance(v, list) and v:
            stack.extend((f"{shape}[]", f"{path}[{i}]", parent, _opened(v[i])) for i in range(len(v) - 1, -1, -1))
        else:
            yield _name(shape), _name(path), _name(parent), None, _json(v)


def _table_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["record_id", "shape", "node_path", "parent_path", "fields", "item"]
    rows: list[tuple] = []
    for b in batches:
        for i, text in zip(b["record_id"], b["_json"]):
            for row in table_rows(text):
                rows.append((i, *row))
                if len(rows) >= CHUNK:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def tables(df: DataFrame, id_col: str, json_col: str, record_table: str) -> DataFrame:
    """(record_table, record_id, shape, node_path, parent_path, fields, item): the flat tables of all shapes, one below the other.

    shape is node_path without indices (`$.filters[]`) and names the table. Each object is a row, with fields the JSON of
    its scalar fields, texts that are no JSON and nulls included; objects and lists in it have rows of their own. Each other
    element of a list is a row too, with its JSON as item; so is a list without elements. parent_path is the enclosing
    object's node_path and links both to their parent's row, '' where there is none. Numbers stay as spelled and numbers,
    texts, true, false and null apart, which from_json to strings would not keep; hence Python. Null, unreadable and bare
    columns as in json_nodes(); further columns are not read.
    """
    need = df.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(json_col).alias("_json")).where(F.col("_json").isNotNull())
    rows = need.mapInPandas(_table_rows, "record_id bigint, shape string, node_path string, parent_path string, fields string, item string")
    return rows.select(F.lit(record_table).alias("record_table"), "*")
