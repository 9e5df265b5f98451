"""Texts of prompts, answers and programs: assembly, extraction, normalisation, rendering."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# JSON fields and headings under which instructions may stand, and parts of a prompt.
DEFINITIONS = ["user_variable_definitions", "user_variables", "variable_definitions"]
TASKS = ["task_instructions", "instructions", "task"]
BASE_URL_MARK = "{{ BASE_URL }}"


def placeholder(text: Column, url: str) -> Column:
    """The base URL in place of its marks, with or without blanks."""
    return F.regexp_replace(text, r"\{\{\s*BASE_URL\s*\}\}", F.lit(url))


def last_code_block(text: Column) -> Column:
    """The content of the last fenced block without its language tag; without a fence, the text without backticks."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)```(?:\w*\n)?(.*?)```"), 1)
    return F.when(F.size(blocks) > 0, F.element_at(blocks, -1)).otherwise(F.replace(text, F.lit("`"), F.lit("")))


def strip_fence(text: Column) -> Column:
    """A text that is one fenced block, without its first and last line of fence."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```\w*\n", ""), r"\n?```$", "")


def without_exit(code: Column) -> Column:
    return F.replace(code, F.lit("exit()"), F.lit(""))


def api_names(doc: Column) -> Column:
    """Names of functions defined in a text, then requests.<verb> for its HTTP lines; each once, sorted."""
    functions = F.regexp_extract_all(doc, F.lit(r"def ([A-Za-z_]\w*)\("), 1)
    verbs = F.transform(F.regexp_extract_all(doc, F.lit(r"(?m)^\s*(GET|POST|PUT|DELETE|PATCH) /"), 1), lambda v: F.concat(F.lit("requests."), F.lower(v)))
    return F.array_sort(F.array_distinct(F.concat(functions, verbs)))


def listed_calls(doc: Column) -> Column:
    """Names of the calls that a text lists as `- name(...)`, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(doc, F.lit(r"- ([A-Za-z_]\w*)\("), 1)))


def safe_tag(name: Column) -> Column:
    """A name fit for files; 'model' if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(name), "[^a-z0-9._-]+", "_"), F.lit("")), F.lit("model"))


def token_limit_error(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.contains(low, F.lit("max_tokens")) | F.contains(low, F.lit("token limit")) | F.contains(low, F.lit("context length"))


def response_text(body: Column) -> Column:
    """The answer in a response body, of its known shapes; '' if there is none."""
    direct = F.coalesce(F.get_json_object(body, "$.output_text"), F.get_json_object(body, "$.choices[0].message.content"))
    parts = F.from_json(F.get_json_object(body, "$.choices[0].message.content"), "array<struct<text:string>>")
    output = F.from_json(body, "output array<struct<content:array<struct<text:string>>>>")["output"]
    texts = F.flatten(F.transform(output, lambda o: F.transform(F.coalesce(o["content"], F.array().cast("array<struct<text:string>>")), lambda c: c["text"])))
    listed = F.startswith(direct, F.lit("[")) & parts.isNotNull()
    return F.coalesce(F.when(listed, F.array_join(F.transform(parts, lambda p: p["text"]), "")).otherwise(direct), F.array_join(texts, ""), F.lit(""))


def choice_error(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.choices[0].error.message"), F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.error"))


def instructions(text: Column) -> tuple[Column, Column]:
    """(definitions, task) of a JSON object with any of the known field names, or of a text with headings in any case, with
    or without angle brackets, in either order; the whole text is the task if neither is found."""
    from_object = lambda names: F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in names])
    head = lambda a, b: F.btrim(F.regexp_extract(text, rf"(?is)<?{a}>?\s*:?\s*(.*?)(?:</?{a}>|<?{b}>?\s*:|\z)", 1), F.lit(" \n\r\t"))
    d, t = head("user variable definitions", "task instructions"), head("task instructions", "user variable definitions")
    found = F.regexp_like(text, F.lit(r"(?i)task instructions"))
    return F.coalesce(from_object(DEFINITIONS), F.nullif(d, F.lit(""))), F.coalesce(from_object(TASKS), F.when(found, F.nullif(t, F.lit(""))), text)


def prompt(doc: Column, definitions: Column, task: Column) -> Column:
    """The parts of a prompt that are there, each under its heading."""
    part = lambda title, c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"## {title}\n"), c))
    return F.concat_ws("\n\n", part("Documentation", doc), part("Variables", definitions), part("Task", task))


def variable_names(info: Column) -> Column:
    """Names of [[name, value], ...] in their order, each once, without blanks."""
    pairs = F.from_json(info, "array<array<string>>")
    return F.array_distinct(F.filter(F.transform(pairs, lambda p: F.trim(p[0])), lambda n: F.length(n) > 0))


def value_type(json_text: Column) -> Column:
    """dict, list, str, number, bool, null or none (no JSON)."""
    kind = F.schema_of_variant(F.try_parse_json(json_text))
    return (
        F.when(kind.isNull(), "none").when(kind.startswith("OBJECT"), "dict").when(kind.startswith("ARRAY"), "list").when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "null").otherwise("number")
    )


def negated(value: Column) -> Column:
    """The value that turns a condition false: quoted texts get _diff, lists repeat their first element, numbers grow by 1,
    data types swap."""
    listed = F.from_json(value, "array<string>")
    return (
        F.when(value.isin("float32", "int64"), F.when(value == "float32", "int64").otherwise("float32"))
        .when(value.rlike(r"^-?\d+$"), (value.try_cast("bigint") + 1).cast("string"))
        .when(value.rlike(r'^".*"$'), F.concat(F.rtrim(value, F.lit('"')), F.lit('_diff"')))
        .when(value.startswith("["), F.to_json(F.concat(listed, F.slice(listed, 1, 1))))
        .otherwise(F.concat(value, F.lit("_diff")))
    )


def accepted(verdict: Column, text: Column) -> Column:
    """A structured verdict ok, OK in the text, or a JSON verdict ok."""
    return F.coalesce(verdict == "ok", F.lit(False)) | F.coalesce(F.contains(text, F.lit("OK")), F.lit(False)) | F.coalesce(F.get_json_object(text, "$.verdict") == "ok", F.lit(False))


def allowed(name: Column, names: list[str]) -> Column:
    """The whole name or its last part is on the list."""
    return name.isin(names) | F.substring_index(name, ".", -1).isin(names)


def flatten_system(df: DataFrame, key: list[str], messages: str) -> DataFrame:
    """(key, role, content): conversations whose leading system messages are merged into the first message. Without a system
    message nothing changes; system only gives one user message; before a user message it is merged with a rule of dashes;
    before another role a user message goes first. A conversation without messages has no rows."""
    m = F.col(messages)
    systems = F.filter(m, lambda x: x["role"] == "system")
    others = F.filter(m, lambda x: x["role"] != "system")
    joined = F.array_join(F.transform(systems, lambda x: x["content"]), "\n\n")
    user = lambda c: F.struct(F.lit("user").alias("role"), c.alias("content"))
    first = others[0]
    merged = F.concat(F.array(user(F.concat(joined, F.lit("\n\n---\n\n"), first["content"]))), F.slice(others, 2, F.size(m)))
    flat = (
        F.when(F.size(systems) == 0, others).when(F.size(others) == 0, F.array(user(joined))).when(first["role"] == "user", merged).otherwise(F.concat(F.array(user(joined)), others))
    )
    return df.where(F.size(m) > 0).select(*key, F.posexplode(flat).alias("pos", "m")).select(*key, "pos", "m.role", "m.content")


@udtf(returnType="segment string, keys int, size int")
class JsonSegments:
    """Balanced top-level objects of a text that are readable JSON, each canonical form once: whole text first, then the
    content of fences, then balanced braces."""

    def eval(self, text: str):
        if not text:
            return
        seen = set()
        parts = [text.strip(), *[p.split("\n", 1)[-1] for p in text.split("```")[1::2]]]
        depth, start, quoted, escaped = 0, 0, False, False
        for i, c in enumerate(text):
            if quoted:
                escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
            elif c == '"':
                quoted = depth > 0
            elif c == "{":
                start = i if depth == 0 else start
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if depth == 0:
                    parts.append(text[start : i + 1])
        for p in parts:
            try:
                v = json.loads(p)
            except (ValueError, RecursionError):
                continue
            if isinstance(v, dict):
                form = json.dumps(v, sort_keys=True)
                if form not in seen:
                    seen.add(form)
                    yield form, len(v), len(p)


def json_candidates(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, segment, keys, size) for each JSON object found in a text."""
    return df.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("_t")).lateralJoin(JsonSegments(F.col("_t").outer()), how="inner").drop("_t")


def best_candidate(candidates: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """Per key the largest object that has all required keys, else the largest."""
    has = F.lit(True)
    for r in required:
        has = has & F.get_json_object("segment", f"$.{r}").isNotNull()
    return candidates.groupBy(*key).agg(F.max_by("segment", F.struct(has.alias("a"), "size", "segment")).alias("segment"))


def rendered(op: Column, args: Column, number: Column) -> Column:
    """One line of program text per step."""
    return F.concat(F.lit("response_"), number.cast("string"), F.lit(" = "), op, F.lit("("), args, F.lit(")"))


def program(steps: DataFrame, key: list[str], order: list[str], line: str, indent: str = "") -> DataFrame:
    """Programs: the lines of each key in their order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: F.concat(F.lit(indent), x[line]))
    return steps.groupBy(*key).agg(F.array_join(lines, "\n").alias("program"), F.count("*").alias("lines"))


def error_summary(message: Column, code: Column, line_no: Column) -> Column:
    return F.struct(
        F.element_at(F.split(message, ":"), 1).alias("error_type"), F.trim(F.substring_index(message, ":", -1)).alias("message"), line_no.alias("line_no"), F.try_element_at(F.split(code, "\n"), line_no.cast("int")).alias("line_text")
    )


def path_text(root: Column, keys: Column) -> Column:
    """A nested path as a program writes it: `x["a"][0]`; keys of digits only are indices."""
    one = lambda k: F.when(k.rlike(r"^\d+$"), F.concat(F.lit("["), k, F.lit("]"))).otherwise(F.concat(F.lit('["'), k, F.lit('"]')))
    return F.concat(root, F.array_join(F.transform(keys, one), ""))


def matches(name: Column, params: Column, wanted_name: str, wanted: dict[str, str]) -> Column:
    """Whether a call has a name and every given parameter with its value; others don't matter."""
    hit = name == wanted_name
    for k, v in wanted.items():
        hit = hit & F.coalesce(F.try_element_at(params, F.lit(k)) == v, F.lit(False))
    return F.coalesce(hit, F.lit(False))


def compact_schema(schema: object) -> object:
    """A JSON schema without titles, defaults and examples, at every depth; properties of these names stay."""
    if isinstance(schema, list):
        return [compact_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {}
    for k, v in schema.items():
        if k == "properties" and isinstance(v, dict):
            out[k] = {name: compact_schema(x) for name, x in v.items()}
        elif k not in ("title", "default", "examples"):
            out[k] = compact_schema(v)
    return out
