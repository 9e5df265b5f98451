"""Generation of traces over a state. A trace is one row: its entities, calls and what it needs for the next step are arrays in it, bounded
by the number of calls, so that candidates, choice and change are expressions on the row and nothing is shuffled.

Each step lists the candidates of every trace, weighs them by the book and applies one of them; the pairs of the step are then added to
the book, which has at most a row per pair of operation names and goes from step to step as a literal map. Traces of one step see the
same book; one trace alone is the sequential order.

A domain is a function from a row's entities to candidates, one from a chosen candidate to the entities after it, one that renders a
call, and one that makes initial entities: see DOMAINS.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode import runtime
from tracelode.operators import book as B
from tracelode.operators.docstore import TYPES
from tracelode.operators.speech import VOICES

#: kind: document, tensor, text, term, voice or speech. id: the server's number of a document; remote: the text the server has. dirty: changed
#: here since. last: the operation that touched the entity last. source of: what a derived entity comes from.
ENTITY = "struct<no:int,name:string,kind:string,source:string,type:string,id:bigint,text:string,remote:string,dirty:boolean,shape:array<int>,parent:int,last:string>"
CANDIDATE = "struct<op:string,target:int,other:int,params:string,touched:array<int>,counted:boolean>"
FIELDS = ["no", "name", "kind", "source", "type", "id", "text", "remote", "dirty", "shape", "parent", "last"]
# Where random documents come from.
SOURCES = ["portal_a", "portal_b", "portal_c", "portal_d", "portal_e"]


class Domain(NamedTuple):
    """candidates(entities, used, last, left) and apply(entities, chosen, step) give columns; render(entities, call) a line of a program;
    start(seed) the first entities of trace_id."""

    start: Callable[[int], Column]
    candidates: Callable[[Column, Column, Column, Column], Column]
    apply: Callable[[Column, Column, Column], Column]
    render: Callable[[Column, Column], Column]


def nth(array: Column | str, i: int | Column) -> Column:
    """An element by its place from 1, from the end if negative; null where there is none."""
    return F.try_element_at(array, F.lit(i) if isinstance(i, int) else i)


def hashed(values: list, *parts: Column) -> Column:
    """One of values, by the parts only."""
    return nth(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(*parts), F.lit(len(values))) + 1).cast("int"))


def entity(**given: Column) -> Column:
    types = dict(x.split(":", 1) for x in ENTITY[7:-1].split(","))
    return F.struct(*[(given[k] if k in given else F.lit(None)).cast(types[k]).alias(k) for k in FIELDS])


def changed(e: Column, **new: Column) -> Column:
    return entity(**{k: new.get(k, e[k]) for k in FIELDS})


def candidate(op: str, target: Column, other: Column | None = None, params: Column | None = None, touched: Column | None = None, counted: bool = True) -> Column:
    other = F.lit(None).cast("int") if other is None else other
    text = F.concat_ws("#", F.lit(op), target.cast("string"), *([params] if params is not None else []), F.coalesce(other.cast("string"), F.lit("")))
    return F.struct(F.lit(op).alias("op"), target.cast("int").alias("target"), other.cast("int").alias("other"), text.alias("params"), (touched if touched is not None else F.array(target.cast("int"))).alias("touched"), F.lit(counted).alias("counted"))


def at(entities: Column, no: Column) -> Column:
    return nth(F.filter(entities, lambda e: e["no"] == no), 1)


def _where(entities: Column, test, make) -> Column:
    return F.transform(F.filter(entities, test), make)


# --- documents -------------------------------------------------------------------------------------------------------------------


def session_start(seed: int) -> Column:
    """Five documents: the first two only here, three on the server too, of which the first two share source and type."""
    def one(i: int) -> Column:
        key = 1 if i in (2, 3) else i + 10
        source, kind = hashed(SOURCES, F.col("trace_id"), F.lit(seed), F.lit(f"s{key}")), hashed(TYPES, F.col("trace_id"), F.lit(seed), F.lit(f"t{key}"))
        text = F.concat(F.lit('{"title":"title '), F.lit(i), F.lit('"}'))
        stored = i >= 2
        return entity(no=F.lit(i), name=F.lit(f"user_variable_{i}"), kind=F.lit("document"), source=source, type=kind, id=F.lit(i - 1 if stored else None), text=text, remote=text if stored else F.lit(None), dirty=F.lit(False))

    return F.array(*[one(i) for i in range(5)])


def session_candidates(entities: Column, used: Column, last: Column, left: Column) -> Column:
    live = lambda e: e["id"].isNotNull()
    stored = F.size(F.filter(entities, live))
    same = lambda e: F.transform(F.filter(entities, lambda o: live(o) & (o["source"] == e["source"]) & (o["type"] == e["type"])), lambda o: o["no"])
    key = lambda e: F.concat_ws("/", e["source"], e["type"])
    after = lambda e, *ops: F.coalesce(e["last"].isin(*ops), F.lit(False))
    parts = [
        _where(entities, lambda e: e["id"].isNull() & e["remote"].isNull() & e["text"].isNotNull(), lambda e: candidate("AddSession", e["no"], params=e["text"])),
        # what was just listed or written isn't read again
        _where(entities, lambda e: live(e) & ~after(e, "GetSessions", "UpdateSession"), lambda e: candidate("GetSession", e["no"])),
        # queries are made only where something comes out, once per key by its first document
        _where(entities, lambda e: live(e) & (nth(same(e), 1) == e["no"]), lambda e: candidate("GetSessions", e["no"], params=key(e), touched=same(e))),
        _where(entities, lambda e: live(e) & ~after(e, "GetSessions"), lambda e: candidate("GetSessionByQuery", e["no"], params=e["remote"])),
        _where(entities, lambda e: live(e) & e["dirty"], lambda e: candidate("UpdateSession", e["no"], params=e["text"])),
        # the last document goes only by the last call
        _where(entities, lambda e: live(e) & ((stored > 1) | (left <= 1)) & ~after(e, "AddSession"), lambda e: candidate("DeleteSession", e["no"])),
        _where(entities, lambda e: e["text"].isNotNull() & ~e["dirty"] & ~after(e, "LocalEdit"), lambda e: candidate("LocalEdit", e["no"], counted=False)),
    ]
    fresh = F.filter(F.concat(*parts), lambda c: ~F.array_contains(used, c["params"]))
    # changes that are to reach the server do so while calls are left
    dirty = F.size(F.filter(entities, lambda e: e["dirty"] & live(e)))
    flush = F.filter(fresh, lambda c: c["op"] == "UpdateSession")
    return F.when((dirty >= left) & (F.size(flush) > 0), flush).otherwise(fresh)


def session_apply(entities: Column, chosen: Column, step: Column) -> Column:
    op = chosen["op"]
    top = F.coalesce(F.array_max(F.transform(entities, lambda e: e["id"])), F.lit(1).cast("bigint"))

    def one(e: Column) -> Column:
        hit = e["no"] == chosen["target"]
        is_op = lambda name: hit & (op == name)
        text = F.when(is_op("LocalEdit"), F.concat(F.lit('{"title":"edit '), step.cast("string"), F.lit('"}'))).when(is_op("DeleteSession"), F.lit(None)).otherwise(e["text"])
        return changed(
            e,
            id=F.when(is_op("AddSession"), top + 1).when(is_op("DeleteSession"), F.lit(None)).otherwise(e["id"]),
            text=text,
            remote=F.when(is_op("AddSession") | is_op("UpdateSession"), e["text"]).when(is_op("DeleteSession"), F.lit(None)).otherwise(e["remote"]),
            dirty=F.when(is_op("LocalEdit"), e["id"].isNotNull()).when(is_op("UpdateSession") | is_op("DeleteSession") | is_op("AddSession"), False).otherwise(e["dirty"]),
            last=F.when(F.array_contains(chosen["touched"], e["no"]), op).otherwise(e["last"]),
        )

    return F.transform(entities, one)


def session_render(entities: Column, call: Column) -> Column:
    """A line of a program for a call, with BASE_URL for the server."""
    e = at(entities, call["target"])
    out = F.concat(F.lit("response_"), call["call_no"].cast("string"))
    url = F.concat(F.lit("f'{BASE_URL}/"), e["source"], F.lit("/"), e["type"])
    one = F.concat(url, F.lit("/{"), e["name"], F.lit("[\"id\"]}'"))
    return (
        F.when(call["op"] == "AddSession", F.concat(out, F.lit(" = requests.post("), url, F.lit("', json="), e["name"], F.lit(").json()")))
        .when(call["op"] == "GetSession", F.concat(out, F.lit(" = requests.get("), one, F.lit(").json()")))
        .when(call["op"] == "GetSessions", F.concat(out, F.lit(" = requests.get("), url, F.lit("').json()")))
        .when(call["op"] == "GetSessionByQuery", F.concat(out, F.lit(" = requests.get("), url, F.lit("/query', params={'field': 'data.title', 'value': "), e["name"], F.lit("['title']}).json()")))
        .when(call["op"] == "UpdateSession", F.concat(F.lit("requests.put("), one, F.lit(", json="), e["name"], F.lit(")")))
        .when(call["op"] == "DeleteSession", F.concat(F.lit("requests.delete("), one, F.lit(")")))
        .otherwise(F.concat(e["name"], F.lit("['title'] = 'edit "), call["call_no"].cast("string"), F.lit("'")))
    )


# --- tensors ---------------------------------------------------------------------------------------------------------------------


def tensor_start(seed: int) -> Column:
    """Two tensors of four dimensions, the last two even and equal."""
    size = lambda i, tag, top: (F.pmod(F.xxhash64("trace_id", F.lit(seed), F.lit(f"{tag}{i}")), F.lit(top)) + 1).cast("int")
    def one(i: int) -> Column:
        edge = size(i, "e", 3) * 2
        return entity(no=F.lit(i), name=F.lit(f"user_tensor_{i}"), kind=F.lit("tensor"), shape=F.array(size(i, "a", 3), size(i, "b", 3), edge, edge), dirty=F.lit(False))

    return F.array(one(0), one(1))


def tensor_candidates(entities: Column, used: Column, last: Column, left: Column) -> Column:
    last_dim = lambda e: nth(e["shape"], -1)
    even = lambda e: last_dim(e) % 2 == 0
    rest = lambda e: F.slice(e["shape"], 2, F.size(e["shape"]) - 1)
    data = lambda e: e["kind"] == "tensor"
    fits = lambda e: F.filter(entities, lambda o: data(o) & (o["no"] != e["no"]) & (F.size(o["shape"]) == F.size(e["shape"])) & (rest(o) == rest(e)))
    parts = [
        _where(entities, data, lambda e: candidate("permute", e["no"])),
        _where(entities, lambda e: data(e) & (F.size(e["shape"]) > 1), lambda e: candidate("transpose", e["no"])),
        _where(entities, lambda e: data(e) & even(e), lambda e: candidate("split", e["no"])),
        # with another tensor of the same shape beyond the first dimension, else with a new one like it
        _where(entities, data, lambda e: F.when(F.size(fits(e)) > 0, candidate("cat", e["no"], nth(fits(e), 1)["no"], touched=F.array(e["no"], nth(fits(e), 1)["no"]))).otherwise(candidate("cat", e["no"]))),
        _where(entities, data, lambda e: candidate("linear", e["no"])),
        _where(entities, lambda e: data(e) & (F.size(e["shape"]) == 4) & (nth(e["shape"], -1) > 1) & (nth(e["shape"], -2) > 1), lambda e: candidate("conv2d", e["no"])),
    ]
    return F.filter(F.concat(*parts), lambda c: ~F.array_contains(used, c["params"]))


def tensor_apply(entities: Column, chosen: Column, step: Column) -> Column:
    op, e, o = chosen["op"], at(entities, chosen["target"]), at(entities, chosen["other"])
    s = e["shape"]
    n = F.size(s)
    half = F.transform(s, lambda x, i: F.when(i == n - 1, (x / 2).cast("int")).otherwise(x))
    shape = (
        F.when(op == "permute", F.reverse(s))
        .when(op == "transpose", F.concat(F.slice(s, 1, n - 2), F.array(nth(s, -1), nth(s, -2))))
        .when(op == "split", half)
        .when(op == "cat", F.transform(s, lambda x, i: F.when(i == 0, x + F.coalesce(nth(o["shape"], 1), x)).otherwise(x)))
        .when(op == "linear", F.transform(s, lambda x, i: F.when(i == n - 1, 4).otherwise(x)))
        # a kernel of 2 x 2 with 3 channels out
        .otherwise(F.transform(s, lambda x, i: F.when(i == 1, 3).when(i >= 2, x - 1).otherwise(x)))
    )
    touched = F.transform(entities, lambda x: changed(x, last=F.when(F.array_contains(chosen["touched"], x["no"]), op).otherwise(x["last"])))
    made = lambda i: entity(no=F.size(entities) + i, name=F.concat(F.lit("response_"), step.cast("string"), F.when(op == "split", F.lit(f"[{i}]")).otherwise("")), kind=F.lit("tensor"), shape=shape, parent=e["no"], dirty=F.lit(False), last=op)
    return F.concat(touched, F.when(op == "split", F.array(made(0), made(1))).otherwise(F.array(made(0))))


def tensor_render(entities: Column, call: Column) -> Column:
    e, o = at(entities, call["target"]), at(entities, call["other"])
    out = F.concat(F.lit("response_"), call["call_no"].cast("string"), F.lit(" = torch."))
    name, n = e["name"], F.size(e["shape"])
    dims = F.concat(F.lit("("), F.array_join(F.transform(F.reverse(F.sequence(F.lit(0), n - 1)), lambda i: i.cast("string")), ", "), F.lit(")"))
    no, width = call["call_no"].cast("string"), nth(e["shape"], -1).cast("string")
    like, weight, kernel = (F.concat(F.lit(f"user_{k}_"), no) for k in ("tensor_like", "weight", "kernel"))
    # inputs that a call needs besides the tensor come right before it
    setup = (
        F.when((call["op"] == "cat") & o.isNull(), F.concat(like, F.lit(" = torch.randn_like("), name, F.lit(")\n")))
        .when(call["op"] == "linear", F.concat(weight, F.lit(" = torch.randn((4, "), width, F.lit("))\n")))
        .when(call["op"] == "conv2d", F.concat(kernel, F.lit(" = torch.randn((3, "), nth(e["shape"], 2).cast("string"), F.lit(", 2, 2))\n")))
        .otherwise("")
    )
    return F.concat(
        setup,
        out,
        F.when(call["op"] == "permute", F.concat(F.lit("permute("), name, F.lit(", "), dims, F.lit(")")))
        .when(call["op"] == "transpose", F.concat(F.lit("transpose("), name, F.lit(", -2, -1)")))
        .when(call["op"] == "split", F.concat(F.lit("split("), name, F.lit(", "), (nth(e["shape"], -1) / 2).cast("int").cast("string"), F.lit(", -1)")))
        .when(call["op"] == "cat", F.concat(F.lit("cat(("), name, F.lit(", "), F.coalesce(o["name"], like), F.lit("), 0)")))
        .when(call["op"] == "linear", F.concat(F.lit("nn.functional.linear("), name, F.lit(", "), weight, F.lit(")")))
        .otherwise(F.concat(F.lit("nn.functional.conv2d("), name, F.lit(", "), kernel, F.lit(")"))),
    )


# --- speech ----------------------------------------------------------------------------------------------------------------------


def voice_start(seed: int) -> Column:
    """A text, a search term of one of four forms, and a voice."""
    voice = hashed([v[0] for v in VOICES], F.col("trace_id"), F.lit(seed), F.lit("v"))
    term = hashed(["female", "male", "narration", "conversational"], F.col("trace_id"), F.lit(seed), F.lit("q"))
    text = F.concat(F.lit("Paragraph "), F.col("trace_id").cast("string"), F.lit(". It has two sentences."))
    return F.array(
        entity(no=F.lit(0), name=F.lit("user_text_0"), kind=F.lit("text"), text=text, dirty=F.lit(False)),
        entity(no=F.lit(1), name=F.lit("user_term_0"), kind=F.lit("term"), text=term, dirty=F.lit(True)),
        entity(no=F.lit(2), name=F.lit("user_voice_0"), kind=F.lit("voice"), text=voice, dirty=F.lit(False)),
    )


def voice_candidates(entities: Column, used: Column, last: Column, left: Column) -> Column:
    of = lambda kind: F.filter(entities, lambda e: e["kind"] == kind)
    # of several voices the newest is used
    voice = nth(of("voice"), -1)["no"]
    has_voice = F.size(of("voice")) > 0
    isolated = lambda e: e["type"] == "isolated"
    parts = [
        F.transform(F.filter(of("term"), lambda e: e["dirty"]), lambda e: candidate("search_voice_library", e["no"])),
        F.transform(F.filter(of("text"), lambda e: has_voice), lambda e: candidate("text_to_speech", e["no"], voice, touched=F.array(e["no"], voice))),
        F.transform(F.filter(of("speech"), lambda e: has_voice), lambda e: candidate("speech_to_speech", e["no"], voice, touched=F.array(e["no"], voice))),
        F.transform(of("speech"), lambda e: candidate("speech_to_text", e["no"])),
        # audio is isolated again only after a speech was made from it anew
        F.transform(F.filter(of("speech"), lambda e: ~F.coalesce(isolated(e), F.lit(False))), lambda e: candidate("isolate_audio", e["no"])),
        F.transform(of("speech"), lambda e: candidate("make_outbound_call", e["no"])),
    ]
    return F.filter(F.concat(*parts), lambda c: ~F.array_contains(used, c["params"]))


def voice_apply(entities: Column, chosen: Column, step: Column) -> Column:
    op, e, o = chosen["op"], at(entities, chosen["target"]), at(entities, chosen["other"])
    kind = F.when(op == "search_voice_library", "voice").when(op == "speech_to_text", "text").when(op != "make_outbound_call", "speech")
    touched = F.transform(entities, lambda x: changed(x, last=F.when(F.array_contains(chosen["touched"], x["no"]), op).otherwise(x["last"]), dirty=F.when((op == "search_voice_library") & (x["no"] == chosen["target"]), False).otherwise(x["dirty"])))
    found = hashed([v[0] for v in VOICES], e["text"])
    made = entity(
        no=F.size(entities), name=F.concat(F.lit("response_"), step.cast("string")), kind=kind, type=F.when(op == "isolate_audio", "isolated"), source=F.when(op.isin("text_to_speech", "speech_to_speech"), o["text"]).otherwise(e["source"]),
        text=F.when(op == "search_voice_library", found).otherwise(e["text"]), parent=e["no"], dirty=F.lit(False), last=op,
    )
    return F.concat(touched, F.when(kind.isNotNull(), F.array(made)).otherwise(F.array().cast(f"array<{ENTITY}>")))


def voice_render(entities: Column, call: Column) -> Column:
    e, o = at(entities, call["target"]), at(entities, call["other"])
    args = F.concat_ws(", ", e["name"], o["name"])
    body = F.concat(F.lit("voice."), call["op"], F.lit("("), args, F.lit(")"))
    return F.when(call["op"] == "make_outbound_call", body).otherwise(F.concat(F.lit("response_"), call["call_no"].cast("string"), F.lit(" = "), body))


DOMAINS = {
    "session": Domain(session_start, session_candidates, session_apply, session_render),
    "tensor": Domain(tensor_start, tensor_candidates, tensor_apply, tensor_render),
    "voice": Domain(voice_start, voice_candidates, voice_apply, voice_render),
}
CALL = "struct<call_no:int,op:string,target:int,other:int,params:string,srcs:array<string>,counted:boolean,line:string>"


def start(spark: SparkSession, n: int, domain: str, steps: int, seed: int = 0) -> DataFrame:
    """n traces before their first call; first: the entities they begin with."""
    first = DOMAINS[domain].start(seed)
    base = spark.range(n).select(F.col("id").alias("trace_id")).withColumn("entities", first.cast(f"array<{ENTITY}>"))
    return base.select("trace_id", F.col("entities").alias("first"), "entities", F.array().cast("array<string>").alias("used"), F.lit(B.FIRST).alias("last"), F.lit(steps).alias("left"), F.array().cast(f"array<{CALL}>").alias("calls"))


def step(state: DataFrame, known: dict[tuple[str, str], int], domain: str, no: int, seed: int = 0) -> DataFrame:
    """The traces after one more call, where one is allowed. A candidate's weight is the square of its uncovered pairs, else
    1 / (its least count + 1e-7)."""
    d = DOMAINS[domain]
    book = F.map_from_arrays(F.array(*[F.lit("||".join(p)) for p in known]).cast("array<string>"), F.array(*[F.lit(n) for n in known.values()]).cast("array<bigint>"))
    found = state.withColumn("_c", d.candidates(F.col("entities"), F.col("used"), F.col("last"), F.col("left")).cast(f"array<{CANDIDATE}>"))
    srcs = lambda c: F.transform(c["touched"], lambda t: F.coalesce(at(F.col("entities"), t)["last"], F.lit(B.FIRST)))

    def weighed(c: Column) -> Column:
        counts = F.transform(F.array_distinct(srcs(c)), lambda s: F.coalesce(F.try_element_at(book, F.concat(s, F.lit("||"), c["op"])), F.lit(0).cast("bigint")))
        uncovered = F.size(F.filter(counts, lambda n: n == 0))
        w = F.when(uncovered > 0, uncovered * uncovered * 1.0).otherwise(1 / (F.array_min(counts) + 1e-7))
        # the least exponential variate with rate w: a choice in proportion to w
        return F.struct((F.log(B.unit_hash(F.col("trace_id"), F.lit(no), F.lit(seed), c["params"])) / w).alias("k"), c.alias("c"))

    picked = found.withColumn("_p", F.when((F.col("left") > 0) & (F.size("_c") > 0), F.array_max(F.transform("_c", weighed))["c"])).drop("_c")
    p, had = F.col("_p"), F.col("_p").isNotNull()
    called = F.struct(F.lit(no).alias("call_no"), p["op"].alias("op"), p["target"].alias("target"), p["other"].alias("other"), p["params"].alias("params"), srcs(p).alias("srcs"), p["counted"].alias("counted"))
    lined = F.struct(*[called[k].alias(k) for k in ("call_no", "op", "target", "other", "params", "srcs", "counted")], d.render(F.col("entities"), called).alias("line"))
    # a column of its own: the entities before the change are meant
    picked = picked.withColumn("_l", F.when(had, lined.cast(CALL)))
    return picked.select(
        "trace_id", "first",
        F.when(had, d.apply(F.col("entities"), p, F.lit(no)).cast(f"array<{ENTITY}>")).otherwise(F.col("entities")).alias("entities"),
        F.when(had, F.array_append("used", p["params"])).otherwise(F.col("used")).alias("used"),
        F.when(had & p["counted"], p["op"]).otherwise(F.col("last")).alias("last"),
        (F.col("left") - F.when(had & p["counted"], 1).otherwise(0)).alias("left"),
        F.when(had, F.array_append("calls", F.col("_l"))).otherwise(F.col("calls")).alias("calls"),
    )


def run(spark: SparkSession, n: int, domain: str = "session", calls: int = 5, seed: int = 0, known: dict[tuple[str, str], int] | None = None, state: DataFrame | None = None) -> tuple[DataFrame, dict[tuple[str, str], int]]:
    """(traces, book): n traces of `calls` counted calls each, where their state allows as many; local changes aren't counted, but twice
    as many steps as calls are the most. The book is {(src, dst): occurrences}, at most the square of the operations; a state
    given goes on from there."""
    known = dict(known or {})
    state = state if state is not None else start(spark, n, domain, calls, seed)
    for no in range(2 * calls):
        state = runtime.cut(step(state, known, domain, no, seed))
        made = state.select(nth("calls", -1).alias("c")).where(F.col("c.call_no") == no).select(F.explode(F.array_distinct("c.srcs")).alias("src"), F.col("c.op").alias("dst"))
        new = made.groupBy("src", "dst").agg(F.count("*").alias("occ")).collect()  # a row per pair of operation names
        if not new:
            break
        for r in new:
            known[r["src"], r["dst"]] = known.get((r["src"], r["dst"]), 0) + r["occ"]
        if no + 1 >= calls and state.where("left > 0").isEmpty():
            break
    return state, known


def steps_of(traces: DataFrame) -> DataFrame:
    """(trace_id, place, call_no, op, target, other, params, srcs, counted, line): a row per call."""
    return traces.select("trace_id", F.posexplode("calls").alias("place", "c")).select("trace_id", "place", "c.*")


def forked(traces: DataFrame, at_call: int) -> DataFrame:
    """Two rows per trace, branch `if` and `else`: the first goes on as it did, the second has the calls and what was used before at_call,
    from the entities that it began with, and as many calls left."""
    branch = F.explode(F.array(F.lit("if"), F.lit("else"))).alias("branch")
    both = traces.select("*", branch)
    kept = F.filter("calls", lambda c: c["call_no"] < at_call)
    cut_ = F.col("branch") == "else"
    return both.withColumns({"calls": F.when(cut_, kept).otherwise(F.col("calls")), "used": F.when(cut_, F.transform(kept, lambda c: c["params"])).otherwise(F.col("used")), "left": F.when(cut_, F.col("left") + F.size(F.filter("calls", lambda c: c["counted"] & (c["call_no"] >= at_call)))).otherwise(F.col("left"))})


def literal(e: Column) -> Column:
    """The text that sets an entity up."""
    return F.when(e["kind"] == "tensor", F.concat(F.lit("torch.randn(("), F.array_join(F.transform(e["shape"], lambda x: x.cast("string")), ", "), F.lit("))"))).when(e["kind"] == "document", e["text"]).otherwise(F.concat(F.lit("'"), e["text"], F.lit("'")))


def indented(lines: Column, levels: int) -> Column:
    pad = "    " * levels
    return F.transform(lines, lambda x: F.concat(F.lit(pad), F.replace(x, F.lit("\n"), F.lit("\n" + pad))))


def programs(traces: DataFrame, condition: Column | None = None, at_call: int | None = None) -> DataFrame:
    """(trace_id, init, program): lines that set the first entities up, and those of the calls, parts joined by a blank line. With a
    condition and at_call, the calls from there on stand below an `if`; rows of both branches of forked() make one program."""
    lines = F.transform("calls", lambda c: c["line"])
    init = F.array_join(F.transform("first", lambda e: F.concat(e["name"], F.lit(" = "), literal(e))), "\n")
    if condition is None:
        return traces.select("trace_id", init.alias("init"), F.array_join(lines, "\n").alias("program"))
    before = F.transform(F.filter("calls", lambda c: c["call_no"] < at_call), lambda c: c["line"])
    after = F.transform(F.filter("calls", lambda c: c["call_no"] >= at_call), lambda c: c["line"])
    one = traces.groupBy("trace_id").agg(
        F.max(F.when(F.col("branch") == "if", F.struct(init.alias("init"), F.array_join(before, "\n").alias("before"), F.array_join(indented(after, 1), "\n").alias("body"), condition.alias("test")))).alias("a"),
        F.max(F.when(F.col("branch") == "else", F.array_join(indented(after, 1), "\n"))).alias("b"),
    )
    body = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "    pass").otherwise(c)
    text = F.concat_ws("\n\n", F.nullif("a.before", F.lit("")), F.concat(F.lit("if "), F.col("a.test"), F.lit(":\n"), body(F.col("a.body")), F.lit("\nelse:\n"), body(F.col("b"))))
    return one.select("trace_id", F.col("a.init").alias("init"), text.alias("program"))


def final_documents(traces: DataFrame) -> DataFrame:
    """(trace_id, source, type, id, data): what the server has after the calls."""
    return traces.select("trace_id", F.explode("entities").alias("e")).where("e.kind = 'document' and e.id is not null").select("trace_id", "e.source", "e.type", "e.id", F.col("e.remote").alias("data"))
