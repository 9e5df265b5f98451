"""Problem 5: answers that were cut.

Three kinds of evidence meet. Some endings settle the matter: an open code fence or bracket, a body that is no whole JSON, a
closed fence, a full stop. For the others, counts over all answers tell how often what stands at the end ends a sentence
or statement elsewhere. And for each source a lognormal length distribution is fitted by maximum likelihood, known cut
answers counting as censored on the right; it gives the probability that a value at a candidate limit (a length that the
source shows far too often, or the request's max_tokens) was censored there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode import runtime
from tracelode.llm import answers
from tracelode.llm.hashing import mix

#: A word counts as known from RARE answers on, however many answers there are.
RARE = 5
#: Occurrences from which the counts for an ending are believed.
BELIEVED, SHRUNK = 3, 2.0
NUMBER, LOWER, UPPER, START = (np.int64(x) for x in (8, 16, 17, 24))
CLOSED = re.compile(r"[.!?。！？][\"'”»)\]]*$")
NUMBER_STOP = re.compile(r"(?<![\w.\-])\d{1,3}\.$")
GOES_ON = re.compile(r"([:,\\=+\-*/%(\[{.]|\b(and|or|not|in|is|if|else|return|import|from|lambda|assert)|(?<!\d)\.)$")
PARSED = (
    "message_id bigint, request_id bigint, source string, kind string, verdict string, n_chars int, finish string, tokens int, max_tokens int, marked boolean, items array<bigint>, ends array<int>, text string, is_last boolean"
)


def segments(parts: list[tuple[bool, str]]) -> list[tuple[bool, str]]:
    """Sentences of prose and lines of code, each with whether it is code."""
    out = []
    for fenced, part in parts:
        for line in part.split("\n"):
            line = line.strip()
            if not line:
                continue
            if fenced or (answers.CODE_LINE.match(line) and not line.startswith("#")):
                out.append((True, line))
            else:
                out.extend((False, s) for s in answers.sentences(line.lstrip("#> ") if line[0] in "#>" else line))
    return out


class Items(dict):
    """Hashes of words whose lowest bit tells a capital; one code for all numbers."""

    def __missing__(self, token: str) -> int:
        self[token] = h = int(NUMBER) if token[0].isdigit() else (xxhash.xxh3_64_intdigest(token) & 0x7FFFFFFFFFFFFFE0) | 32 | token[0].isupper()
        return h


def unclosed(code: str) -> bool:
    bare = answers.STRING.sub(" ", code.partition("  #")[0])
    return any(bare.count(a) > bare.count(b) for a, b in ("()", "[]", "{}")) or '"' in bare or "'" in bare


def verdict(text: str, parts: list[tuple[bool, str]], is_open: bool, last: tuple[bool, str]) -> tuple[str, bool]:
    """cut, complete, or unclear with whether a mark stands where the text breaks off."""
    if is_open:
        return "cut", False
    seen = answers.visible(text)
    core = seen.rstrip("�")
    mark = answers.break_mark(core)
    core = core.removesuffix(mark).rstrip()
    marked = bool(mark) or seen.endswith("�")
    if core.endswith("```"):
        return "complete", marked
    code, segment = last
    if code and not parts[-1][0] and "\n".join(p for f, p in parts if not f).count('"""') % 2:
        return "cut", marked
    if code:
        segment = segment.rstrip("�").removesuffix(mark).rstrip()
        return ("cut" if unclosed(segment) or GOES_ON.search(segment) else "unclear"), marked
    if CLOSED.search(core) and not NUMBER_STOP.search(core):
        return "complete", marked
    return "unclear", marked


def _parse():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Items()
        for b in batches:
            if len(hashes) > 300_000:
                hashes.clear()
            rows = []
            for mid, rid, source, body, limit, is_last in zip(b["message_id"], b["request_id"], b["source"], b["body"], b["max_tokens"], b["is_last"]):
                a = answers.answer(body)
                row = [mid, rid, source, a.kind, "none", 0, a.finish, a.tokens, None if pd.isna(limit) else int(limit), False, [], [], a.text if is_last else None, is_last]
                rows.append(row)
                if a.kind == "unreadable":
                    row[4] = "cut" if body.lstrip()[:1] in ("{", "[") else "none"
                    row[5] = len(body)
                    continue
                parts, is_open = answers.blocks(a.text) if a.text and answers.visible(a.text) else ([], False)
                found = segments(parts)
                if not found:
                    continue
                row[5] = len(a.text)
                row[4], row[9] = verdict(a.text, parts, is_open, found[-1])
                items, ends = [], []
                for code, s in found:
                    s = answers.STRING.sub(" Sss ", s) if code else s.rstrip("�").removesuffix(answers.break_mark(s.rstrip("�"))).rstrip("….!?。！？\"')] ")
                    items.extend(map(hashes.__getitem__, answers.TOKEN.findall(s)))
                    if items and (not ends or ends[-1] != len(items)):
                        ends.append(len(items))
                row[10], row[11] = items, ends
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in PARSED.split(", ")])
            yield out.astype({"tokens": "Int32", "max_tokens": "Int32"})

    return run


def parsed(raw_messages: DataFrame, chat_requests: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """One row per delivery, taken apart; see PARSED. Deliveries without a request have no max_tokens. Of the deliveries in
    last (request_id, message_id), one for each request, is_last is true and the text is kept."""
    limits = chat_requests.where("request_id is not null").groupBy("request_id").agg(F.max("max_tokens").alias("max_tokens"))
    kept = last.withColumnRenamed("message_id", "_last") if last is not None else limits.select("request_id", F.lit(None).cast("bigint").alias("_last"))
    both = runtime.join_salted(raw_messages.select("message_id", "request_id", "source", "body"), limits.join(kept, "request_id", "full"), ["request_id"])
    is_last = F.coalesce(F.col("message_id") == F.col("_last"), F.lit(False)).alias("is_last")
    return runtime.cut(both.select("message_id", "request_id", "source", "body", "max_tokens", is_last).mapInPandas(_parse(), PARSED))


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        lists = [np.unique(np.asarray(x, np.int64)) for x in b["items"]]
        if lists:
            at, n = np.unique(np.concatenate(lists), return_counts=True)
            yield pd.DataFrame({"item": at, "df": n})


def _seldom(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of each delivery that aren't known to be common from the batch alone."""
    for b in batches:
        lists = [np.unique(np.asarray(x, np.int64)) for x in b["items"]]
        if lists:
            items = np.concatenate(lists)
            _, where, n = np.unique(items, return_inverse=True, return_counts=True)
            few = n[where] < RARE
            yield pd.DataFrame({"message_id": np.repeat(b["message_id"].to_numpy(), [len(x) for x in lists])[few], "item": items[few]})


def with_rare(rows: DataFrame) -> DataFrame:
    """The rows with items and, as rare, those of their words that fewer than RARE deliveries have; no word list is sent around."""
    some = rows.where(F.size("items") > 0)
    counted = some.select("items").mapInPandas(_words, "item bigint, df bigint").groupBy("item").agg(F.sum("df").alias("df"))
    pairs = some.where("message_id is not null").select("message_id", "items").mapInPandas(_seldom, "message_id bigint, item bigint")
    rare = pairs.join(counted.where(F.col("df") < RARE).select("item"), "item", "left_semi").groupBy("message_id").agg(F.collect_set("item").alias("rare"))
    return some.select("message_id", "items", "ends", "verdict").join(rare, "message_id", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<bigint>")))


def _known(items: np.ndarray, rare: np.ndarray) -> np.ndarray:
    return np.where(np.isin(items, rare) & (items != NUMBER), np.where(items & 1, UPPER, LOWER), items)


def _key(*parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = np.full(len(parts[0]), len(parts), np.uint64)
        for p in parts:
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.int64).view(np.uint64))
    return acc.view(np.int64)


def _spread(items, ends, rare):
    """Known items with two START items before each segment: three shifted views and flags of segment ends."""
    x = _known(np.asarray(items, np.int64), np.asarray(rare, np.int64))
    n, stops = len(x), np.asarray(ends, np.int64)
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[stops] = True
    before1 = np.where(first[:n], START, np.concatenate([[START], x[:-1]]))
    second = np.zeros(n, bool)
    second[1:] = first[: n - 1]
    before2 = np.where(first[:n] | second, START, np.concatenate([[START, START], x[:-2]])[:n])
    end = np.zeros(n, bool)
    end[stops - 1] = True
    return x, before1, before2, end


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys, stops = [], []
        for items, ends, rare in zip(b["items"], b["ends"], b["rare"]):
            x, p1, p2, end = _spread(items, ends, rare)
            x, p1, p2, end = x[:-1], p1[:-1], p2[:-1], end[:-1]  # what the last item of an answer ends is the question
            keys += [_key(p2, p1, x), _key(p1, x), _key(x)]
            stops += [end, end, end]
        if keys:
            at, where = np.unique(np.concatenate(keys), return_inverse=True)
            n, e = np.bincount(where), np.bincount(where, np.concatenate(stops))
            yield pd.DataFrame({"key": at, "n": n, "e": e.astype(np.int64)})


def _last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for mid, items, ends, rare in zip(b["message_id"], b["items"], b["ends"], b["rare"]):
            x, p1, p2, _ = (v[-1:] for v in _spread(items, ends, rare))
            named = bool(x[0] in (NUMBER, LOWER, UPPER))
            out += [(mid, name, int(_key(*k)[0]), named) for name, k in (("three", (p2, p1, x)), ("two", (p1, x)), ("one", (x,)), ("context", (p2, p1)))]
        yield pd.DataFrame(out, columns=["message_id", "level", "key", "named"])


def endings(rows: DataFrame) -> DataFrame:
    """(message_id, named, p_end) of the unclear rows: how often the last items end a segment elsewhere, and whether the
    last one is a number or a rare word, of which a part would pass for a whole. Null p_end: a fragment, as nothing like it
    follows these words elsewhere."""
    with_items = runtime.cut(with_rare(rows))
    counts = with_items.select("items", "ends", "rare").mapInPandas(_counts, "key bigint, n bigint, e bigint").groupBy("key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    asked = with_items.where("verdict = 'unclear'").select("message_id", "items", "ends", "rare").mapInPandas(_last, "message_id bigint, level string, key bigint, named boolean")
    met = runtime.join_salted(asked, counts, ["key"])  # a key may be that of a third of the messages
    got = {f"{x}_{level}": F.max(F.when(F.col("level") == level, F.col(x))) for level in ("three", "two", "one", "context") for x in ("n", "e")}
    one = met.groupBy("message_id").agg(F.max("named").alias("named"), *[F.coalesce(c, F.lit(0)).alias(k) for k, c in got.items()])
    # each level is drawn towards the next shorter one, by the weight of SHRUNK occurrences
    p_one = (F.col("e_one") + 0.02) / (F.col("n_one") + 0.5)
    p_two = (F.col("e_two") + SHRUNK * p_one) / (F.col("n_two") + SHRUNK)
    p_three = (F.col("e_three") + SHRUNK * p_two) / (F.col("n_three") + SHRUNK)
    fragment = F.col("named") & (F.col("n_three") == 0) & (F.col("n_context") >= BELIEVED)
    p_end = F.when(~fragment, p_three)
    return one.select("message_id", "named", p_end.alias("p_end"))


def fit_lognormal(values: np.ndarray, weights: np.ndarray, censored: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Maximum-likelihood mean and deviation of log lengths; censored values are lower bounds. Expectation-maximisation
    with the moments of the truncated normal distribution."""
    y = np.log(np.maximum(values, 1.0))
    w, c = weights.astype(float), censored.astype(bool)
    mu, sd = float(np.average(y, weights=w)), float(np.sqrt(np.average((y - np.average(y, weights=w)) ** 2, weights=w)) + 0.05)
    for _ in range(rounds):
        z = (y - mu) / sd
        tail = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z])
        hazard = np.where(tail > 1e-12, np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / np.maximum(tail, 1e-12), z + 1e-3)
        m1 = np.where(c, mu + sd * hazard, y)
        m2 = np.where(c, mu * mu + sd * sd + sd * (y + mu) * hazard, y * y)
        mu = float(np.average(m1, weights=w))
        sd = math.sqrt(max(float(np.average(m2, weights=w)) - mu * mu, 0.0025))
    return mu, sd


def _fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    mu, sd = fit_lognormal(np.exp((group["bin"].to_numpy() + 0.5) / 50), group["c"].to_numpy(), group["censored"].to_numpy())
    return pd.DataFrame({"src": [key[0]], "unit": [key[1]], "mu": [mu], "sd": [sd], "total": [int(group["c"].sum())]})


def limits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fits per source and unit, and the candidate limits in characters with the posterior of being cut there."""
    src = F.coalesce("source", F.lit(""))
    chars = rows.where("verdict <> 'none' and kind = 'text'").select(src.alias("src"), F.lit("chars").alias("unit"), F.col("n_chars").alias("v"), (F.col("verdict") == "cut").alias("censored"))
    tokens = rows.where("verdict <> 'none' and tokens > 0").select(src.alias("src"), F.lit("tokens").alias("unit"), F.col("tokens").alias("v"), ((F.col("verdict") == "cut") | (F.col("tokens") >= F.col("max_tokens"))).alias("censored"))
    # in bins of 2 % a source has a bounded number of rows
    bins = chars.unionByName(tokens).groupBy("src", "unit", F.floor(F.log("v") * 50).cast("int").alias("bin"), F.coalesce("censored", F.lit(False)).alias("censored")).agg(F.count("*").alias("c"))
    fits = bins.groupBy("src", "unit").applyInPandas(_fit, "src string, unit string, mu double, sd double, total bigint")
    expected = F.col("total") * _density(F.col("n_chars"))
    points = rows.where("kind = 'text' and verdict <> 'none'").groupBy(src.alias("src"), "n_chars").agg(F.count("*").alias("c"), F.count_if(F.col("verdict") == "complete").alias("whole"))
    found = points.where("c >= 5 and whole < 0.2 * c").join(fits.where("unit = 'chars'"), "src").where(F.col("c") > 10 * expected)
    return fits, found.select("src", "n_chars", (1 - expected / F.col("c")).alias("at_length"))


def _density(x: Column) -> Column:
    z = (F.log(x) - F.col("mu")) / F.col("sd")
    return F.exp(-z * z / 2) / (x * F.col("sd") * math.sqrt(2 * math.pi))


def _survival(x: Column) -> Column:
    """Upper tail of the lognormal: the normal tail by the five-term rational approximation of Abramowitz and Stegun 26.2.17,
    whose error is below 1e-7, with Mills' ratio beyond 4 deviations, where only the ratio of tail and density counts."""
    z = (F.log(x) - F.col("mu")) / F.col("sd")
    t = 1 / (1 + 0.2316419 * F.abs(z))
    bell = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    near = bell * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.when(F.abs(z) > 4, bell * F.abs(z) / (z * z + 1)).otherwise(near)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def judged(rows: DataFrame) -> DataFrame:
    """(message_id, request_id, source, is_last, is_cut) for every delivery in rows."""
    fits, points = limits(rows)
    rows = rows.withColumns({"src": F.coalesce("source", F.lit("")), "fin": F.coalesce("finish", F.lit("")), "at_limit": F.coalesce(F.col("tokens") >= F.col("max_tokens"), F.lit(False))})
    settled = rows.where("verdict in ('cut', 'complete')")
    cut_share = (F.count_if(F.col("verdict") == "cut") + 0.2) / (F.count("*") + 4)
    rates = settled.where("not at_limit").groupBy("src", "fin").agg(cut_share.alias("rate"))
    # how far a filled limit tells, by how common the limit is: a value of its own was hardly set by anyone
    common = rows.where("max_tokens is not null").groupBy("max_tokens").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("common"))
    filled = settled.where("at_limit").join(common, "max_tokens").groupBy("common").agg(cut_share.alias("filled"))
    unclear = rows.drop("items", "ends", "text").join(endings(rows), "message_id", "left").join(common, "max_tokens", "left")
    all_in = (
        unclear.join(rates, ["src", "fin"], "left")
        .join(filled, "common", "left")
        .join(points, ["src", "n_chars"], "left")
        .join(fits.where("unit = 'tokens'").select("src", "mu", "sd"), "src", "left")
    )
    past = _survival(F.col("tokens"))
    at_tokens = F.coalesce(past / (past + _density(F.col("tokens"))), F.lit(0.9)) * F.coalesce("filled", F.lit(0.05))
    prior = F.least(F.lit(0.995), F.greatest(F.lit(0.02), F.when(F.col("at_limit"), at_tokens).otherwise(F.coalesce("rate", F.lit(0.05))), F.coalesce("at_length", F.lit(0.0))))
    ratio = (
        F.when(F.col("p_end").isNull(), 60.0)
        .when(F.col("p_end") < 0.1, (1 - F.col("p_end")) / F.col("p_end"))
        .when(F.col("named"), 0.3)
        .otherwise(0.002)
    ) * F.when(F.col("marked"), 20.0).otherwise(1.0)
    cut = F.when(F.col("verdict") == "unclear", prior / (1 - prior) * ratio > 0.4).otherwise(F.col("verdict") == "cut")
    return all_in.select("message_id", "request_id", "source", "is_last", cut.alias("is_cut"))


def cut_answers(raw_messages: DataFrame, chat_requests: DataFrame) -> DataFrame:
    """(message_id): the deliveries whose body or answer was cut, each once.

    Null bodies, error bodies and answers without visible text are no cases; null sources count as one source; a
    delivery without a request has no token limit. Empty tables give an empty result; further columns are not read.
    """
    return judged(parsed(raw_messages, chat_requests)).where("is_cut").select("message_id").distinct()


def cut_rates(raw_messages: DataFrame, chat_requests: DataFrame) -> DataFrame:
    """(source, deliveries, cut, cut_share) per source; null is a source of its own."""
    one = judged(parsed(raw_messages, chat_requests))
    return one.groupBy("source").agg(F.count("*").alias("deliveries"), F.count_if("is_cut").alias("cut"), F.avg(F.col("is_cut").cast("double")).alias("cut_share"))
