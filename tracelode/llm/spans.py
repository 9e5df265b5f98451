"""Problem 3: long stretches of text that stand verbatim in another record.

Paragraphs overlap: every run of WIDTH characters is one, so that no stretch falls between two of them. The MinHash row of a
paragraph is the least hash of its substrings of GRAM characters. Equal paragraphs have equal rows, so one band of one row has
a recall of 1 for verbatim copies; more rows would only lose candidates. Neighbouring paragraphs mostly have the same
row at the same place, an anchor, so a hundredth of all places is left.

Bands that two records share are joined by aggregation, never as pairs. What surrounds an anchor, its context, is compared
exactly: equal contexts are shared whole; different contexts of one band are compared paragraph by paragraph (edit distance
0) inside a task, or, in a band with more than TILE contexts, by another aggregation. The union of the verified paragraphs is what is
shared; records linked by them make the components in which copies are to be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode import runtime
from tracelode.llm.hashing import mix
from tracelode.llm.linking import components, whole_groups

#: Shortest stretch that counts, and length of the substrings whose least hash represents a paragraph.
WIDTH, GRAM = 240, 48
#: Characters and contexts that are hashed at once, and contexts of a band from which paragraphs are spread over tasks.
CHUNK, TILE = 1 << 20, 2048
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def characters(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(codes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """64-bit polynomial hashes of all runs of width characters, put together from those of powers of two."""
    if len(codes) < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, size, factor = mix(codes.astype(np.uint64) + base), 1, base
        out, length = None, 0
        while True:
            if width & size:
                if out is None:
                    out, length = power, size
                else:
                    n = len(codes) - length - size + 1
                    out, length = out[:n] * factor + power[length : length + n], length + size
            if size * 2 > width:
                return mix(out)
            n = len(codes) - 2 * size + 1
            power, size, factor = power[:n] * factor + power[size : size + n], 2 * size, factor * factor


def least_of_each(values: np.ndarray, width: int, valid: np.ndarray | None = None) -> np.ndarray:
    """Positions of the least value of every (valid) window of width values, each once. The windows' minima come from
    block-wise running minima from both ends; where values tie, all places of the window's minimum are taken."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    pad = -len(values) % width
    blocks = np.concatenate([values, np.full(pad, top)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    if valid is not None:
        least[~valid[:n]] = 0
    # a value is chosen if it equals the minimum of one of the windows that hold it: the largest of these minima
    low = np.zeros(n + 2 * (width - 1), np.uint64)
    low[width - 1 : width - 1 + n] = least
    pad = -len(low) % width
    blocks = np.concatenate([low, np.zeros(pad, np.uint64)]).reshape(-1, width)
    ahead = np.maximum.accumulate(blocks, axis=1).ravel()
    back = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    most = np.maximum(back[: len(values)], ahead[width - 1 : width - 1 + len(values)])
    return np.flatnonzero(values == most)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about CHUNK characters; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def inside(lengths: np.ndarray, width: int) -> np.ndarray:
    """Which places of joined texts begin a run of width characters that ends in the same text."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1])) + width <= np.repeat(ends, lengths)


def _anchors(width: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            owner, doc, texts = b["owner"].to_numpy(), b["doc"].to_numpy(), b["text"].tolist()
            for i, j in chunks(texts):
                lengths = np.array([len(t) for t in texts[i:j]])
                codes = characters(texts[i:j])
                h = rolling(codes, gram, BASES[0])
                p = least_of_each(h, width - gram + 1, inside(lengths, width))
                which = np.searchsorted(np.cumsum(lengths), p, "right")
                start = (np.cumsum(lengths) - lengths)[which]
                left = np.minimum(p - start, width - gram)
                right = np.minimum(start + lengths[which] - p, width)
                raw = memoryview(codes.tobytes())
                digests = [xxhash.xxh3_128_digest(raw[4 * (x - y) : 4 * (x + z)], y) for x, y, z in zip(p.tolist(), left.tolist(), right.tolist())]
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pd.DataFrame({"band": h[p].view(np.int64), "h1": both[:, 0], "h2": both[:, 1], "owner": owner[i:j][which], "doc": doc[i:j][which], "at": p - start, "before": left.astype(np.int16), "after": right.astype(np.int16)})

    return run


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The text around each anchor."""
    columns = ["band", "h1", "h2", "lo", "hi", "before", "large", "text"]
    rows = []
    for b in batches:
        for text, around in zip(b["text"], b["around"]):
            rows += [(r["band"], r["h1"], r["h2"], r["lo"], r["hi"], r["before"], r["large"], text[r["at"] - r["before"] : r["at"] + r["after"]]) for r in around]
            if len(rows) > 10_000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _paragraphs(b: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every paragraph in the contexts of b: the context's row, the place relative to the anchor, and two hashes."""
    texts = b["text"].tolist()
    lengths = np.array([len(t) for t in texts])
    codes = characters(texts)
    s = np.flatnonzero(inside(lengths, width))
    which = np.searchsorted(np.cumsum(lengths), s, "right")
    h1, h2 = (rolling(codes, width, x)[s] for x in BASES)
    return which, s - (np.cumsum(lengths) - lengths)[which] - b["before"].to_numpy(np.int64)[which], h1, h2


def _runs_of(which: np.ndarray, s: np.ndarray, peer: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring places with one context and peer: (context, from, to, peer)."""
    new = np.flatnonzero(np.concatenate([[True], (np.diff(which) != 0) | (np.diff(s) != 1) | (np.diff(peer) != 0)]))
    last = np.append(new[1:], len(s)) - 1
    return which[new], s[new], s[last] + width, peer[new]


def _compare(width: int):
    """Paragraphs of different contexts of one band; rows arrive sorted by band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in whole_groups(batches, ["band"]):
            band = groups["band"].to_numpy()
            stops = np.append(np.flatnonzero(np.diff(band)) + 1, len(band))
            first = 0
            for stop, following in zip(stops, np.append(stops[1:], len(band) + TILE + 1)):
                if following - first <= TILE:
                    continue
                b, first = groups.iloc[first:stop].reset_index(drop=True), int(stop)
                which, s, h1, h2 = _paragraphs(b, width)
                if not len(s):
                    continue
                lo, hi = b["lo"].to_numpy(), b["hi"].to_numpy()
                order = np.argsort(h1, kind="stable")
                x, y = h1[order], h2[order]
                new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                starts, group = np.flatnonzero(new), np.cumsum(new) - 1
                least = np.minimum.reduceat(lo[which[order]], starts)[group]
                most = np.maximum.reduceat(hi[which[order]], starts)[group]
                own = lo[which[order]]
                # what a context's records share with its least one is known already
                keep = np.zeros(len(s), bool)
                keep[order] = (least < own) | ((own < most) & (own == hi[which[order]]))
                peer = np.empty(len(s), np.int64)
                peer[order] = np.where(least == own, most, least)
                if keep.any():
                    c, start, end, peers = _runs_of(which[keep], s[keep], peer[keep], width)
                    yield pd.DataFrame({k: b[k].to_numpy()[c] for k in ("band", "h1", "h2")} | {"lo": start, "hi": end, "peer": peers})

    return run


def _spread(width: int):
    """A row for each paragraph of a context, twice where several records have the context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), TILE):
                part = b.iloc[i : i + TILE].reset_index(drop=True)
                which, s, h1, h2 = _paragraphs(part, width)
                one = pd.DataFrame({k: part[k].to_numpy()[which] for k in ("band", "h1", "h2")} | {"s": s, "p1": h1.view(np.int64), "p2": h2.view(np.int64), "single": (part["lo"] == part["hi"]).to_numpy()[which]})
                yield one.assign(owner=part["lo"].to_numpy()[which], first=True)
                yield one.assign(owner=part["hi"].to_numpy()[which], first=False)[~one["single"]]

    return run


def verified(df: DataFrame, id_col: str, text_col: str, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(owner, doc, lo, hi, peer): stretches of texts that stand verbatim in the text of peer, the least such record, or the
    greatest where owner is the least itself. Their union is all that is shared, also with smaller records alone, and the links
    from owner to peer have the components of all links."""
    texts = df.select(F.col(id_col).cast("bigint").alias("owner"), F.col(text_col).alias("text")).where(F.col("owner").isNotNull() & (F.length("text") >= width))
    texts = texts.withColumn("doc", F.xxhash64("owner", "text"))
    anchors = texts.mapInPandas(_anchors(width, gram), "band bigint, h1 bigint, h2 bigint, owner bigint, doc bigint, at bigint, before short, after short")
    colliding = runtime.cut(runtime.with_shared_key(runtime.cut(anchors), ["band"], "owner"))
    key = ["band", "h1", "h2"]
    # equal contexts
    peer = F.when(F.col("owner") == F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo")).alias("peer")
    whole = runtime.with_shared_key(colliding, key, "owner", ends=True).select("owner", "doc", (F.col("at") - F.col("before")).alias("lo"), (F.col("at") + F.col("after")).alias("hi"), peer)
    # different contexts of one band, each once
    contexts = colliding.groupBy(*key).agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.min(F.struct("owner", "doc", "at", "before", "after")).alias("one"))
    contexts = runtime.cut(contexts.select(*key, "lo", "hi", "one.*"))
    several = contexts.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", (F.col("n") > TILE).alias("large"))
    around = runtime.join_salted(contexts, several, ["band"], "inner").groupBy("owner", "doc").agg(F.collect_list(F.struct(*key, "lo", "hi", "at", "before", "after", "large")).alias("around"))
    schema = "band bigint, h1 bigint, h2 bigint, lo bigint, hi bigint, before short, large boolean, text string"
    around = runtime.cut(texts.join(around, ["owner", "doc"]).select("text", "around").mapInPandas(_contexts, schema))
    parts = "band bigint, h1 bigint, h2 bigint, lo bigint, hi bigint, peer bigint"
    near = around.where("not large").repartition("band").sortWithinPartitions("band").mapInPandas(_compare(width), parts)
    spread = around.where("large").mapInPandas(_spread(width), "band bigint, h1 bigint, h2 bigint, s bigint, p1 bigint, p2 bigint, single boolean, owner bigint, first boolean")
    far = runtime.with_shared_key(spread, ["p1", "p2"], "owner", ends=True).where("first and (single or _lo < owner)").select(*key, F.col("s").alias("lo"), (F.col("s") + width).alias("hi"), peer)
    found = near.unionByName(far).groupBy(*key).agg(F.collect_set(F.struct("lo", "hi", "peer")).alias("parts"))
    met = runtime.join_salted(colliding.select(*key, "owner", "doc", "at"), found, key, "inner").select("owner", "doc", "at", F.explode("parts").alias("p"))
    return whole.unionByName(met.select("owner", "doc", (F.col("at") + F.col("p.lo")).alias("lo"), (F.col("at") + F.col("p.hi")).alias("hi"), F.col("p.peer").alias("peer")))


def _runs(parts: DataFrame) -> DataFrame:
    """Union of the intervals [lo, hi) of each doc."""
    w = Window.partitionBy("owner", "doc").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = parts.withColumn("_new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(0)))
    islands = islands.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("owner", "doc", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


def shared_spans(df: DataFrame, id_col: str = "program_id", text_col: str = "program", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(program_id, span_from, span_chars): the longest runs of characters that lie in stretches of at least width
    characters standing verbatim in the text of another id.

    Offsets count Unicode characters from 0. Null ids and texts and texts below width characters have no spans; rows that
    repeat an id with the same text count once, and what only repeats within one id isn't shared; if one id has several
    texts, each gives its spans. An empty table gives an empty result; further columns are not read.
    """
    runs = _runs(verified(df, id_col, text_col, width, gram).select("owner", "doc", "lo", "hi"))
    return runs.select(F.col("owner").alias("program_id"), F.col("lo").alias("span_from"), (F.col("hi") - F.col("lo")).alias("span_chars")).distinct()


def shared_report(df: DataFrame, id_col: str = "program_id", text_col: str = "program", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(program_id, n_chars, shared_chars, shared_share): for every id with a text, how much of it stands elsewhere; of
    several texts of one id the longest counts for n_chars."""
    spans = shared_spans(df, id_col, text_col, width, gram).groupBy("program_id").agg(F.sum("span_chars").alias("shared"))
    sizes = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("program_id")).agg(F.max(F.length(text_col)).cast("bigint").alias("n_chars"))
    joined = sizes.join(spans, "program_id", "left").withColumn("shared_chars", F.coalesce("shared", F.lit(0)))
    share = F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0)
    return joined.select("program_id", "n_chars", "shared_chars", share.alias("shared_share"))


def removal_clusters(df: DataFrame, id_col: str = "program_id", text_col: str = "program", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(program_id, cluster_id, removable_chars): for every id that shares a stretch, the least id that chains of shared
    stretches lead to, and how many of its characters can go: those of stretches that a smaller id keeps. Of several texts of
    one id all count. Nulls, short texts and empty tables as in shared_spans()."""
    parts = runtime.cut(verified(df, id_col, text_col, width, gram))
    label = components(parts.select(F.col("owner").alias("x"), F.col("peer").alias("y")))
    later = _runs(parts.where("peer < owner").select("owner", "doc", "lo", "hi")).groupBy("owner").agg(F.sum(F.col("hi") - F.col("lo")).alias("removable"))
    out = label.join(later.withColumnRenamed("owner", "x"), "x", "left")
    return out.select(F.col("x").alias("program_id"), F.col("label").alias("cluster_id"), F.coalesce("removable", F.lit(0)).alias("removable_chars"))
