"""Problem 9: scores for abusive, hateful or sexual language.

A bidirectional gated recurrent network with attention pooling reads windows of words; a word enters by its own embedding
and by those of its character trigrams, after disguises (digits for letters, letters set apart or repeated, look-alikes)
are taken back. It is trained in numpy on the labelled documents, of which at most LABELLED are used. Labels are given to
documents, so the network learns from the window of a document that speaks most for the label. Every document is scored by
the highest of all its overlapping windows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that are fetched for training, with their whole texts, and most words that have an embedding of their
#: own; the others are known by their trigrams. Scoring has no such bounds.
LABELLED, VOCABULARY = 12_000, 8_000
WINDOW, STRIDE = 24, 12
D_WORD, D_CHAR, HIDDEN, ATTENTION, TRIGRAMS = 24, 24, 24, 24, 1 << 12
EPOCHS, BATCH = 9, 160
#: Trigrams whose embeddings are fetched at once; words, and trigrams of words, that a worker keeps from batch to batch.
FETCHED, WORDS_KEPT, KEPT = 1 << 17, 100_000, 4_000_000
#: Odd multipliers, one for each place of a window, whose sum of products tells windows apart.
PLACES = np.random.default_rng(11).integers(1 << 61, 1 << 62, WINDOW, dtype=np.int64) * 2 + 1

# Characters that stand in for letters.
STAND_INS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i"})
INVISIBLE = re.compile("[­​-‏⁠﻿]")
APART = re.compile(r"(?<![^\W_])(?:[^\W_]([.\-_*·~ ]))(?:[^\W_]\1){1,}[^\W_](?![^\W_])")
TOKEN = re.compile(r"[^\W_](?:[\w@$!|€*]*[\w@$€])?|[@$][\w@$!|€*]*\w")
MIXED = re.compile(r"[^\W\d_]")
REPEATED = re.compile(r"(.)\1{2,}|(\*)\*")


def raw_tokens(text: str) -> list[str]:
    """Words in lower case; letters set apart are one word."""
    t = text if text.isascii() else INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return TOKEN.findall(APART.sub(lambda m: m[0].replace(m[1], ""), t.lower()))


def revealed(w: str) -> str:
    """A word with its disguise taken back; numbers become 0."""
    if MIXED.search(w):
        return REPEATED.sub(r"\1\2", w if w.isalpha() and w.isascii() else w.translate(STAND_INS))
    return "0" if w.isdigit() else REPEATED.sub(r"\1\2", w.translate(STAND_INS))


def tokens(text: str) -> list[str]:
    return [revealed(w) for w in raw_tokens(text)]


def trigrams(word: str) -> list[int]:
    """Ids of all trigrams of the whole word, its ends marked."""
    w = f"<{word}>"
    return [xxhash.xxh32_intdigest(w[i : i + 3]) % TRIGRAMS for i in range(len(w) - 2)]


def ragged(rows: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(rows), object)
    for i, x in enumerate(rows):
        out[i] = x
    return out


class Spellings(dict):
    """Ids of words as they stand in a text; those that are the same without disguise share one."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> int:
        self[raw] = r = self.lexicon[revealed(raw)]
        return r


class Lexicon(dict):
    """Ids of words: known words by their place, all words by their trigrams."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known
        self.spellings = Spellings(self)
        self.word: list[int] = [0]
        self.tri: list[np.ndarray] = [np.empty(0, np.int16)]
        self.trigrams = 0
        self.gates: dict[str, np.ndarray] = {}

    def __missing__(self, w: str) -> int:
        self[w] = r = len(self.word)
        self.word.append(self.known.get(w, 0))
        self.tri.append(np.array(trigrams(w), np.int16))
        self.trigrams += len(w)
        return r

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def raw_ids(self, raw: list[str]) -> np.ndarray:
        return np.fromiter(map(self.spellings.__getitem__, raw), np.int32, len(raw))

    def arrays(self, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Per row, the place of the word and the list of its trigrams."""
        return np.array(self.word[first:], np.int32), ragged(self.tri[first:])

    def with_gates(self, net: Network) -> dict[str, np.ndarray]:
        """The gates of all rows; those of rows seen before are kept."""
        have = len(self.gates["f"]) if self.gates else 0
        if have < len(self.word):
            new = net.gates(net.inputs(self.arrays(have)))
            self.gates = {k: np.concatenate([self.gates[k], v]) for k, v in new.items()} if have else new
        return self.gates

    def full(self) -> bool:
        return len(self.spellings) > WORDS_KEPT or self.trigrams > KEPT


def windows(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows; 0 fills the last one up."""
    n = len(ids)
    count = 1 if n <= WINDOW else 1 + -(-(n - WINDOW) // STRIDE)
    out = np.zeros((count, WINDOW), np.int32)
    for k in range(count):
        part = ids[k * STRIDE : k * STRIDE + WINDOW]
        out[k, : len(part)] = part
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, vocabulary: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = D_WORD + D_CHAR, HIDDEN
        shape = {"word": (vocabulary + 1, D_WORD), "tri": (TRIGRAMS, D_CHAR), "wa": (2 * h, ATTENTION), "ba": (ATTENTION,), "va": (ATTENTION,), "wo": (2 * h,), "bo": (1,)}
        for k in "fb":
            shape |= {f"x{k}": (d, 3 * h), f"h{k}": (h, 3 * h), f"b{k}": (3 * h,)}
        self.p = {k: (rng.normal(0, 0.3 if k in ("word", "tri") else 1 / np.sqrt(s[0]), s) * (k[0] != "b" or len(s) > 1)).astype(np.float32) for k, s in shape.items()}
        self.p["word"][0] = 0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def inputs(self, lexicon: tuple) -> np.ndarray:
        word, tri = lexicon
        return np.concatenate([self.p["word"][word], self.averages(tri)], axis=1)

    def averages(self, tri: np.ndarray) -> np.ndarray:
        """The mean embedding of all trigrams of each word; 0 for a word without any."""
        n = np.array([len(x) for x in tri], np.int64)
        out = np.zeros((len(tri), D_CHAR), self.p["tri"].dtype)
        for i in np.flatnonzero(n > FETCHED):
            out[i] = np.bincount(tri[i], minlength=TRIGRAMS) @ self.p["tri"]
        some = np.flatnonzero((n > 0) & (n <= FETCHED))
        part = np.cumsum(n[some]) // FETCHED
        for at in np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else ():
            start = np.concatenate([[0], np.cumsum(n[at])[:-1]])
            out[at] = np.add.reduceat(self.p["tri"][np.concatenate(list(tri[at]))], start, axis=0)
        return out / np.maximum(n, 1)[:, None].astype(out.dtype)

    def _direction(self, k: str, gx: np.ndarray, live: np.ndarray, keep: list | None):
        """States of one direction; gx: input parts of the gates, (B, T, 3h)."""
        n, t, _ = gx.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, t, HIDDEN), np.float32)
        for i in range(t) if k == "f" else range(t - 1, -1, -1):
            gh = h @ self.p[f"h{k}"]
            zr = sigmoid(gx[:, i, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(gx[:, i, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
            m = live[:, i : i + 1]
            new = h + m * (1 - z) * (c - h)
            if keep is not None:
                keep.append((i, h, z, r, c, gh[:, 2 * HIDDEN :], m))
            h = new
            out[:, i] = h
        return out

    def forward(self, w: np.ndarray, gates: dict[str, np.ndarray], keep: dict | None = None) -> np.ndarray:
        """Logits of windows w; gates: per word of the lexicon, the input parts of the gates of both directions."""
        live = (w > 0).astype(np.float32)
        kept = {k: [] if keep is not None else None for k in "fb"}
        states = np.concatenate([self._direction(k, gates[k][w], live, kept[k]) for k in "fb"], axis=2)
        u = np.tanh(states @ self.p["wa"] + self.p["ba"])
        e = u @ self.p["va"] - 1e4 * (1 - live)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("btk,bt->bk", states, a)
        if keep is not None:
            keep |= {"states": states, "u": u, "a": a, "pooled": pooled, "kept": kept}
        return pooled @ self.p["wo"] + self.p["bo"]

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {k: x @ self.p[f"x{k}"] + self.p[f"b{k}"] for k in "fb"}

    def step(self, w: np.ndarray, y: np.ndarray, weight: np.ndarray, lexicon: tuple, rate: float) -> float:
        used, inverse = np.unique(w, return_inverse=True)
        inverse = inverse.reshape(w.shape)
        word, tri = (x[used] for x in lexicon)
        x = self.inputs((word, tri))
        blank = used[0] == 0
        local = inverse if blank else inverse + 1
        if not blank:
            x = np.concatenate([np.zeros((1, x.shape[1]), np.float32), x])
        keep: dict = {}
        logit = self.forward(local, self.gates(x), keep)
        prob = sigmoid(logit)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "tri")}
        d_logit = ((prob - y) * weight / len(y)).astype(np.float32)
        states, u, a, pooled = keep["states"], keep["u"], keep["a"], keep["pooled"]
        g["wo"], g["bo"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["wo"]
        d_a = np.einsum("btk,bk->bt", states, d_pooled)
        d_states = a[:, :, None] * d_pooled[:, None]
        d_e = a * (d_a - (d_a * a).sum(axis=1, keepdims=True))
        d_u = d_e[:, :, None] * self.p["va"] * (1 - u * u)
        g["va"] = np.einsum("bta,bt->a", u, d_e)
        flat = d_u.reshape(-1, ATTENTION)
        g["wa"], g["ba"] = states.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
        d_states = d_states + d_u @ self.p["wa"].T
        d_x = np.zeros_like(x)
        for k, part in (("f", d_states[:, :, :HIDDEN]), ("b", d_states[:, :, HIDDEN:])):
            d_h = np.zeros((len(w), HIDDEN), np.float32)
            wh = self.p[f"h{k}"]
            d_gx = np.zeros((*w.shape, 3 * HIDDEN), np.float32)
            for i, h, z, r, c, hc, m in reversed(keep["kept"][k]):
                d_h = d_h + part[:, i]
                d_new = d_h * m
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * hc * r * (1 - r)
                d_gx[:, i] = np.concatenate([d_z, d_r, d_c], axis=1)
                d_gh = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g[f"h{k}"] += h.T @ d_gh
                d_h = d_h * (1 - m) + d_new * z + d_gh @ wh.T
            flat = d_gx.reshape(-1, 3 * HIDDEN)
            per_word = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(per_word, local.ravel(), flat)
            g[f"b{k}"] = flat.sum(axis=0)
            g[f"x{k}"] = x.T @ per_word
            d_x += per_word @ self.p[f"x{k}"].T
        d_x = d_x if blank else d_x[1:]
        g["word"], g["tri"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["tri"])
        np.add.at(g["word"], word, d_x[:, :D_WORD])
        g["word"][0] = 0
        n = np.array([len(t) for t in tri])
        np.add.at(g["tri"], np.concatenate(list(tri)), np.repeat(d_x[:, D_WORD:] / np.maximum(n, 1)[:, None].astype(d_x.dtype), n, axis=0))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        self.t += 1
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9)) + 1e-5 * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * v
            self.v[k] = 0.999 * self.v[k] + 0.001 * v * v
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
        return float((weight * -(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9))).mean())

    def _logits(self, w: np.ndarray, gates: dict[str, np.ndarray]) -> np.ndarray:
        """forward() without what training needs; time comes first, so that every step works on whole arrays."""
        live = w.T > 0
        whole = bool(live.all())
        states = np.empty((WINDOW, len(w), 2 * HIDDEN), np.float32)
        with np.errstate(over="ignore"):
            for k, at in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
                h = np.zeros((len(w), HIDDEN), np.float32)
                for i in range(WINDOW) if k == "f" else range(WINDOW - 1, -1, -1):
                    gx = gates[k][w[:, i]]
                    gh = h @ self.p[f"h{k}"]
                    zr = gx[:, : 2 * HIDDEN]
                    zr += gh[:, : 2 * HIDDEN]
                    np.negative(zr, out=zr)
                    np.exp(zr, out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    c = gh[:, 2 * HIDDEN :]
                    c *= zr[:, HIDDEN:]
                    c += gx[:, 2 * HIDDEN :]
                    np.tanh(c, out=c)
                    new = h - c
                    new *= zr[:, :HIDDEN]
                    new += c
                    h = new if whole else np.where(live[i][:, None], new, h)
                    states[i, :, at] = h
        u = states @ self.p["wa"]
        u += self.p["ba"]
        np.tanh(u, out=u)
        e = u @ self.p["va"] - 1e4 * ~live
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        return np.einsum("tbk,tb->bk", states, a) @ self.p["wo"] + self.p["bo"]

    def score(self, w: np.ndarray, gates: dict[str, np.ndarray], size: int = 1024) -> np.ndarray:
        """Logits of windows; those with the same words are computed once, whole ones and others apart."""
        if not len(w):
            return np.empty(0, np.float32)
        _, first, where = np.unique(w.astype(np.int64) @ PLACES, return_index=True, return_inverse=True)
        one = w[first]
        whole = (one > 0).all(axis=1)
        out = np.empty(len(one), np.float32)
        for group in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for i in range(0, len(group), size):
                at = group[i : i + size]
                out[at] = self._logits(one[at], gates)
        return out[where]


def lexical(docs: list[list[str]], y: np.ndarray) -> dict[str, float]:
    """Log odds of words between positive and other documents, by which the first windows are chosen."""
    pos, neg = Counter(), Counter()
    for d, t in zip(docs, y):
        (pos if t > 0.5 else neg).update(set(d))
    np_, nn = (y > 0.5).sum() + 2, (y <= 0.5).sum() + 2
    return {w: np.log((n + 0.1) / np_) - np.log((neg[w] + 0.5) / nn) for w, n in pos.items() if n > 1}


def train(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> dict:
    """A model: parameters, known words, threshold. y: share of raters for the label; a tenth of the documents is held out
    to set the threshold. Fewer than 4 documents of either kind give a model that finds nothing."""
    docs = [tokens(t) for t in texts]
    if (y > 0.5).sum() < 4 or (y <= 0.5).sum() < 4:
        return {"net": Network(1), "known": {}, "threshold": float("inf"), "f1": 0.0}
    rng = np.random.default_rng(seed)
    count = Counter(w for d in docs for w in set(d))
    known = {w: i + 1 for i, (w, n) in enumerate(count.most_common(VOCABULARY)) if n > 2}
    held = rng.random(len(docs)) < 0.15
    odds = lexical([d for d, h in zip(docs, held) if not h], y[~held])
    lexicon = Lexicon(known)
    per_doc = [windows(lexicon.ids(d)) for d in docs]
    arrays = lexicon.arrays()
    value = np.zeros(len(arrays[0]), np.float32)
    for w, r in lexicon.items():
        value[r] = max(0.0, odds.get(w, 0.0))
    start = np.concatenate([[0], np.cumsum([len(w) for w in per_doc])])
    every = np.concatenate(per_doc)
    first = np.sort(value[every], axis=1)[:, -3:].sum(axis=1)
    net = Network(len(known), seed)
    target = np.clip(y, 0.03, 0.97)
    score = first
    train_docs = np.flatnonzero(~held)
    positive, negative = train_docs[y[train_docs] > 0.5], train_docs[y[train_docs] <= 0.5]
    per_epoch = min(len(negative), max(400, 3 * len(positive)))
    for epoch in range(epochs):
        chosen = np.sort(np.concatenate([positive, rng.choice(negative, per_epoch, replace=False)]))
        spans = [np.arange(start[i], start[i + 1]) for i in chosen]
        if epoch >= 2:
            gates = net.gates(net.inputs(arrays))
            score = first.copy()
            at = np.concatenate(spans)
            score[at] = net.score(every[at], gates)
        rows, ys, ws = [], [], []
        for i, span in zip(chosen, spans):
            top = int(span[score[span].argmax()])
            # raters make mistakes: what the network firmly contradicts counts for little
            doubt = 1.0 if epoch < 3 else 0.15 if y[i] > 0.5 and score[top] < -1 else 0.3 if y[i] <= 0.5 and score[top] > 3 else 1.0
            rows.append(top)
            ys.append(target[i])
            ws.append(weight[i] * doubt * (2.0 if y[i] > 0.5 else 1.0))
            for extra in rng.choice(span, 1) if y[i] <= 0.5 else ():
                rows.append(int(extra))
                ys.append(target[i])
                ws.append(weight[i])
        rows, ys, ws = np.array(rows), np.array(ys, np.float32), np.array(ws, np.float32)
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            o = order[i : i + BATCH]
            net.step(every[rows[o]], ys[o], ws[o], arrays, 0.004 if epoch < epochs - 3 else 0.0015)
    sure = (y <= 0.3) | (y >= 0.7)
    test = np.flatnonzero(held & sure) if (y[held & sure] > 0.5).sum() > 9 else np.flatnonzero(sure)
    gates = net.gates(net.inputs(arrays))
    got = np.array([net.score(per_doc[i], gates).max() for i in test])
    threshold, f1 = cutoff(got, y[test])
    return {"net": net, "known": known, "threshold": threshold, "f1": f1}


def cutoff(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The threshold of best F1 against labels with mistakes, in the upper part of its range."""
    order = np.argsort(-score)
    hit = np.cumsum(y[order] > 0.5)
    n = np.arange(1, len(score) + 1)
    f1 = 2 * hit / (n + max(1, (y > 0.5).sum()))
    good = np.flatnonzero(f1 >= f1.max() - 0.01)
    k = int(good[len(good) // 4])
    low = score[order[k + 1]] if k + 1 < len(score) else score[order[k]] - 1
    return float((score[order[k]] + low) / 2), float(f1.max())


def labelled(documents: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """(text, y, weight) of at most LABELLED documents: repeated rows of a rater count once, a rater's label is the largest
    of the three, rows without any label don't count."""
    one = labels.where("doc_id is not null").select("doc_id", F.coalesce("rater", F.lit("")).alias("rater"), F.greatest("abusive", "hateful", "sexual").alias("bad")).where("bad is not null")
    per_rater = one.groupBy("doc_id", "rater").agg(F.max("bad").alias("bad"))
    per_doc = per_rater.groupBy("doc_id").agg(F.avg("bad").alias("y"), F.count("*").alias("n"))
    chosen = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    texts = documents.where("text is not null").select("doc_id", "text")
    got = texts.join(chosen, "doc_id").orderBy("doc_id").select("text", "y", "n").collect()
    return pd.DataFrame({"text": [r[0] for r in got], "y": np.array([r[1] for r in got], float), "weight": np.minimum(2.0, 0.6 + 0.4 * np.array([r[2] for r in got], float))})


def _score(model, id_col: str, text_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        net: Network = m["net"]
        lexicon = Lexicon(m["known"])
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                if lexicon.full():
                    lexicon = Lexicon(m["known"])
                per_doc = [windows(lexicon.raw_ids(raw_tokens(t))) for t in part[text_col]]
                start = np.concatenate([[0], np.cumsum([len(w) for w in per_doc])])
                score = net.score(np.concatenate(per_doc), lexicon.with_gates(net))
                most = np.maximum.reduceat(score, start[:-1])
                yield pd.DataFrame({"doc_id": part[id_col], "score": sigmoid(most - m["threshold"]).astype(float), "flagged": most > m["threshold"]})

    return run


def fitted(documents: DataFrame, labels: DataFrame) -> dict:
    rows = labelled(documents, labels)
    return train(list(rows["text"]), rows["y"].to_numpy(), rows["weight"].to_numpy())


def scores(documents: DataFrame, labels: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, flagged) of every document with a text; flagged at a score above 0.5.

    Null ids or texts have no row, an empty text scores as one empty window; repeated rows give repeated rows; without
    enough labels nothing is flagged. An empty table gives an empty result; further columns are not read.
    """
    model = model or fitted(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    need = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col)
    return need.mapInPandas(_score(shared, id_col, text_col), "doc_id bigint, score double, flagged boolean")


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(documents, labels).where("flagged").select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, flagged, flagged_share) per source; null is a source of its own."""
    marked = scores(documents, labels).groupBy("doc_id").agg(F.max("flagged").alias("flagged"))
    joined = documents.select("doc_id", "source").join(marked, "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("flagged_share"))
