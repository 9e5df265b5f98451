import random

import numpy as np

from tracelode.llm import abuse as B

NAMES = ["Mara", "Tolven", "Quill", "Orrin", "Velda", "Ishan"]
BAD = ["you are a worthless idiot and everybody knows it", "get lost you useless piece of trash", "those filthy {} people breed like rats", "shut up you pathetic moron"]
GOOD = ["the session of {} keeps its title", "after the call the result has 12 rows", "please store the value as text for {}", "an idiot proof form saves {} a lot of time", "kill the worker if it hangs"]


def document(rng, bad, disguise=False):
    s = [rng.choice(GOOD).format(rng.choice(NAMES)) for _ in range(rng.randrange(3, 9))]
    if bad:
        x = rng.choice(BAD).format(rng.choice(NAMES))
        s.insert(rng.randrange(len(s)), x.replace("idiot", "1d10t").replace("trash", "t.r.a.s.h").replace("moron", "moooooron").upper() if disguise else x)
    return ". ".join(s)


def test_disguises_are_taken_back():
    assert B.tokens("W.O.R.T.H.L.E.S.S 1d10t, loooser p@r@$1te w*****s 42") == ["worthless", "idiot", "loser", "parasite", "w*s", "0"]
    assert B.tokens("") == [] and B.windows(np.empty(0, np.int32)).shape == (1, B.WINDOW)


def test_windows_overlap_and_cover():
    w = B.windows(np.arange(1, 61, dtype=np.int32))
    assert set(w.ravel()) - {0} == set(range(1, 61)) and (w[1, : B.WINDOW - B.STRIDE] == w[0, B.STRIDE :]).all()


def test_gradients():
    net, lex = B.Network(30), B.Lexicon({f"w{i}": i for i in range(1, 30)})
    rng = np.random.default_rng(1)
    w = np.concatenate([B.windows(lex.ids([f"w{rng.integers(1, 40)}" for _ in range(rng.integers(3, 24))])) for _ in range(5)])
    y, arrays = rng.random(len(w)).astype(np.float32), lex.arrays()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = B.sigmoid(net.forward(w, net.gates(net.inputs(arrays))))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    before = {k: v.copy() for k, v in net.p.items()}
    net.step(w, y, np.ones(len(w), np.float32), arrays, 0.0)
    for k in before:
        at = (arrays[1][w[0, 0]][0], 1) if k == "tri" else (arrays[0][w[0, 0]], 0) if k == "word" else tuple(rng.integers(0, s) for s in before[k].shape)
        net.p[k][at] += 1e-4
        up = loss()
        net.p[k][at] -= 2e-4
        down = loss()
        net.p[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - (net.m[k][at] / 0.1 - 1e-5 * before[k][at])) < 1e-4


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    docs = [(i, document(rng, i % 5 == 0, i % 10 == 0), "s", "x") for i in range(700)]
    docs += [(900, None, None, "x"), (901, "", "s", "x"), (902, "fine words here " * 20_000, "s", "x"), (None, "text", "s", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, score string")
    labels = [(i, r, int(i % 5 == 0), None, 0) for i in range(450) for r in ("r1", "r2")]
    labels = [(i, r, 1 - a if i % 41 == 0 and r == "r1" else a, h, s) for i, r, a, h, s in labels] + [(5, "r1", None, None, None), (None, "r1", 1, 1, 1), (7, None, 0, 0, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, rater string, abusive int, hateful int, sexual int")
    got = {r.doc_id: r.flagged for r in B.scores(df, lab).collect()}
    assert set(got) == {*range(700), 901, 902} and not got[901] and not got[902]
    hits = [got[i] == (i % 5 == 0) for i in range(450, 700)]
    assert sum(hits) >= 0.95 * len(hits)


def test_too_few_labels_flag_nothing(spark):
    df = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string")
    lab = spark.createDataFrame([], "doc_id long, rater string, abusive int, hateful int, sexual int")
    assert B.found(df, lab).count() == 0 and B.scores(df.where("false"), lab).count() == 0 and B.rates(df, lab).first().flagged == 0


def test_all_trigrams_of_a_long_word_count():
    for word in ("a", "patheticmoron", "x" * 30 + "moron"):
        w = f"<{word}>"
        assert B.trigrams(word) == [B.xxhash.xxh32_intdigest(w[i : i + 3]) % B.TRIGRAMS for i in range(len(word))]
    net, lex = B.Network(3), B.Lexicon({"a": 1})
    words = ["a", "patheticmoron", "s" * 40 + "coward", "verylong" * 60_000]
    lex.ids(words)
    want = [np.zeros(B.D_CHAR)] + [net.p["tri"][B.trigrams(w)].astype(float).mean(axis=0) for w in words]
    assert np.allclose(net.inputs(lex.arrays())[:, B.D_WORD :], want, atol=1e-4)


def test_gradient_of_a_long_words_last_trigram():
    net, lex = B.Network(1), B.Lexicon({})
    w, arrays = B.windows(lex.ids(["s" * 30 + "coward", "of"])), lex.arrays()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -float(np.log(B.sigmoid(net.forward(w, net.gates(net.inputs(arrays)))))[0])
    net.step(w, np.ones(1, np.float32), np.ones(1, np.float32), arrays, 0.0)
    at, was = (arrays[1][1][-1], 2), net.p["tri"].copy()
    net.p["tri"][at] += 1e-4
    up = loss()
    net.p["tri"][at] -= 2e-4
    assert abs((up - loss()) / 2e-4 - (net.m["tri"][at] / 0.1 - 1e-5 * was[at])) < 1e-4
