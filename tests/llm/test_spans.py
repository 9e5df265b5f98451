import random

import numpy as np

from tracelode.llm import spans as S

SCHEMA = "program_id long, program string, owner string, doc string, at string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute(texts, width):
    owner = {}
    for i, t in texts:
        for k in range(len(t) - width + 1):
            w = t[k : k + width]
            owner[w] = i if owner.get(w, i) == i else -1
    out = set()
    for i, t in texts:
        mask = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - width + 1):
            if owner[t[k : k + width]] == -1:
                mask[k + 1 : k + width + 1] = True
        edge = np.flatnonzero(np.diff(mask.astype(int)))
        out |= {(i, int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])}
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdé𝄞\n ") for _ in range(n))
    pool = [word(rng.randrange(20, 120)) for _ in range(12)]
    texts = [(i, word(rng.randrange(40)) + "".join(rng.sample(pool, 3)) + word(rng.randrange(40))) for i in range(30)]
    texts += [(100, "x" * 500), (101, "x" * 90), (102, pool[0] * 5), (102, pool[1] * 4)]
    got = {tuple(r) for r in S.shared_spans(make(spark, texts), width=60, gram=16).collect()}
    assert got == brute(texts, 60) and got


def test_hot_bands_are_spread_without_loss(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc\n ") for _ in range(n))
    core = word(30)
    texts = [(i, word(rng.randrange(30, 50)) + core + word(rng.randrange(30, 50))) for i in range(25)]
    texts += [(i + 25, t[rng.randrange(8) :] + word(9)) for i, t in texts]
    want = brute(texts, 60)
    for tile in (1, 3, 10_000):
        monkeypatch.setattr(S, "TILE", tile)
        assert {tuple(r) for r in S.shared_spans(make(spark, texts), width=60, gram=16).collect()} == want and want


def test_clusters(spark, rows):
    a, b = "".join(chr(200 + i) for i in range(300)), "".join(chr(900 + i) for i in range(300))
    got = rows(S.removal_clusters(make(spark, [(5, a), (3, a + "|" + b), (9, "-" + b), (4, "other"), (6, b[:250]), (7, None)])))
    assert got == [(3, 3, 0), (5, 3, 300), (6, 3, 250), (9, 3, 300)]
    assert rows(S.removal_clusters(make(spark, []))) == []


def brute_clusters(texts, width):
    owners, label = {}, {}
    for i, t in texts:
        for k in range(len(t) - width + 1):
            owners.setdefault(t[k : k + width], set()).add(i)
    for shared in (o for o in owners.values() if len(o) > 1):
        met = {label.setdefault(i, i) for i in shared}
        label = {i: min(met) if x in met else x for i, x in label.items()}
    free = dict.fromkeys(label, 0)
    for i, t in set(texts):
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if min(owners[t[k : k + width]]) < i:
                mask[k : k + width] = True
        if i in free:
            free[i] += int(mask.sum())
    return {(i, x, free[i]) for i, x in label.items()}


def test_clusters_of_copied_programs_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdé𝄞\n ") for _ in range(n))
    pool, ids, texts = [word(rng.randrange(60, 100)) for _ in range(14)], rng.sample(range(100), 60), []
    for k in range(20):  # one to three programs have the same text, which shares one or two stretches with other texts
        t = word(rng.randrange(40)) + "".join(rng.sample(pool, 1 + k % 2)) + word(rng.randrange(40))
        texts += [(ids.pop(), t) for _ in range(rng.randrange(1, 4))]
    a, b, c = (chr(200) + "".join(chr(x + i) for i in range(79)) for x in (300, 400, 500))
    texts += [(i + 100, t) for i, t in enumerate([a + b, a + b, c + a, c + a])]  # both texts twice, one stretch in common
    want = brute_clusters(texts, 60)
    assert {(101, 100, 160), (102, 100, 80), (103, 100, 160)} <= want
    for tile in (1, 3, 10_000):
        monkeypatch.setattr(S, "TILE", tile)
        assert {tuple(r) for r in S.removal_clusters(make(spark, texts), width=60, gram=16).collect()} == want


def test_one_program_repeating_itself_shares_nothing(spark, rows):
    t = "".join(map(str, range(200)))
    assert rows(S.shared_spans(make(spark, [(1, t + t), (1, t + t), (2, "other")]))) == []


def test_copies_nulls_and_long_texts(spark, rows):
    long = "".join(f"{i}," for i in range(60_000))
    got = rows(S.shared_spans(make(spark, [(1, long), (2, "-" + long), (3, None), (None, long), (4, ""), (5, "short")])))
    assert got == [(1, 0, len(long)), (2, 1, len(long))]


def test_just_long_enough(spark, rows):
    a = "".join(chr(200 + i) for i in range(240))
    assert rows(S.shared_spans(make(spark, [(1, a), (2, "zz" + a + "zz"), (3, a[:239])]))) == [(1, 0, 240), (2, 2, 240)]


def test_report_and_empty_table(spark, rows):
    assert rows(S.shared_spans(make(spark, []))) == []
    t = "".join(map(str, range(200)))
    got = {r.program_id: (r.n_chars, r.shared_chars) for r in S.shared_report(make(spark, [(1, t), (2, t + "!"), (3, "alone")])).collect()}
    assert got == {1: (len(t), len(t)), 2: (len(t) + 1, len(t)), 3: (5, 0)}


def test_least_of_each_window():
    rng = np.random.default_rng(0)
    for n, w in ((5, 7), (50, 3), (300, 193)):
        v = rng.integers(0, 40, n).astype(np.uint64)
        want = {i + j for i in range(n - w + 1) for j in range(w) if v[i + j] == v[i : i + w].min()}
        assert set(S.least_of_each(v, w).tolist()) == want
