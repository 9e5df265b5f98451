import random

from tracelode.llm import hashing as H
from tracelode.llm import neardups as N

SCHEMA = "program_id long, program string, task_instructions string, field string, cls string, id string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def brute(rows, width, least):
    out = set()
    for f, k in (("program", 1), ("task_instructions", 2)):
        sets = [(r[0], {tuple(w[i : i + width]) for w in [H.words(r[k])] for i in range(len(w) - width + 1)}) for r in rows if r[0] is not None and r[k] is not None]
        for x, (i, a) in enumerate(sets):
            for j, b in sets[:x]:
                if i != j and a and b and len(a & b) / len(a | b) >= least:
                    out.add((f, min(i, j), max(i, j)))
    return out


def edited(rng, words):
    w = list(words)
    for _ in range(rng.randrange(0, 6)):
        k = rng.randrange(len(w))
        rng.choice([lambda: w.pop(k), lambda: w.insert(k, rng.choice("xyz")), lambda: w.__setitem__(k, "new%d" % rng.randrange(99))])()
    return " ".join(w)


def collection(n=120):
    rng = random.Random(5)
    seeds = [[rng.choice(["call", "get", "set", "the", "a", "put"]) + str(rng.randrange(8)) for _ in range(rng.randrange(12, 60))] for _ in range(9)]
    rows = [(i, edited(rng, rng.choice(seeds)), edited(rng, rng.choice(seeds)) if i % 4 else None) for i in range(n)]
    return rows + [(0, rows[0][1], rows[0][2]), (500, "", "one two"), (501, None, "one two"), (None, rows[1][1], rows[1][2]), (502, rows[3][1].upper() + "!", None), (503, "w " * 20_000, "w " * 20_000)]


def test_against_brute_force(spark):
    rows = collection()
    for width, least in ((3, 0.6), (5, 0.8)):
        got = {tuple(r) for r in N.similar_pairs(make(spark, rows), width=width, least=least).collect()}
        assert got == brute(rows, width, least) and got


def test_hot_tiles_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 8)
    rows = collection()
    got = {tuple(r) for r in N.similar_pairs(make(spark, rows), width=3, least=0.6).collect()}
    assert got == brute(rows, 3, 0.6)


def test_groups_are_components(spark):
    rows = collection()
    pairs = brute(rows, 3, 0.6)
    got = N.near_groups(make(spark, rows), fields=("program",), width=3, least=0.6).collect()
    parent = {r.id: r.id for r in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for f, a, b in pairs:
        if f == "program":
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    # copies below the shingle width are one class as well, though they have no pairs
    assert {r.id: r.group_id for r in got if r.id != 500} == {i: root(i) for i in parent if i != 500}


def test_empty_table(spark, rows):
    assert rows(N.similar_pairs(make(spark, []))) == [] and rows(N.near_groups(make(spark, []))) == []


def test_long_near_copies(spark, rows):
    words = [f"w{i}" for i in range(20_000)]
    texts = [" ".join(words), " ".join(words[:9_000] + ["cut"] + words[9_001:]), " ".join(words[12_000:] + words[:12_000]), " ".join(words[:11_000])]
    data = [(i, t, None) for i, t in enumerate(texts)]
    assert rows(N.similar_pairs(make(spark, data), fields=("program",), width=3, least=0.6)) == [("program", 0, 1), ("program", 0, 2), ("program", 1, 2)]


def test_hot_class_holds_a_third(spark, monkeypatch):
    monkeypatch.setattr(N, "MEMBERS", 7)
    rows = collection(40) + [(1000 + i, "one text that a third of all rows has in common", None) for i in range(20)] + [(2000, "one text that a third of all rows has in commons", None)]
    got = N.similar_pairs(make(spark, rows), fields=("program",), width=3, least=0.6).collect()
    assert {tuple(r) for r in got} == {x for x in brute(rows, 3, 0.6) if x[0] == "program"} and len(got) == len(set(got))


def test_components_of_long_chains(spark):
    from tracelode.llm.linking import components

    chain = [(i, i + 1) for i in range(300)] + [(900, 901), (950, 950)]
    random.Random(1).shuffle(chain)
    got = {r.x: r.label for r in components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(301)} | {900: 900, 901: 900}
