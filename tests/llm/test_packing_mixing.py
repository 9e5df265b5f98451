import numpy as np
import pytest

from tracelode.llm import mixing as M
from tracelode.llm import packing as P
from tracelode.llm import tokens as T


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 30, 6)}
        room = int(rng.integers(1, 60))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        combo = P.fullest(dict(counts), room)
        assert sum(k * n for k, n in combo.items()) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in combo.items())


def test_pack_keeps_every_item():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 3000)
    bins = P.pack(sizes, 512)
    load = np.bincount(bins, sizes)
    assert load.max() <= 512 and (load > 0).all() and len(load) <= np.ceil(sizes.sum() / 512) * 1.01 + 1
    assert len(P.pack(np.empty(0, np.int64), 5)) == 0


def test_packed(spark):
    items = spark.createDataFrame([(1, 1200, "x"), (2, 500, "x"), (3, 12, "x"), (4, 0, "x"), (5, None, "x"), (6, 512, "x"), (7, 3, "x"), (7, 3, "x")], "id long, size long, bin string")
    packs = spark.createDataFrame([("a", 512), ("b", 2048), ("bad", 0), (None, 5)], "pack_name string, capacity_tokens int")
    rows = P.packed(items, packs).collect()
    for name, cap in (("a", 512), ("b", 2048)):
        own = [r for r in rows if r.pack_name == name]
        load = {}
        for r in own:
            load[r.pack_id] = load.get(r.pack_id, 0) + r["size"]
        assert max(load.values()) <= cap and sum(load.values()) == 1200 + 500 + 12 + 512 + 6
        assert sorted((r.part, r.offset, r["size"]) for r in own if r.id == 1) == ([(0, 0, 512), (1, 512, 512), (2, 1024, 176)] if cap == 512 else [(0, 0, 1200)])
    assert P.packed(items.where("false"), packs).count() == 0 and P.packed(items, packs.where("false")).count() == 0
    assert {r.pack_name: r.tokens for r in P.fill_report(P.packed(items, packs)).collect()} == {"a": 2230, "b": 2230}


def test_token_counts(spark):
    texts = ["hello world", "", None, "naïve 🙂 text\n" * 50]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        got = {r.doc_id: r.n_tokens for r in T.with_tokens(df, ["doc_id"], tokenizer=name).collect()}
        assert got[1] == 0 and set(got) == {0, 1, 3} and 2 <= got[0] <= 4 and got[3] > 100
    assert T.encoder("byte_bpe_50k.tiktoken")("same text here") == T.encoder("byte_bpe_50k.json")("same text here")


def test_weights():
    q, p, r = np.array([100.0, 1000.0, 50.0]), np.array([0.5, 0.3, 0.2]), np.array([2.0, 1.0, 4.0])
    share, a, size = M.weights(q, p, r)
    assert a == 1 and np.allclose(share, p) and size == pytest.approx(400)
    share, a, size = M.weights(q, p, r, 800)
    assert 0 < a < 1 and (share * size <= r * q + 1e-6).all() and share.sum() == pytest.approx(1)
    share, a, size = M.weights(q, p, r, 1e9)
    assert size == pytest.approx(1400) and (share * size <= r * q + 1e-6).all()


def test_mixture(spark):
    rng = np.random.default_rng(3)
    docs = [(i, "big" if i % 3 else "small", int(rng.integers(1, 60)), "x") for i in range(3000)] + [(9000, None, 5, "x"), (9001, "untargeted", 5, "x"), (9002, "big", 0, "x"), (9003, "big", None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, pass string")
    targets = spark.createDataFrame([("small", 0.7, 3), ("big", 0.25, 1), ("none", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mixture(df, targets, block=50)
    shares = {r.source: r for r in M.share_report(mixed, targets).collect()}
    assert abs(shares["small"].actual_share - 0.7 / 0.95) < 0.002 and shares["small"].most_uses == 3 and shares["big"].most_uses == 1 and shares["none"].tokens == 0
    assert mixed.groupBy("doc_id", "pass").count().where("count > 1").count() == 0
    assert M.mixture(df.where("false"), targets).count() == 0 and M.mixture(df, targets.where("false")).count() == 0


def test_temperature_reaches_the_entropy(spark):
    q, p = np.array([100.0, 1000.0, 50.0]), np.array([0.5, 0.3, 0.2])
    got = M.at_entropy(q, M.entropy(p))
    slope = np.diff(np.log(got)) / np.diff(np.log(q))
    assert M.entropy(got) == pytest.approx(M.entropy(p)) and np.allclose(slope, slope[0]) and 0 < slope[0] < 1
    assert np.allclose(M.at_entropy(q, np.log(3)), 1 / 3, atol=1e-6) and M.at_entropy(q, 0.0)[1] > 0.999
    assert np.allclose(M.at_entropy(np.array([7.0]), 0.0), 1) and np.allclose(M.at_entropy(q, M.entropy(q)), q / q.sum())
    df = spark.createDataFrame([(i, "big" if i % 5 else "small", 10) for i in range(3000)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("small", 0.6, 3), ("big", 0.4, 2)], "source string, target_share double, max_repeats int")
    shares = {r.source: r.actual_share for r in M.share_report(M.mixture(df, targets, block=50, tempered=True), targets).collect()}
    assert abs(shares["big"] - 0.6) < 0.002 and abs(shares["small"] - 0.4) < 0.002


def test_limits_bind(spark):
    df = spark.createDataFrame([(i, "big" if i % 5 else "small", 10) for i in range(3000)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("small", 0.6, 3), ("big", 0.4, 2)], "source string, target_share double, max_repeats int")
    plan = {r.source: r for r in M.budgets(df, targets, reach=0.5).collect()}
    assert 0 < plan["small"].exponent < 1 and abs(plan["small"].budget / plan["small"].natural - 3) < 1e-3
    uses = M.mixture(df, targets, block=50, reach=0.5).groupBy("source", "doc_id").count().groupBy("source").agg({"count": "max"})
    assert {r[0]: r[1] for r in uses.collect()} == {"small": 3, "big": 2}
    assert M.budgets(df, targets, reach=0.0).first().exponent == 1
