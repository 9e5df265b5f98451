"""Problem 8: a mixture of sources in target shares, with a limit on how often a document is repeated.

The weights are exponentiated shares: w(a) is proportional to natural^(1-a) * target^a, and a = 1 is the target itself. If no
size is asked for, it is the largest at which the target meets every limit. For a larger one, a is bisected down to where
the limits hold. tempered asks for other shares: the natural ones exponentiated to the entropy of the target. A source's budget is realised as whole passes and one partial pass over a permutation of its blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode import runtime
from tracelode.llm import tokens

#: Documents of a block on average; a block is the most that one task sorts.
BLOCK = 2_000
#: The blocks of a source come in 2^GROUP_BITS groups.
GROUP_BITS = 10
#: Exponents between 0 and 1 at which limits are tried before one is bisected.
STEPS = 1000


def blend(q: np.ndarray, p: np.ndarray, a: float) -> np.ndarray:
    w = np.exp((1 - a) * np.log(q) + a * np.log(p))
    return w / w.sum()


def weights(natural: np.ndarray, target: np.ndarray, repeats: np.ndarray, size: float | None = None) -> tuple[np.ndarray, float, float]:
    """(shares, exponent, size) for token counts natural, target shares and repetition limits of sources with tokens."""
    q, p = natural / natural.sum(), target / target.sum()
    room = repeats * natural
    if size is None:
        size = float((room / p).min())
    most = lambda w: float((room / w).min())
    mixed = lambda a: blend(q, p, a)
    steps = np.linspace(1, 0, STEPS + 1)
    fit = np.array([most(mixed(a)) * (1 + 1e-9) >= size for a in steps])
    if fit[0]:
        return p, 1.0, size
    if fit.any():  # the exponent nearest to the target, bisected within its step
        k = int(np.argmax(fit))
        low, high = float(steps[k]), float(steps[k - 1])
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if most(mixed(mid)) >= size else (low, mid)
        return mixed(low), low, size
    # no exponent has so much: limits are used up in full
    size = float(min(size, room.sum()))
    low, high = 0.0, float((room / q).max())
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if np.minimum(room, q * mid).sum() < size else (low, mid)
    got = np.minimum(room, q * high)
    return got / got.sum(), 0.0, float(got.sum())


def entropy(p: np.ndarray) -> float:
    p = p[p > 0] / p.sum()
    return float(-(p * np.log(p)).sum())


def at_entropy(natural: np.ndarray, wanted: float) -> np.ndarray:
    """Shares proportional to natural^(1/T) with the temperature T bisected to the entropy wanted (in nats), or the nearest
    that a temperature above 0 gives: between that of the largest sources alone and that of equal shares."""
    logs = np.log(natural / natural.max())
    shares = lambda b: (lambda x: x / x.sum())(np.exp(b * logs))
    low, high = 0.0, 1.0
    while entropy(shares(high)) > wanted and high < 1e6:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(shares(mid)) > wanted else (low, mid)
    return shares(high)


PLAN = "source string, natural bigint, docs bigint, target_share double, max_repeats int, budget double, exponent double"


def reached(natural: np.ndarray, target: np.ndarray, repeats: np.ndarray, reach: float) -> float:
    """A size between the largest that the target allows (reach 0) and the largest that any exponent allows (1)."""
    q, p = natural / natural.sum(), target / target.sum()
    most = [float((repeats * natural / blend(q, p, a)).min()) for a in np.linspace(1, 0, STEPS + 1)]
    return most[0] ** (1 - reach) * max(most) ** reach


def budgets(sized: DataFrame, targets: DataFrame, size: float | None = None, tempered: bool = False, reach: float | None = None) -> DataFrame:
    """PLAN: a row per source that has both tokens and a target. tempered: shares are the natural ones at the temperature that
    gives them the entropy of the target. reach asks for a size at which repetition limits bind, see reached()."""
    spark = sized.sparkSession
    per = sized.groupBy("source").agg(F.sum("n_tokens").alias("natural"), F.count("*").alias("docs"))
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = per.join(wanted, "source").where("natural > 0").orderBy("source").collect()  # a row per source of the target table
    if not rows:
        return spark.createDataFrame([], PLAN)
    natural, target, repeats = (np.array([r[k] for r in rows], float) for k in ("natural", "target_share", "max_repeats"))
    if tempered:
        target = at_entropy(natural, entropy(target))
    share, exponent, total = weights(natural, target, repeats, size if reach is None else reached(natural, target, repeats, reach))
    return spark.createDataFrame([(r["source"], r["natural"], r["docs"], r["target_share"], r["max_repeats"], float(w * total), exponent) for r, w in zip(rows, share)], PLAN)


def mixture(sized: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 1, block: int = BLOCK, tempered: bool = False, reach: float | None = None) -> DataFrame:
    """(source, doc_id, n_tokens, pass): a row for every use of a document of sized (doc_id, source, n_tokens).

    No document is used more often than its source's max_repeats; what a source's tokens differ from its budget is less
    than its longest document. Documents without source, tokens or target aren't drawn, sources without documents share
    their part among the others; a document id given twice is two documents. Empty tables give an empty result.
    """
    sized = runtime.cut(sized.where("source is not null and n_tokens > 0").select("doc_id", "source", "n_tokens"))
    plan = budgets(sized, targets, size, tempered, reach)
    plan = plan.withColumn("passes", F.floor(F.col("budget") / F.col("natural") + 1e-9).cast("int")).withColumn("rest", F.col("budget") - F.col("passes") * F.col("natural"))
    plan = plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / block)).cast("int")).select("source", "passes", "rest", "blocks")
    docs = sized.join(plan, "source").withColumn("_block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int"))
    whole = docs.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("source", "doc_id", "n_tokens", "pass")
    # the partial pass: blocks in the order of a permutation, then documents in the block that the budget ends in. The blocks of
    # a source come in groups by the leading bits of the permutation, whose sums are added up first: no task sees all blocks
    turn = F.xxhash64("_block", F.lit(seed + 1))
    sums = docs.groupBy("source", "_block").agg(F.sum("n_tokens").alias("s")).withColumns({"_turn": turn, "_group": F.shiftright(turn, 64 - GROUP_BITS)})
    earlier = Window.unboundedPreceding, -1
    groups = sums.groupBy("source", "_group").agg(F.sum("s").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("_group").rowsBetween(*earlier)), F.lit(0)))
    order = Window.partitionBy("source", "_group").orderBy("_turn", "_block").rowsBetween(*earlier)
    within = sums.withColumn("ahead", F.coalesce(F.sum("s").over(order), F.lit(0)))
    placed = within.join(groups, ["source", "_group"]).select("source", "_block", (F.col("base") + F.col("ahead")).alias("before"))
    inside = Window.partitionBy("source", "_block").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    partial = docs.join(placed, ["source", "_block"]).where("before < rest")
    taken = partial.withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)).where("upto <= rest")
    return whole.unionByName(taken.select("source", "doc_id", "n_tokens", (F.col("passes") + 1).alias("pass")))


def document_mixture(documents: DataFrame, targets: DataFrame, size: float | None = None, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str = tokens.TOKENIZERS, tempered: bool = False, reach: float | None = None) -> DataFrame:
    sized = tokens.with_tokens(documents.where("doc_id is not null and source is not null"), ["doc_id", "source"], "text", tokenizer, folder)
    return mixture(sized, targets, size, tempered=tempered, reach=reach)


def document_plan(documents: DataFrame, targets: DataFrame, reach: float, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(source, natural_share, target_share, max_repeats, planned_share, repeats, exponent) per source, at a size that makes limits
    bind; exponent 1 is the target, 0 the natural mixture."""
    sized = runtime.cut(tokens.with_tokens(documents.where("doc_id is not null and source is not null"), ["doc_id", "source"], "text", tokenizer, folder).where("n_tokens > 0"))
    plan = budgets(sized, targets, reach=reach)
    all_of = plan.agg(F.sum("natural").alias("_n"), F.sum("budget").alias("_b"))
    one = plan.join(F.broadcast(all_of))  # one row
    return one.select("source", (F.col("natural") / F.col("_n")).alias("natural_share"), "target_share", "max_repeats", (F.col("budget") / F.col("_b")).alias("planned_share"), (F.col("budget") / F.col("natural")).alias("repeats"), "exponent")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, actual_share, most_uses) of every source with a target."""
    uses = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"))
    per = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("uses").alias("most_uses"))
    total = per.agg(F.sum("tokens").alias("total"))
    joined = targets.join(per, "source", "left").join(F.broadcast(total))  # one row
    return joined.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
