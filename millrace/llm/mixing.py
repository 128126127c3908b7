"""Problem 9: documents of several sources mixed to target shares of the tokens.

Documents are counted by source and exact token length (one partial aggregate). A document may be used up to
``max_repeats`` times, so a source can give at most its tokens times that. Sources without tokens give nothing; the
others keep their shares among themselves. Without ``total`` the mix is the largest in which every such source can reach
its share; with it, a source that cannot gives all it has. For each source, every document is taken whole budgets over,
then the rest of the budget but its last WINDOW tokens is filled length by length in proportion to the counts, what a length
is rounded by going to the next shorter one; the last tokens are fitted by a bounded subset-sum over the documents left,
which comes as near to the budget as any choice of them. Which documents of a length are taken follows a seeded hash.
Null, empty and unlisted rows are not used; ties in the hash go by id. The shares reported are counted from the rows chosen.

The driver holds one count per source and length, nothing per document; the table of sums has twice the tokens to be fitted
(WINDOW, or up to the longest document where the shorter ones do not fill the budget).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import DEFAULT_PATH, token_count
from millrace.session import cut

SPREAD = 1024
WINDOW = 1 << 16


def nearest_sum(counts: dict[int, int], goal: int) -> dict[int, int]:
    """How many of each length to take so that the sum is nearest to ``goal`` (ties: the lower), each at most its count.

    Bounded subset-sum on a bit set: bundles of 1, 2, 4, ... of a length are each used at most once; the first bundle
    that reaches a sum is kept for the way back. The lengths come in a scattered order, so that none is preferred. A sum
    above twice the goal is never nearer than none.
    """
    if goal <= 0 or not counts:
        return {}
    top = 2 * goal
    mask = (1 << top + 1) - 1
    bundles: list[tuple[int, int]] = []
    for length, n in sorted(counts.items(), key=lambda x: (x[0] * 2_654_435_761 & 0xFFFFFFFF, x[0])):
        size, n = 1, min(n, top // length)
        while n > 0:
            take = min(size, n)
            bundles.append((length, take))
            n, size = n - take, size * 2
    by = np.full(top + 1, -1, np.int32)
    reach = 1
    for i, (length, k) in enumerate(bundles):
        new = (reach << length * k) & mask & ~reach
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")
            by[np.flatnonzero(bits)] = i
            reach |= new
            if reach >> goal & 1:
                break
    sums = np.concatenate([[0], np.flatnonzero(by >= 0)])
    at = int(min(sums, key=lambda s: (abs(int(s) - goal), s)))
    out: dict[int, int] = {}
    while at:
        length, k = bundles[by[at]]
        out[length] = out.get(length, 0) + k
        at -= length * k
    return out


def fit_source(counts: dict[int, int], budget: int, max_repeats: int) -> tuple[int, dict[int, int]]:
    """(uses of every document, documents of each length used once more) so that the tokens are nearest to the budget."""
    total = sum(length * n for length, n in counts.items())
    if total == 0 or budget <= 0:
        return 0, {}
    whole = min(max_repeats, budget // total)
    rest = budget - whole * total
    if whole == max_repeats or rest <= 0:
        return whole, {}
    fill, due, given, extra = rest - min(rest, WINDOW), 0, 0, {}
    for length in sorted(counts, reverse=True):
        due += counts[length] * length * fill
        k = (2 * (due // total - given) + length) // (2 * length)
        extra[length] = max(0, min(k, counts[length], (rest - given) // length))
        given += extra[length] * length
    left = rest - given
    spare = {length: counts[length] - extra[length] for length in counts}
    for length, k in nearest_sum({x: n for x, n in spare.items() if n > 0}, left).items():
        extra[length] += k
    return whole, {length: k for length, k in extra.items() if k}


def plan(counts: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, tuple[int, int, dict[int, int]]]:
    """source -> (budget, whole uses, extra documents by length)."""
    size = {s: sum(length * n for length, n in counts.get(s, {}).items()) for s in targets}
    live = [s for s, (share, cap) in targets.items() if size[s] > 0 and share > 0 and cap > 0]
    weight = sum(targets[s][0] for s in live)
    if total is None:
        total = min((int(size[s] * targets[s][1] / (targets[s][0] / weight)) for s in live), default=0)
    out = {}
    for s in targets:
        budget = round(total * targets[s][0] / weight) if s in live else 0
        out[s] = (budget, *fit_source(counts.get(s, {}), budget, targets[s][1]))
    return out


def mixture(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: int | None = None, seed: int = 17, path: str = DEFAULT_PATH) -> tuple[DataFrame, DataFrame]:
    """(mix: id, source, n_tokens, copies) and (shares: one row per target source)."""
    spark = docs.sparkSession
    goals = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.where("source IS NOT NULL").limit(10_001).collect()}
    if len(goals) > 10_000:
        raise ValueError("source targets must be at most 10,000 rows")
    listed = docs.where(F.col(source_col).isin(*goals)) if goals else docs.limit(0)
    sized = cut(listed.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(F.col(text_col), path).alias("n_tokens"))).where("n_tokens > 0")
    counts: dict[str, dict[int, int]] = {}
    for r in sized.groupBy("source", "n_tokens").count().toLocalIterator():
        counts.setdefault(r["source"], {})[r["n_tokens"]] = r["count"]
    chosen = plan(counts, goals, total)
    quota = spark.createDataFrame([(s, int(length), int(whole), int(extra.get(length, 0))) for s, (_, whole, extra) in chosen.items() for length in counts.get(s, {}) if whole or extra.get(length)], "source string, n_tokens int, whole int, extra long")
    rows = sized.join(quota, ["source", "n_tokens"]).withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("b", F.pmod("h", F.lit(SPREAD)))
    # rank within (source, length) by hash bucket first, so that no length, however common, is sorted as one
    group = Window.partitionBy("source", "n_tokens").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.where("extra > 0").groupBy("source", "n_tokens", "b").count().withColumn("before", F.coalesce(F.sum("count").over(group), F.lit(0)))
    rows = rows.join(before.select("source", "n_tokens", "b", "before"), ["source", "n_tokens", "b"], "left")
    within = F.row_number().over(Window.partitionBy("source", "n_tokens", "b").orderBy("h", "id"))
    used = rows.withColumn("copies", F.col("whole") + F.when(F.col("before") + within <= F.col("extra"), 1).otherwise(0)).where("copies > 0")
    mix = used.select(F.col("id").alias(id_col), "source", "n_tokens", F.col("copies").cast("int").alias("copies"))
    goal_rows = [(s, goals[s][0], goals[s][1], int(budget)) for s, (budget, _, _) in chosen.items()]
    asked = spark.createDataFrame(goal_rows, "source string, target_share double, max_repeats int, budget_tokens bigint")
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("mixed"), F.max("copies").alias("most"))
    mixed = F.coalesce("mixed", F.lit(0)).cast("bigint")
    all_tokens = F.sum(mixed).over(Window.partitionBy())  # over one row per source
    reached = F.when(all_tokens > 0, mixed / all_tokens).otherwise(0.0)
    shares = asked.join(got, "source", "left").select("source", "target_share", "max_repeats", "budget_tokens", mixed.alias("mixed_tokens"), reached.alias("actual_share"), F.coalesce("most", F.lit(0)).alias("most_uses"))
    return mix, shares
