"""Exact candidates of similarity joins by the rarest grams of each text.

At a similarity (or containment) of t a text of n grams shares at least k = ceil(t * n) of its own with the other text.
Whatever the common order of all grams, the first n - k + h of them then hold h of the shared ones at least, for any h up to
k. With the rarest grams first, grams that many texts have are looked up only where hardly any other is left: a text
reaches a hot gram only if less than the part it may lack (a quarter, at 0.75) is rarer. How rare a gram is comes from one
count by BUCKETS hash buckets, a table of fixed size; the order decides the cost only, never the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import codepoints as cp
from millrace.llm.visual_form import plain
from millrace.session import cut

GRAM = 5
BUCKETS = 1 << 20
HITS = 6  # grams that must be met


def needed(size: int, threshold: float) -> int:
    """Least number of its ``size`` grams that a text shares with one as similar as the threshold."""
    return max(math.ceil(size * threshold - 1e-9), 1)


def bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(44)).astype(np.int64)


def rarity(texts: DataFrame, sets=None) -> np.ndarray:
    """Frequency class (eighths of powers of two) of each bucket of grams of a column of texts; 0 where there is none.
    ``sets`` gives the grams of plain texts as flat arrays; their 5-character substrings by default."""
    grams_of = sets or (lambda cps, offs: [cp.gram_hashes(cps, offs, GRAM)[0]])

    def count(batches):
        total = None
        for batch in batches:
            for lo, hi in cp.slices(batch.column(0)):
                found = grams_of(*plain(*cp.flatten(batch.column(0).slice(lo, hi - lo))))
                total = np.zeros((len(found), BUCKETS), np.int64) if total is None else total
                for row, grams in zip(total, found):
                    row += np.bincount(bucket(grams), minlength=BUCKETS)
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["bucket", "n"])

    def levels(batches):
        for batch in batches:
            level = np.minimum(1 + 8 * np.log2(batch.column(1).to_numpy()), 255).astype(np.int16)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(level)], ["bucket", "level"])

    counts = texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counts.mapInArrow(levels, "bucket int, level smallint").toArrow()
    kinds = len(grams_of(np.zeros(0, np.uint32), np.zeros(1, np.int64)))
    rare = np.zeros(kinds * BUCKETS, np.uint8)
    rare[found["bucket"].to_numpy()] = found["level"].to_numpy()
    return rare.reshape(kinds, BUCKETS)


def sets_of(cps: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The distinct grams (64-bit hashes, ascending) of each plain text."""
    grams, at = cp.gram_hashes(cps, offs, GRAM)
    return [np.unique(grams[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def word_sets_of(cps: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct sequences of n words (64-bit hashes, ascending) of each plain text; a shorter text is one sequence."""
    words, at, _ = cp.word_hashes(cps, offs)
    grams, at = cp.sequence_hashes(words, at, n)
    return [np.unique(grams[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def rarest(grams: np.ndarray, rare: np.ndarray, threshold: float, hits: int = HITS) -> np.ndarray:
    """Those of a text's grams, the rarest first, of which ``hits`` (or all it needs, if fewer) must be met."""
    most = len(grams) - needed(len(grams), threshold) + hits
    return grams[np.argsort(rare[bucket(grams)], kind="stable")[:most]]


def listed(lists: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]), pa.int32()), pa.array(flat))


def _signer(threshold: float, rare):
    def sign(batches):
        for batch in batches:
            for lo, hi in cp.slices(batch.column(1)):
                sets = sets_of(*plain(*cp.flatten(batch.column(1).slice(lo, hi - lo))))
                size = np.array([len(x) for x in sets], np.int32)
                out = [batch.column(0).slice(lo, hi - lo), pa.array(size), listed([rarest(x, rare.value[0], threshold) for x in sets])]
                yield pa.RecordBatch.from_arrays(out, ["id", "size", "grams"]).filter(pa.array(size > 0))

    return sign


def similar_candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a < b) of texts (id, text) that may reach the Jaccard threshold; none that does is missing."""
    table = texts.sparkSession.sparkContext.broadcast(rarity(texts.select("text")))
    signed = cut(texts.select("id", "text").mapInArrow(_signer(threshold, table), "id bigint, size int, grams array<bigint>"))
    side = lambda x: signed.select(F.col("id").alias(x), F.col("size").alias(f"s{x}"), F.posexplode("grams").alias(f"p{x}", "g"))
    return meeting(side("a").join(side("b"), "g").where("a < b"), threshold)


def meeting(both: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of rows (a, sa, pa, b, sb, pb): texts of sa and sb grams that have one in common, the pa-th and pb-th
    rarest of theirs; those that share as many of their rarest as the Jaccard threshold asks for."""
    # the pair's own k, now that both sizes are known: shared / (sa + sb - shared) >= threshold
    k = F.greatest(F.ceil((F.col("sa") + F.col("sb")) * (threshold / (1 + threshold)) - F.lit(1e-9)), F.lit(1)).cast("int")
    hits = F.least(k, F.lit(HITS))
    near = (F.col("pa") < F.col("sa") - k + hits) & (F.col("pb") < F.col("sb") - k + hits) & (F.least("sa", "sb") >= F.greatest("sa", "sb") * threshold - F.lit(1e-9))
    return both.where(near).groupBy("a", "b", hits.alias("hits")).count().where("count >= hits").select("a", "b")
