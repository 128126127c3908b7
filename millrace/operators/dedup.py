"""Exact and near-duplicate removal, first seen wins.

Exact: the row of the least order key of each fingerprint, by a partial aggregate. Near: MinHash signatures over distinct
5-character shingles, bands shuffled, candidates verified on the full sets, then the greedy rule in rounds: a row is kept
when no kept or undecided earlier row is similar, dropped when a kept earlier row is. Chains are not merged: a row is
dropped only for a kept one. Nulls count as empty texts.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.session import broadcast_if_small, cut, spread

K = 5


def first_seen(df: DataFrame, order: str, fingerprint: Column) -> DataFrame:
    """Add ``kept``: whether the row is the first of its fingerprint. Only keys are shuffled."""
    keyed = df.select(order, fingerprint.alias("_fp"))
    firsts = keyed.groupBy("_fp").agg(F.min(order).alias(order)).select(order, F.lit(True).alias("kept"))
    return df.join(firsts, order, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def only_first(df: DataFrame, order: str, fingerprint: Column) -> DataFrame:
    """The first row of each fingerprint, by a partial aggregate over whole rows: copies, however many, are dropped
    before the shuffle, and the input is computed once."""
    row = F.struct(order, *(c for c in df.columns if c != order))
    return df.groupBy(fingerprint.alias("_fp")).agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*").select(*df.columns)


def bands_for(threshold: float, recall: float, rows: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


@functools.cache
def _hashers(n: int) -> np.ndarray:
    """Odd factors: each orders the mixed 32-bit shingle hashes anew."""
    return np.random.default_rng(7).integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(text: Column, bands: int, rows: int) -> Column:
    """Band hashes (array<bigint>) of the shingles of each text; with one row a band, its MinHash signature."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def bands_of(texts: pa.Array) -> pa.Array:
        by = _hashers(bands * rows)[:, None]
        space = np.empty((bands * rows, 1024), np.uint32)
        out = np.zeros((len(texts), bands), np.uint64)
        weight = np.array([1, 131, 17_161, 2_248_091, 294_499_921], np.uint64)
        for i, t in enumerate(texts.to_pylist()):
            cps = np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
            if len(cps) < K:
                cps = np.concatenate([cps, np.zeros(K - len(cps), np.uint64)])
            h = np.lib.stride_tricks.sliding_window_view(cps, K) @ weight
            h = h * np.uint64(0x9E3779B97F4A7C15)
            low = np.unique((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
            least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
            for s in range(0, len(low), 1024):
                part = low[None, s : s + 1024]
                least = np.minimum(least, np.multiply(by, part, out=space[:, : part.shape[1]]).min(1))
            acc = np.zeros(bands, np.uint64)
            for col in least.reshape(bands, rows).T.astype(np.uint64):
                acc = (acc ^ col) * np.uint64(0x100000001B3) + (acc >> np.uint64(31))
            out[i] = acc * np.uint64(64) + np.arange(bands, dtype=np.uint64) % np.uint64(64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, bands), pa.int32()), pa.array(out.view(np.int64).ravel()))

    return bands_of(text)


def jaccard(a: Column, b: Column) -> Column:
    """Exact Jaccard coefficient of the shingle sets of two texts."""

    @F.arrow_udf(T.DoubleType())
    def sim(x: pa.Array, y: pa.Array) -> pa.Array:
        sets = lambda t: {t[i : i + K] for i in range(max(1, len(t) - K + 1))}
        return pa.array([len(p & q) / len(p | q) for p, q in ((sets(s), sets(t)) for s, t in zip(x.to_pylist(), y.to_pylist()))])

    return sim(a, b)


def near_pairs(df: DataFrame, order: str, text: Column, threshold: float = 0.85, rows: int = 8, recall: float = 0.9999) -> DataFrame:
    """Pairs (a < b, similarity) of rows at or above the threshold, copies (similarity 1) included.

    Copies are one class, represented by its first row; only representatives are banded and compared, and only the pairs
    found are expanded to their rows.
    """
    # written once: the text may be costly to make, and is read for the classes, the bands and the verification
    base = cut(df.select(F.col(order).alias("id"), F.coalesce(text, F.lit("")).alias("t")))
    members = cut(_classes(base))
    similar = first_pairs(base.join(members.where("id = rep").select("id"), "id", "left_semi"), threshold, rows, recall)
    x, y = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = similar.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    many = members.where("n > 1")
    within = many.select("rep", F.col("id").alias("a")).join(many.select("rep", F.col("id").alias("b")), "rep").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def _classes(base: DataFrame) -> DataFrame:
    """(id, rep, n): the first row and the size of the class of equal texts of each row."""
    keyed = base.select("id", F.md5("t").alias("_k"))
    return keyed.join(keyed.groupBy("_k").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "_k").select("id", "rep", "n")


def first_pairs(texts: DataFrame, threshold: float = 0.85, rows: int = 8, recall: float = 0.9999) -> DataFrame:
    """Pairs (a < b, similarity) of different texts (id, t) at or above the threshold. Bands that one text alone has are
    dropped by a count before any is joined; AQE splits the join of bands that many have."""
    bands = bands_for(threshold, recall, rows)
    banded = cut(texts.select("id", F.length("t").alias("n"), F.explode(minhash(F.col("t"), bands, rows)).alias("h")))
    shared = cut(banded.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"))
    some = banded.join(broadcast_if_small(shared), "h", "left_semi")
    a, b = some.select("h", F.col("id").alias("a"), F.col("n").alias("na")), some.select("h", F.col("id").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, "h").where("a < b").select("a", "b").distinct()
    ends = texts.join(met.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    both = met.join(ends.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(ends.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", jaccard(F.col("ta"), F.col("tb")).alias("similarity")).where(F.col("similarity") >= threshold)


def greedy(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, kept) by the first-seen rule over similar pairs (a < b). Each round is written to the checkpoint folder.

    A round decides at least the first row that is open, so that the rounds end; there are as many as the longest chain of
    rows that wait for one another. Pairs whose later row is decided, or whose earlier one is dropped, go no further.
    """
    pairs = cut(pairs.select("a", "b"))
    state = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        known = state.select(F.col("id").alias("a"), F.col("kept").alias("ka"))
        live = pairs.join(known, "a")
        seen = live.groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("ka", F.lit(False))).alias("hit"), F.bool_or(F.col("ka").isNull()).alias("open"))
        nxt = state.join(seen, "id", "left").select("id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(~F.coalesce("open", F.lit(False)), True).alias("kept"))
        state = cut(nxt)
        undecided = state.where("kept IS NULL").select("id")
        if undecided.isEmpty():
            break
        dropped = state.where("NOT kept").select(F.col("id").alias("a"))
        pairs = cut(pairs.join(undecided.withColumnRenamed("id", "b"), "b", "left_semi").join(dropped, "a", "left_anti"))
    return ids.join(state, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def near_dedup(df: DataFrame, order: str, text: Column, threshold: float = 0.85, written: bool = False) -> DataFrame:
    """(order, reason) for each row: null (kept), 'exact' or 'near'. Exact copies never reach the bands. The text may be
    costly to make, and is read for the fingerprints, the bands and the verification: it is written once, unless it is already."""
    base = df.select(F.col(order).alias("id"), F.coalesce(text, F.lit("")).alias("t"))
    base = base if written else cut(base)
    marked = first_seen(base, "id", X.fingerprint(F.col("t")))
    firsts = spread(cut(marked.where("kept").select("id", "t")))
    decided = greedy(firsts.select("id"), first_pairs(firsts, threshold))
    out = base.select("id").join(decided, "id", "left")  # only firsts are decided
    return out.select(F.col("id").alias(order), F.when(F.col("kept").isNull(), "exact").when(~F.col("kept"), "near").alias("reason"))
