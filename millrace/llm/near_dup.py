"""Problem 5: near-duplicate records by MinHash banding.

Texts are compared in their plain form (visual form, lower case, other characters one space); the similarity is the
Jaccard coefficient of their sets of 5-character substrings. Texts of fewer than 5 characters have no substrings and no
partner. Null parts count as empty.

1. One scan hashes each text: a 128-bit key of the plain text, the number of its substrings, and one hash per band.
2. Rows of one key form a class; only its representative (least id) goes on, so copies cost nothing further.
3. Band hashes are counted; those of more than one representative are shuffled. Representatives that meet in a band and
   whose set sizes allow the threshold are candidates.
4. A band of more than HOT representatives (texts of one template) makes no pairs. Its representatives are looked up by their
   rarest substrings instead (rare_grams), among all that have such a band: exact, so that nothing is lost, and without
   pairing what only the template makes alike.
5. Candidates are verified on the full substring sets (as 64-bit hashes). Nothing is capped.

Bands and rows: with 7 rows a band, the number of bands is the least one that reaches ``recall`` at the threshold.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import codepoints as cp
from millrace.llm import rare_grams
from millrace.llm.rare_grams import GRAM
from millrace.llm.visual_form import plain
from millrace.session import broadcast_if_small, cut

ROWS = 7
HOT = 500


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """Least number of bands so that a pair at the threshold meets in one of them with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


@functools.cache
def _permutations(n: int) -> np.ndarray:
    """Odd factors: each orders the (well mixed) 32-bit gram hashes anew."""
    return np.random.default_rng(20_240_501).integers(0, 2**31, n, np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(cps: np.ndarray, offs: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct grams and the band hashes (int64, n x bands) of each plain text."""
    by = _permutations(bands * rows)[:, None]
    n = len(offs) - 1
    size = np.zeros(n, np.int64)
    least = np.zeros((n, bands * rows), np.uint32)
    space = np.empty((bands * rows, 1024), np.uint32)
    for i, g in enumerate(rare_grams.sets_of(cps, offs)):
        size[i] = len(g)
        low = (g >> np.uint64(32)).astype(np.uint32)
        for s in range(0, len(low), 1024):
            part = low[None, s : s + 1024]
            block = np.multiply(by, part, out=space[:, : part.shape[1]]).min(axis=1)
            least[i] = block if s == 0 else np.minimum(least[i], block)
    h = np.zeros((n, bands), np.uint64)
    parts = least.reshape(n, bands, rows).astype(np.uint64)
    for j in range(rows):
        h = cp.mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    h = cp.mix64(h + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93))
    return size, h.view(np.int64)


def _signer(bands: int, rows: int):
    def sign(batches):
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for lo, hi in cp.slices(text):
                cps, offs = plain(*cp.flatten(text.slice(lo, hi - lo)))
                size, h = signatures(cps, offs, bands, rows)
                k1, k2 = cp.text_keys(cps, offs)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, bands), pa.int32()), pa.array(h.ravel()))
                out = pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(k1), pa.array(k2), pa.array(size.astype(np.int32)), flat], ["id", "k1", "k2", "size", "bands"])
                yield out.filter(pa.array(size > 0))

    return sign


def jaccard(a: str, b: str, n: int = GRAM) -> float:
    """Exact similarity of two plain texts."""
    x, y = {a[i : i + n] for i in range(len(a) - n + 1)}, {b[i : i + n] for i in range(len(b) - n + 1)}
    both = len(x & y)
    return both / (len(x) + len(y) - both) if both else 0.0


def _shared(pairs: list[tuple[int, int]], sets: list[np.ndarray]) -> np.ndarray:
    """Number of grams that both sets of each pair have; sets are sorted."""
    out = np.zeros(len(pairs))
    for i, (x, y) in enumerate(pairs):
        a, b = (sets[x], sets[y]) if len(sets[x]) < len(sets[y]) else (sets[y], sets[x])
        if len(a):
            out[i] = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return out


def _verifier(threshold: float, words: int, contained: float):
    def verify(batches):
        for batch in batches:
            # the texts of a batch once each, as sorted sets of gram hashes
            both = pa.concat_arrays([batch.column(i).cast(pa.large_string()) for i in (2, 3)]).dictionary_encode()
            chars, grams = [], []
            for lo, hi in cp.slices(both.dictionary):
                cps, offs = plain(*cp.flatten(both.dictionary.slice(lo, hi - lo)))
                chars += rare_grams.sets_of(cps, offs)
                if words:
                    grams += rare_grams.word_sets_of(cps, offs, words)
            left, right = both.indices.to_numpy().reshape(2, -1)
            pairs = list(zip(left.tolist(), right.tolist()))
            size, shared = np.array([len(x) for x in chars]), _shared(pairs, chars)
            sims = shared / np.maximum(size[left] + size[right] - shared, 1)
            inside = _shared(pairs, grams) / np.maximum(np.array([len(x) for x in grams])[left], 1) if words else np.zeros(len(pairs))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims), pa.array(inside)], ["a", "b", "similarity", "containment"])
            yield out.filter(pa.array((sims >= threshold) | (words > 0) & (inside >= contained)))

    return verify


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, words: int = 0, contained: float = 1.0) -> DataFrame:
    """Pairs (a, b) of ids whose texts (id, text) reach the threshold on their full substring sets, with their Jaccard
    coefficient; with ``words``, also those of which b has ``contained`` of a's sequences of so many words or more, and that
    share of each pair as its containment."""
    pairs = cut(pairs.select("a", "b").distinct())  # used twice; the candidates are found once
    some = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = texts.join(some, "id", "left_semi")
    full = pairs.join(held.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(_verifier(threshold, words, contained), "a bigint, b bigint, similarity double, containment double")


def classes_and_links(df: DataFrame, id_col: str, text: Column, threshold: float = 0.75, recall: float = 0.9995, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep, n) of classes of equal plain texts, and (links: a, b, similarity) between representatives."""
    bands = bands_for(threshold, recall, rows)
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    signed = cut(texts.mapInArrow(_signer(bands, rows), "id bigint, k1 bigint, k2 bigint, size int, bands array<bigint>"))
    reps = signed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    members = cut(signed.select("id", "k1", "k2").join(reps, ["k1", "k2"]).select("id", "rep", "n"))
    copies = broadcast_if_small(members.where("id <> rep").select("id"))
    banded = signed.join(copies, "id", "left_anti").select("id", "size", F.explode("bands").alias("h"))
    shared = cut(banded.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"))
    met_in = banded.join(broadcast_if_small(shared), "h")
    cold = met_in.where(f"k <= {HOT}")
    a, b = cold.select("h", F.col("id").alias("a"), F.col("size").alias("sa")), cold.select("h", F.col("id").alias("b"), F.col("size").alias("sb"))
    met = a.join(b, "h").where(f"a < b AND least(sa, sb) >= {threshold} * greatest(sa, sb)").select("a", "b")
    if not shared.where(f"k > {HOT}").isEmpty():
        hot = cut(met_in.where(f"k > {HOT}").select("id").distinct())
        met = met.unionByName(rare_grams.similar_candidates(texts.join(broadcast_if_small(hot), "id", "left_semi"), threshold))
    links = cut(verified(met, texts, threshold).drop("containment"))
    return members, links


def near_duplicate_pairs(df: DataFrame, id_col: str, text: Column, threshold: float = 0.75, recall: float = 0.9995) -> DataFrame:
    """All pairs (<id>_a < <id>_b, similarity) of rows at or above the threshold, copies included."""
    members, links = classes_and_links(df, id_col, text, threshold, recall)
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b"), "similarity")
    many = members.where("n > 1").select("id", "rep")
    within = many.select("rep", F.col("id").alias(f"{id_col}_a")).join(many.select("rep", F.col("id").alias(f"{id_col}_b")), "rep")
    within = within.where(f"{id_col}_a < {id_col}_b").select(f"{id_col}_a", f"{id_col}_b", F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


def components(links: DataFrame) -> DataFrame:
    """(id, root): least id connected to each id of the links (a, b). Alternates large-star and small-star steps, each
    round written to the checkpoint folder, until no edge changes; nothing is gathered on the driver."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = cut(small)
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text: Column, threshold: float = 0.75, recall: float = 0.9995) -> DataFrame:
    """One row per record that has a text: its class id, the size of its class of equal texts and its number of links
    to records of other texts. A record without near-duplicates is a class of its own."""
    members, links = classes_and_links(df, id_col, text, threshold, recall)
    sizes = members.select("rep", "n").distinct()
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    degree = ends.join(sizes.select(F.col("rep").alias("other"), F.col("n").alias("k")), "other").groupBy("rep").agg(F.sum("k").alias("links"))
    root = components(links).withColumnRenamed("id", "rep")
    out = members.join(root, "rep", "left").join(degree, "rep", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("root", "rep").alias("class_id"), F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).cast(T.LongType()).alias("links"))
