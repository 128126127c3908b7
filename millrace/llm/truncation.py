"""Problem 3: texts cut off by field limits or in transfer.

Intact values are cut artificially (inside words, at words, at the length limits of the sources, with and without an
elision mark) to make positives; a logistic regression over hashed features of the closing characters, their classes,
the last word, the kind of the last line and the distance to the source's length limits is trained on them and scores
every record. Length limits come from a grouped aggregation over all rows: the greatest length of a source, in code
points and in bytes, where many of its rows have it.

Null, blank and placeholder values are no cases; nor are complete texts that end in a list item, a signature or a symbol
or just reach a limit. Trained on at most MAX_TRAIN values, by the hash of their id.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import codepoints as cp
from millrace.llm.language import bounded_sample, is_placeholder
from millrace.llm.sentences import CLOSE, SPACE, STOP, _set
from millrace.llm.visual_form import normalise
from millrace.session import broadcast_if_small, cut

MAX_TRAIN = 6_000
TAIL = 48
BITS = 14
BULLET = _set("-*•–·‣+")
DASH = _set("—–―")
PAUSE = _set(",;:،；，、：")
MARKS = ("…", "...", " …", " ...", "[...]", " [...]", " […]", "… (more)", "... (more)", "… [more]", " [truncated]")


@functools.cache
def char_class() -> np.ndarray:
    """Coarse class of each code point."""
    import unicodedata

    out = np.zeros(0x110000, np.uint8)
    groups = {"Lu": 1, "Ll": 2, "Lo": 3, "Lt": 1, "Lm": 3, "Nd": 4, "Nl": 4, "No": 4, "So": 5, "Sk": 5, "Sm": 6, "Sc": 6, "Mn": 7, "Mc": 7}
    for c in [*range(0x3100), 0xFFFD, *range(0x1F000, 0x1FB00)]:
        out[c] = groups.get(unicodedata.category(chr(c)), 8)
    out[0x3100:0xD800] = 3
    out[0x20000:0x32000] = 3
    for flags, value in ((SPACE, 9), (STOP, 10), (CLOSE, 11), (PAUSE, 12)):
        out[flags] = value
    out[0x2026], out[0xFFFD], out[10] = 13, 14, 15
    return out


def tails(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last TAIL characters of each text in visual form without closing white space, right-aligned, 0 before the
    beginning; class of the first character of the last line: 0 other, 1 bullet, 2 number, 3 dash)."""
    n = len(offs) - 1
    part, poffs = normalise(cps, offs)  # whole texts: the last line may be long, and so may the closing white space
    pl = np.diff(poffs)
    solid = np.flatnonzero(~SPACE[part]) if len(part) else np.zeros(0, np.int64)
    last = np.searchsorted(solid, poffs[1:]) - 1
    has = (last >= 0) & (pl > 0)
    has[has] = solid[last[has]] >= poffs[:-1][has]
    ends = np.where(has, solid[np.maximum(last, 0)] + 1 if len(solid) else 0, poffs[:-1])
    cols = ends[:, None] - TAIL + np.arange(TAIL)[None, :]
    ok = cols >= poffs[:-1][:, None]
    mat = np.where(ok, part[np.clip(cols, 0, max(len(part) - 1, 0))] if len(part) else 0, 0).astype(np.uint32)
    # the last line: after the last line break before the end
    breaks = np.flatnonzero(part == 10) if len(part) else np.zeros(0, np.int64)
    b = np.searchsorted(breaks, ends) - 1
    line = np.where((b >= 0) & (len(breaks) > 0), breaks[np.maximum(b, 0)] + 1 if len(breaks) else 0, poffs[:-1])
    line = np.maximum(line, poffs[:-1])
    safe = lambda x: part[np.clip(x, 0, max(len(part) - 1, 0))] if len(part) else np.zeros(n, np.uint32)
    c0, c1, c2 = safe(line), safe(line + 1), safe(line + 2)
    inside = line + 2 < ends
    digit = (c0 >= 48) & (c0 <= 57)
    digit2 = digit & (c1 >= 48) & (c1 <= 57)
    dot = np.where(digit2, c2, c1)
    kind = np.where(inside & BULLET[c0] & SPACE[c1], 1, 0)
    kind = np.where(inside & digit & ((dot == 46) | (dot == 41)), 2, kind)
    kind = np.where(inside & DASH[c0], 3, kind)
    return mat, kind


def features(cps: np.ndarray, offs: np.ndarray, gap_chars: np.ndarray, gap_bytes: np.ndarray) -> np.ndarray:
    """Hashed features (n x m indices) of texts; the gaps are distances to the source's limits, -1 without one."""
    mat, kind = tails(cps, offs)
    cls = char_class()[mat].astype(np.uint64)
    wide = mat.astype(np.uint64)
    cols: list[np.ndarray] = []

    def add(values: np.ndarray) -> None:
        salt = np.uint64((len(cols) * 1_000_003 + 17) * 0x9E3779B97F4A7C15 % (1 << 64))
        cols.append((cp.mix64(values.astype(np.uint64) + salt) >> np.uint64(64 - BITS)).astype(np.int32))

    h = np.zeros(len(mat), np.uint64)
    g = np.zeros(len(mat), np.uint64)
    for j in range(1, 9):
        g = cp.mix64(g * np.uint64(31) + cls[:, -j] + np.uint64(1))
        add(g)
        if j <= 4:
            h = cp.mix64(h * np.uint64(1_000_003) + wide[:, -j] + np.uint64(1))
            add(h)
    is_word = (cls >= 1) & (cls <= 4) | (cls == 7)
    run = np.cumprod(is_word[:, ::-1], axis=1, dtype=np.int64)
    length = run.sum(1)
    word = (np.where(run > 0, wide[:, ::-1], 0) * (np.arange(TAIL, dtype=np.uint64) * np.uint64(2) + np.uint64(3))).sum(1)
    add(cp.mix64(word) * (length > 0))
    add(np.minimum(length, 15))
    add(kind)
    add(kind * 16 + cls[:, -1].astype(np.int64))
    mark = np.isin(mat[:, -12:], [0x2026]).any(1) * 2 + ((mat[:, -12:-2] == 46) & (mat[:, -11:-1] == 46) & (mat[:, -10:] == 46)).any(1)
    add(mark)
    near = lambda gap: np.where(gap < 0, 6, np.minimum(gap, 5))
    add(near(gap_chars))
    add(near(gap_bytes))
    add(np.minimum(near(gap_chars), near(gap_bytes)) * 16 + cls[:, -1].astype(np.int64))
    return np.stack(cols, 1)


def sizes(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length in code points, and in bytes without a broken last character."""
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])
    n_bytes = np.diff(ends[offs])
    last = np.where(np.diff(offs) > 0, cps[np.maximum(offs[1:] - 1, 0)] if len(cps) else 0, 0)
    return np.diff(offs), n_bytes - 3 * (last == 0xFFFD)


def gaps(size: np.ndarray, limit: np.ndarray) -> np.ndarray:
    return np.where((limit > 0) & (size <= limit), limit - size, -1)


def length_limits(values: DataFrame, least_rows: int = 5, least_share: float = 0.003) -> DataFrame:
    """(source, char_limit, byte_limit): the greatest length of a source where many of its rows have it, else 0.

    One scan; one row per source and length is shuffled, after partial counts, and written.
    """
    body = F.regexp_replace("text", "�$", "")
    sized = values.select("source", F.length("text").alias("chars"), F.octet_length(body).alias("bytes"))
    per = cut(sized.groupBy("source", "chars", "bytes").count())
    top = per.groupBy("source").agg(F.sum("count").alias("n"), F.max("chars").alias("c"), F.max("bytes").alias("b"))
    at = per.join(top, "source").groupBy("source", "n", "c", "b").agg(F.sum(F.when(F.col("chars") == F.col("c"), F.col("count")).otherwise(0)).alias("nc"), F.sum(F.when(F.col("bytes") >= F.col("b") - 3, F.col("count")).otherwise(0)).alias("nb"))
    often = lambda k: (F.col(k) >= least_rows) & (F.col(k) >= least_share * F.col("n"))
    return at.select("source", F.when(often("nc"), F.col("c")).otherwise(0).alias("char_limit"), F.when(often("nb") & ~often("nc"), F.col("b")).otherwise(0).alias("byte_limit"))


def looks_complete(texts: list[str]) -> np.ndarray:
    """Values that serve as intact: closed by a stop or closing mark, a symbol or colon, or ending in a list or
    signature line; no elision mark or broken character at the end."""
    mat, kind = tails(*cp.from_texts(texts))
    cls = char_class()[mat]
    elided = (mat[:, -1] == 0x2026) | (mat[:, -3:] == 46).all(1) | np.array([t.rstrip().endswith(tuple(m.strip() for m in MARKS)) for t in texts], bool)
    return (np.isin(cls[:, -1], (5, 10, 11)) | (mat[:, -1] == 58) | (kind > 0)) & ~elided


def cut_examples(texts: list[str], limits: list[tuple[int, int]], seed: int = 11) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    """Texts with their (char, byte) limits and labels: each intact text whole (0) and cut (1)."""
    rng = np.random.default_rng(seed)
    lims = sorted({x for x in limits if x != (0, 0)}) or [(0, 0)]
    out, lim, y = [], [], []
    for text, own in zip(texts, limits):
        out.append(text)
        lim.append(own)
        y.append(0)
        how = rng.random()
        cut, at = None, own
        if how < 0.3:
            at = lims[rng.integers(len(lims))]
            if at[0] and len(text) > at[0]:
                cut = text[: at[0]]
            elif at[1] and len(raw := text.encode()) > at[1]:
                cut = raw[: at[1]].decode("utf-8", "replace")
        if cut is None and len(text) > 20:
            k = int(rng.integers(10, len(text) - 1))
            at = own
            if how < 0.55:
                cut = text[:k]
            elif how < 0.75:
                cut = text[:k].rsplit(" ", 1)[0]
            elif how < 0.85:
                cut = text.encode()[: int(rng.integers(10, len(text.encode())))].decode("utf-8", "replace")
            else:
                cut = text[:k].rstrip() + MARKS[rng.integers(len(MARKS))]
        if cut and cut.strip():
            body = cut.rstrip()
            line = body.rsplit("\n", 1)[-1]
            # a cut that leaves a complete-looking text says nothing
            apostrophe = body[-1] in "'’" and body[-2:-1].isalpha()
            if how >= 0.85 or apostrophe or not (looks_like_end(body[-1]) or line[:1] in "-*•—" or line[:1].isdigit()):
                out.append(cut)
                lim.append(at)
                y.append(1)
    return out, lim, np.array(y, np.int64)


def looks_like_end(ch: str) -> bool:
    return bool(STOP[ord(ch)] or CLOSE[ord(ch)] or char_class()[ord(ch)] == 5)


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 30, l2: float = 1e-5, seed: int = 5) -> np.ndarray:
    """Logistic regression over hashed features by Adagrad in mini-batches; the last weight is the bias."""
    rng = np.random.default_rng(seed)
    w = np.zeros((1 << BITS) + 1)
    if len(y) == 0 or y.min() == y.max():  # nothing to learn from: no text counts as cut
        w[-1] = -10.0
        return w
    g2 = np.full_like(w, 1e-6)
    for _ in range(epochs):
        for s in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            p = 1 / (1 + np.exp(-(w[x[s]].sum(1) + w[-1]).clip(-30, 30)))
            d = (p - y[s]) / len(s)
            g = np.bincount(x[s].ravel(), np.repeat(d, x.shape[1]), len(w))
            g[-1] += d.sum()
            g += l2 * w
            g2 += g * g
            w -= 0.3 * g / np.sqrt(g2)
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(w[x].sum(1) + w[-1]).clip(-30, 30)))


def train(texts: list[str], limits: list[tuple[int, int]]) -> np.ndarray:
    good = looks_complete(texts)
    some = [(t, x) for t, x, ok in zip(texts, limits, good) if ok]
    out, lim, y = cut_examples([t for t, _ in some], [x for _, x in some], 11)
    more, more_lim, more_y = cut_examples([t for t, _ in some], [x for _, x in some], 12)
    out, lim, y = out + more, lim + more_lim, np.concatenate([y, more_y])
    cps, offs = cp.from_texts(out)
    chars, n_bytes = sizes(cps, offs)
    lim_arr = np.array(lim).reshape(-1, 2)
    return fit(features(cps, offs, gaps(chars, lim_arr[:, 0]), gaps(n_bytes, lim_arr[:, 1])), y)


def _scorer(blob: bytes | None):
    def score(batches):
        w = pickle.loads(blob) if blob else None
        for batch in batches:
            text = batch.column(1)
            live = cp.validity(text)
            cl, bl = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (3, 4))
            for lo, hi in cp.slices(text):
                p = np.zeros(hi - lo)
                if w is not None:
                    cps, offs = cp.flatten(text.slice(lo, hi - lo))
                    chars, n_bytes = sizes(cps, offs)
                    p = np.where(live[lo:hi], probability(w, features(cps, offs, gaps(chars, cl[lo:hi]), gaps(n_bytes, bl[lo:hi]))), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(p)], ["id", "source", "p"])

    return score


def truncation_scores(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, p): probability that the text was cut off; 0 for null, blank and placeholder values.

    Three scans: the sources' lengths, the sample to train on, the scores of all rows.
    """
    own = F.col(text_col)
    live = own.isNotNull() & own.rlike(r"\S") & ~is_placeholder(own)
    values = df.select(F.col(id_col).cast("bigint").alias("id"), F.when(live, own).alias("text"), F.coalesce(source_col, F.lit("")).alias("_host"), F.col(source_col).alias("source"))
    held = values.where("text IS NOT NULL").select("text", F.col("_host").alias("source"))
    limits = broadcast_if_small(cut(length_limits(held).withColumnRenamed("source", "_host")))
    joined = values.join(limits, "_host", "left")
    sample = bounded_sample(joined, MAX_TRAIN, ["id"], ["text", "char_limit", "byte_limit"], F.col("text").isNotNull(), ["text"], df.count())
    blob = pickle.dumps(train([r[0] for r in sample], [(r[1], r[2]) for r in sample])) if sample else None
    return joined.select("id", "text", "source", "char_limit", "byte_limit").mapInArrow(_scorer(blob), "id bigint, source string, p double")


def truncated(df: DataFrame, id_col: str, text_col: str, source_col: str, threshold: float = 0.5) -> DataFrame:
    return truncation_scores(df, id_col, text_col, source_col).where(F.col("p") >= threshold).select(F.col("id").alias(id_col))


def truncation_report(df: DataFrame, id_col: str, text_col: str, source_col: str, threshold: float = 0.5) -> DataFrame:
    """Per source: rows, rows that were cut off, and their share."""
    s = truncation_scores(df, id_col, text_col, source_col)
    cut = F.count_if(F.col("p") >= threshold)
    return s.groupBy("source").agg(F.count("*").alias("n_rows"), cut.alias("n_truncated"), (cut / F.count("*")).alias("share"))
