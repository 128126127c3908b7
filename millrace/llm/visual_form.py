"""Problem 6: one form for texts that look the same.

Arrow text is copied to code-point arrays; a lookup table gives each code point its expansion (compatibility letters,
widths, styles, ligatures, canonical decompositions, look-alike letters, kinds of space, nothing for invisible ones),
gathered by offsets; combining marks are then put in canonical order and composed pair by pair, for all rows at once.

Equal under the form: full-width and styled letters, digits and punctuation widths, ligatures, composed and decomposed
accents, kinds of space (tab included; line breaks stay), invisible characters, look-alike letters of other scripts.
Apart: letter case, digits for letters, a missing accent, other quote marks or punctuation, super- and subscripts,
fractions, circled letters, runs of spaces of other length.
A null text gives null, an empty text an empty one; a text of invisible characters alone gives an empty text.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import codepoints as cp
from millrace.session import broadcast_if_small, cut

#: Fixed values (public Unicode confusables): letters whose usual shape is that of the letter before the colon, from the
#: Latin, Greek, Cyrillic, Armenian, Cherokee, Coptic and Lisu blocks. Letters that only resemble another loosely in print
#: (Cyrillic г, Greek τ, κ, γ, χ, α) stay letters of their own.
LOOK_ALIKES = """
a:аɑ A:АΑᎪꓮⲀ B:ВΒᏴꓐⲂ b:Ьᑲ c:сϲⅽᴄⲥ C:СϹᏟꓚⲤ d:ԁᏧ D:Ꭰꓓ e:еҽ E:ЕΕᎬꓰⲈ F:Ϝᖴꓝ g:ɡց G:ԌᏀꓖ h:һհᏂ H:НΗᎻꓧⲎ i:іɩıι I:ІΙӀꓲⲒ j:јϳ J:ЈᎫͿꓙ
k: K:КΚᏦꓗⲔ l:ӏ L:Ꮮꓡ M:МΜᎷꓟⲘ n:ոռ N:Νꓠⲛ o:оοօჿഠᴏⲟ O:ОΟՕꓳⲞ p:рρⲣ P:РΡᏢꓑⲢ q:ԛգ Q:Ԛ r: R:ᎡᏒꓣ s:ѕꜱ S:ЅՏᏚꓢ t: T:ТΤᎢꓔⲦ u:υսʋ U:Սሀꓴ
v:νѵᴠ V:ѴᏙꓦ w:ԝաᴡ W:ԜᎳꓪ x:х X:ХΧꓫⲬ y:уү Y:ҮΥꓬⲨ z:ᴢ Z:ΖᏃꓜ æ:ӕ Æ:Ӕ ə:ә Ə:Ә ك:ک ه:ھہ
"""
KEPT_TAGS = {"<font>", "<wide>", "<narrow>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"}
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """The lookup tables: expansion start and length by code point, the pool, combining classes, composition pairs."""
    alike = {ord(x): ord(row[0]) for row in LOOK_ALIKES.split() for x in row[2:]}

    @functools.cache
    def expand(c: int) -> tuple[int, ...]:
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Cf" or c in INVISIBLE:
            return ()
        if cat == "Zs" or c == 9:
            return (32,)
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0][0] == "<":
            tag, parts = parts[0], parts[1:]
            letters = [int(x, 16) for x in parts]
            ok = tag in KEPT_TAGS and letters[0] != 32 and (tag != "<compat>" or all(unicodedata.category(chr(x))[0] in "LMN" for x in letters))
            if not ok:
                parts = []
        if parts:
            return tuple(y for x in parts for y in expand(int(x, 16)))
        return (alike.get(c, c),)

    size = 0x110000
    first = np.arange(size, dtype=np.uint32)
    length = np.ones(size, np.uint8)
    start = np.zeros(size, np.int64)
    ccc = np.zeros(size, np.uint8)
    pool: list[int] = []
    pairs: dict[int, int] = {}
    for c in [*range(0x80), *range(0xA0, 0xD800), *range(0xF900, 0x14700), *range(0x16000, 0x17000), *range(0x1B000, 0x1F800), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        ch = chr(c)
        ccc[c] = unicodedata.combining(ch)
        out = expand(c)
        if out != (c,):
            length[c] = len(out)
            if len(out) == 1:
                first[c] = out[0]
            elif out:
                start[c] = len(pool)
                pool.extend(out)
        raw = unicodedata.decomposition(ch)
        if raw and raw[0] != "<" and " " in raw and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in raw.split())
            key = alike.get(a, a) << 21 | alike.get(b, b)
            # a composite of a look-alike base takes the Latin composite where there is one
            if key not in pairs or a == alike.get(a, a):
                pairs[key] = c
    for lead in range(19):
        for vowel in range(21):
            syllable = 0xAC00 + (lead * 21 + vowel) * 28
            pairs[(0x1100 + lead) << 21 | (0x1161 + vowel)] = syllable
            for tail in range(1, 28):
                pairs[syllable << 21 | (0x11A7 + tail)] = syllable + tail
    keys = np.array(sorted(pairs), np.uint64)
    values = np.array([pairs[int(k)] for k in keys], np.uint32)
    second = np.zeros(size, bool)
    second[(keys & np.uint64(0x1FFFFF)).astype(np.int64)] = True
    return {"first": first, "length": length, "start": start, "pool": np.array(pool or [0], np.uint32), "ccc": ccc, "keys": keys, "values": values, "second": second}


def _pair(t: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Composite of each (a, b), 0 where there is none."""
    key = a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    return np.where(t["keys"][at] == key, t["values"][at], 0).astype(np.uint32)


def _expand(t: dict, cps: np.ndarray, offs: np.ndarray) -> cp.Flat:
    length = t["length"][cps]
    if (length == 1).all():
        return t["first"][cps], offs
    ends = np.cumsum(length, dtype=np.int64)
    out = np.repeat(t["first"][cps], length)
    many = np.flatnonzero(length > 1)
    if len(many):
        k = length[many].astype(np.int64)
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        out[np.repeat(ends[many] - k, k) + step] = t["pool"][np.repeat(t["start"][cps[many]], k) + step]
    return out, np.concatenate([[0], ends])[offs]


def _compose(t: dict, cps: np.ndarray, offs: np.ndarray) -> cp.Flat:
    ccc = t["ccc"][cps]
    if ccc.any():
        head = ccc == 0
        head[offs[:-1][np.diff(offs) > 0]] = True  # a mark that begins a row has no base before it
        run = np.cumsum(head) - 1
        begin = np.flatnonzero(head)
        extent = np.diff(np.append(begin, len(cps)))
        long = (extent > 2) | (extent > 1) & (ccc[begin] > 0)
        if long.any():  # canonical order within a run of marks, stable
            at = np.flatnonzero(long[run] & (ccc > 0))
            order = np.lexsort((np.arange(len(at)), ccc[at], run[at]))
            cps = cps.copy()
            cps[at] = cps[at][order]
            ccc = t["ccc"][cps]
        else:
            cps = cps.copy()
        gone = np.zeros(len(cps), bool)
        live, blocked = np.flatnonzero(extent > 1), np.zeros(len(begin), np.int64)
        k = 1
        while len(live):
            base, mark = begin[live], begin[live] + k
            made = _pair(t, cps[base], cps[mark])
            cls = ccc[mark].astype(np.int64)
            ok = (made > 0) & (ccc[base] == 0) & (blocked[live] < cls)
            cps[base[ok]] = made[ok]
            gone[mark[ok]] = True
            blocked[live[~ok]] = cls[~ok]
            k += 1
            live = live[extent[live] > k]
        cps, offs = cp.keep(cps, offs, ~gone)
    for _ in range(2):  # pairs of starters (Hangul and a few vowels)
        after = t["second"][cps] & (t["ccc"][cps] == 0)
        after[offs[:-1][np.diff(offs) > 0]] = False
        at = np.flatnonzero(after)
        if not len(at):
            break
        made = _pair(t, cps[at - 1], cps[at])
        at, made = at[made > 0], made[made > 0]
        if not len(at):
            break
        cps = cps.copy()
        cps[at - 1] = made
        mask = np.ones(len(cps), bool)
        mask[at] = False
        cps, offs = cp.keep(cps, offs, mask)
    return cps, offs


def normalise(cps: np.ndarray, offs: np.ndarray) -> cp.Flat:
    """The visual form of flat texts."""
    t = tables()
    if len(cps) == 0:
        return cps, offs
    return _compose(t, *_expand(t, cps, offs))


def form_of(texts: list[str | None]) -> list[str]:
    return cp.texts_of(*normalise(*cp.from_texts(texts)))


@functools.cache
def _fold() -> np.ndarray:
    """Lower case by code point; 32 for all that is no letter or digit."""
    out = np.full(0x110000, 32, np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x20000)]:
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LN":
            low = ch.lower()
            out[c] = ord(low[0])
    out[0x20000:0x32000] = np.arange(0x20000, 0x32000)
    return out


def plain(cps: np.ndarray, offs: np.ndarray) -> cp.Flat:
    """Comparison text: visual form, lower case, every run of other characters one space, trimmed."""
    return plain_of_form(*normalise(cps, offs))


def plain_of_form(cps: np.ndarray, offs: np.ndarray) -> cp.Flat:
    """Comparison text of texts that are in their visual form already."""
    if len(cps) == 0:
        return cps, offs
    cps = _fold()[cps]
    blank = cps == 32
    before = np.concatenate([[True], blank[:-1]])
    before[offs[:-1][np.diff(offs) > 0]] = True
    cps, offs = cp.keep(cps, offs, ~(blank & before))  # leading blanks and all but the first of a run
    lens = np.diff(offs)
    last = offs[1:][lens > 0] - 1
    mask = np.ones(len(cps), bool)
    mask[last[cps[last] == 32]] = False
    return cp.keep(cps, offs, mask)


@F.arrow_udf(T.StringType())
def visual_form(col: pa.Array) -> pa.Array:
    """Column -> Column: the visual form."""
    return cp.by_slices(col, normalise)


@F.arrow_udf(T.StringType())
def plain_form(col: pa.Array) -> pa.Array:
    """Column -> Column: the comparison text of the similarity joins."""
    return cp.by_slices(col, plain)


def look_alike_pairs(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Pairs (field, <id>_a, <id>_b) of rows whose values of a field differ but have the same visual form.

    Forms are made once; their digests are written to the checkpoint folder, and only digests are shuffled. Copies of one
    spelling are counted as one by a partial aggregate; forms of one spelling go no further (also the hottest). Spellings
    are paired, then each pair of spellings is expanded to its rows, so that the work is that of the pairs returned: copies
    of a spelling never meet. Null and blank values never count.
    """
    cols = [F.struct(F.lit(f).alias("field"), F.col(f).alias("raw"), visual_form(F.col(f)).alias("form")) for f in fields]
    rows = df.select(F.col(id_col).alias("_id"), F.explode(F.array(*cols)).alias("v")).select("_id", "v.*")
    rows = rows.where(F.col("form").rlike(r"[^\s\x{85}\x{2028}\x{2029}]"))
    keyed = cut(rows.select("_id", "field", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("raw")).alias("raw")))
    spelt = keyed.select("field", "form", "raw").distinct()
    mixed = cut(spelt.groupBy("field", "form").agg(F.count("*").alias("k")).where("k > 1"))
    some = keyed.join(broadcast_if_small(mixed.select("field", "form")), ["field", "form"], "left_semi")
    kinds = some.select("field", "form", "raw").distinct()
    pairs = kinds.select("field", "form", F.col("raw").alias("raw_a")).join(kinds.select("field", "form", F.col("raw").alias("raw_b")), ["field", "form"]).where("raw_a < raw_b")
    a = some.select("field", "form", F.col("raw").alias("raw_a"), F.col("_id").alias("_a"))
    b = some.select("field", "form", F.col("raw").alias("raw_b"), F.col("_id").alias("_b"))
    hit = pairs.join(a, ["field", "form", "raw_a"]).join(b, ["field", "form", "raw_b"]).where("_a <> _b")
    return hit.select("field", F.least("_a", "_b").alias(f"{id_col}_a"), F.greatest("_a", "_b").alias(f"{id_col}_b"))
